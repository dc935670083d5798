"""Hard negatives by coordinate pruning: the vectors of other labels whose score lies just below that of a positive.

Vectors are cut into buckets of similar length, longest first. A bucket keeps a sorted list of every coordinate of its
vectors, scaled to length 1. For an anchor, the least score that still matters gives a least cosine in the bucket, and
this a feasible range for each coordinate: whatever scores enough has its value there. The anchor's strongest
coordinates are its focus; candidates are the vectors in all their ranges, and only these are multiplied out, exactly.

The least score rises while an anchor meets vectors. A sixteenth of the buckets is searched first; its scores are a
sound start for all others, so that most of them return nothing that cannot win.

Anchors are searched for in blocks of bounded size, each over the whole index. Within a block a task returns at most
the k best of every anchor and range.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portcullis.llm.common import saved, shared_dir

#: Vectors of a bucket, anchors that are searched for at once, focus coordinates of an anchor.
BUCKET, ANCHORS, FOCUS = 2048, 20_000, 4
#: One of so many buckets is searched first.
FIRST = 16
#: Up to this size, sums of products are exact in doubles.
EXACT = 2.0**52

BUCKET_SCHEMA = "bucket long, ids binary, labels binary, dims int, width int, vectors binary, orders binary"
FOUND_SCHEMA = "anchor int, slot int, vec_id long, score long"
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Bucket:
    """Vectors of similar length (rows of whole numbers); orders sorts them by each scaled coordinate."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    orders: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.values = self.vectors.astype(float)
        lengths = np.sqrt((self.values**2).sum(1))
        self.shortest, self.longest = lengths.min(), lengths.max()
        self.scaled = self.values / np.where(lengths > 0, lengths, 1)[:, None]
        if self.orders is None:
            self.orders = np.argsort(self.scaled, axis=0, kind="stable").astype(np.uint16)
        self.lists = np.take_along_axis(self.scaled, self.orders.astype(np.int64), 0)

    def least_cosines(self, lengths: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """For anchors of these lengths, the least cosine of a vector of this bucket that reaches the needed score."""
        bound = lengths * np.where(needed > 0, self.longest, self.shortest)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(bound > 0, needed / bound, np.where(needed > 0, np.inf, -np.inf))


@dataclass
class Search:
    """The anchors of a block: what they look for and what they have found so far."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    ranges: list[list[tuple[int, int]]]
    k: int
    same: bool
    least: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        values = self.vectors.astype(float)
        self.lengths = np.sqrt((values**2).sum(1))
        scaled = values / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.focus = np.argsort(-np.abs(scaled), axis=1, kind="stable")[:, :FOCUS]
        self.angles = np.arccos(np.clip(np.take_along_axis(scaled, self.focus, 1), -1, 1))
        self.least = self.least or [[low for low, _ in r] for r in self.ranges]
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in r] for r in self.ranges]
        self.verified = 0

    def needed(self) -> np.ndarray:
        """The least score that any range of an anchor still takes; infinite for anchors without ranges."""
        return np.array([min(x, default=math.inf) for x in self.least], float)

    def spans(self, bucket: Bucket, cosines: np.ndarray) -> tuple[np.ndarray, ...]:
        """Feasible values of each anchor's focus coordinates, and where they begin and end in the sorted lists.

        Two vectors of cosine c at least lie within the angle arccos(c) of each other, and so do their angles to an axis.
        """
        reach = np.arccos(np.clip(cosines, -1, 1))[:, None] + 1e-7
        lows = np.cos(np.minimum(self.angles + reach, math.pi)) - 1e-12
        highs = np.cos(np.maximum(self.angles - reach, 0)) + 1e-12
        begins, ends = np.zeros(self.focus.shape, int), np.zeros(self.focus.shape, int)
        for f in np.unique(self.focus):
            at = self.focus == f
            begins[at] = np.searchsorted(bucket.lists[:, f], lows[at], "left")
            ends[at] = np.searchsorted(bucket.lists[:, f], highs[at], "right")
        return lows, highs, begins, ends

    def candidates(self, bucket: Bucket, n: int, spans: tuple[np.ndarray, ...]) -> np.ndarray:
        """The bucket's rows in the feasible ranges of all focus coordinates of anchor n, and of fitting labels."""
        lows, highs, begins, ends = (x[n] for x in spans)
        if not len(lows):
            rows = np.arange(len(bucket.ids))
        else:
            shortest = int(np.argmin(ends - begins))
            rows = bucket.orders[begins[shortest] : ends[shortest], self.focus[n][shortest]]
            for i, f in enumerate(self.focus[n]):
                if i != shortest and ends[i] - begins[i] < len(bucket.ids):
                    values = bucket.scaled[rows, f]
                    rows = rows[(values >= lows[i]) & (values <= highs[i])]
        fits = (bucket.labels[rows] == self.labels[n]) == self.same
        return rows[fits & (bucket.ids[rows] != self.ids[n])]

    def scores(self, bucket: Bucket, n: int, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; those beyond 64 bits become the largest or smallest number."""
        if self.lengths[n] * bucket.longest < EXACT:
            return (bucket.values[rows] @ self.vectors[n].astype(float)).astype(np.int64)
        exact = bucket.vectors[rows].astype(object) @ self.vectors[n].astype(object)
        return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)

    def meet(self, bucket: Bucket) -> None:
        """Lets every anchor meet the bucket's candidates."""
        bucket = _widened(bucket, self.vectors.shape[1])
        cosines = bucket.least_cosines(self.lengths, self.needed() - 0.5)
        spans = self.spans(bucket, cosines)
        for n in np.flatnonzero(cosines <= 1 + 1e-9):
            rows = self.candidates(bucket, n, spans)
            if not len(rows):
                continue
            scores, ids = self.scores(bucket, n, rows), bucket.ids[rows]
            self.verified += len(rows)
            for slot, (_, high) in enumerate(self.ranges[n]):
                fits = (scores >= self.least[n][slot]) & (scores <= high)
                if fits.any():
                    self._take(n, slot, scores[fits], ids[fits])

    def _take(self, n: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[enough], ids[enough]
        held = self.best[n][slot] + [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        self.best[n][slot] = held = sorted(held)[: self.k]
        if len(held) == self.k:
            self.least[n][slot] = max(self.least[n][slot], -held[-1][0])

    def found(self) -> pa.RecordBatch:
        rows = [(n, slot, i, -s) for n, slots in enumerate(self.best) for slot, held in enumerate(slots) for s, i in held]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "slot", "vec_id", "score"])


def _widened(bucket: Bucket, dims: int) -> Bucket:
    """The bucket with as many coordinates as the anchors; missing ones are 0, those that no anchor has count nothing."""
    have = bucket.vectors.shape[1]
    if have == dims:
        return bucket
    vectors = np.pad(bucket.vectors, ((0, 0), (0, max(0, dims - have))))[:, :dims]
    return Bucket(bucket.ids, bucket.labels, vectors)


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    """Rows of whole numbers, in the narrowest type; shorter vectors are filled with 0."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    fits = next(t for t in (np.int16, np.int32, np.int64) if not out.size or (out.min() >= np.iinfo(t).min and out.max() <= np.iinfo(t).max))
    return out.astype(fits)


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label and vector (each component floor(256 x), x as double) of all rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(256 * x.cast("double"))))


def index_of(rows: DataFrame) -> DataFrame:
    """Buckets of all rows: dealt out by ranges of length (and id, as many lengths may be equal), longest first."""
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("length", length).repartitionByRange(F.col("length").desc(), "vec_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list[int]]] = []
        number = 0

        def emit() -> pa.RecordBatch:
            ids, labels, vectors = zip(*held[:BUCKET], strict=True)
            matrix = _matrix(vectors)
            made = Bucket(np.array(ids, np.int64), np.array(labels, np.int64), matrix)
            values = [ids[0] * 1_000_003 + number, made.ids.tobytes(), made.labels.tobytes(), matrix.shape[1], matrix.itemsize, matrix.tobytes(), made.orders.tobytes()]
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in BUCKET_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BUCKET:
                yield emit()
                held, number = held[BUCKET:], number + 1
        if held:
            yield emit()

    ordered = dealt.sortWithinPartitions(F.col("length").desc(), "vec_id")
    return ordered.select("vec_id", "label", "vector").mapInArrow(build, BUCKET_SCHEMA)


def bucket_of(row: dict[str, Any]) -> Bucket:
    ids = np.frombuffer(row["ids"], np.int64)
    shape = (len(ids), row["dims"])
    vectors = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(shape)
    return Bucket(ids, np.frombuffer(row["labels"], np.int64), vectors, np.frombuffer(row["orders"], np.uint16).reshape(shape))


def _searched(index: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """What the tasks find in the buckets of index."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Search(**shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                mine.meet(bucket_of(row))
        yield mine.found()

    return index.mapInArrow(search, FOUND_SCHEMA)


def best_of(index: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """The k best (anchor, slot, vec_id, score, rank) of every anchor's ranges: first in some buckets, then in the rest."""
    early = F.pmod(F.xxhash64("bucket"), F.lit(FIRST)) == 0
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted["k"])
    first = saved(top(_searched(index.where(early), wanted)), "first-found")
    least = [[low for low, _ in r] for r in wanted["ranges"]]
    for row in first.where(F.col("rank") == wanted["k"]).collect():  # at most one for each range of the block
        least[row["anchor"]][row["slot"]] = max(least[row["anchor"]][row["slot"]], row["score"])
    rest = _searched(index.where(~early), wanted | {"least": least})
    return saved(top(first.drop("rank").unionByName(rest)), "found")


def mine(
    vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Hard negatives (RESULT_SCHEMA) of the rows for which anchors holds, exactly.

    A score is the inner product of two whole-number vectors (rows_of); higher scores come first, ties by smaller id.
    An anchor's positives are its best other rows of the same label. For each of them the best rows of other labels are
    returned whose score lies between low and high per cent of the positive's; with a negative score of the positive
    there are none. Rows that share the anchor's id are never its partners; an anchor that repeats is searched for as
    often; other repeated rows all count. Missing components of shorter vectors count as 0. anchors may use the columns
    vec_id and label.
    """
    spark = vectors.sparkSession
    rows = saved(rows_of(vectors, id_col, vector_col, label), "vectors")
    index = saved(index_of(rows), "buckets")
    # Saved with a number of its own, a row falls into the same block whenever it is read, and copies are spread.
    asked = saved(rows.where(anchors).withColumn("place", F.monotonically_increasing_id()), "anchors")
    blocks = -(-asked.count() // ANCHORS)
    path = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    _empty(spark).write.parquet(path)
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block).toArrow()
        ids = np.array(some["vec_id"].to_pylist(), np.int64)
        wanted = {"ids": ids, "labels": np.array(some["label"].to_pylist(), np.int64), "vectors": _matrix(some["vector"].to_pylist())}
        best = best_of(index, wanted | {"ranges": [[(-(2**63), 2**63 - 1)]] * len(ids), "k": positives, "same": True})
        pairs = best.select("anchor", "rank", "vec_id", "score").orderBy("anchor", "rank").collect()  # a few for each anchor of the block
        ranges: list[list[tuple[int, int]]] = [[] for _ in ids]
        for p in pairs:
            ranges[p["anchor"]].append((-(-low * p["score"] // 100), high * p["score"] // 100))
        found = best_of(index, wanted | {"ranges": ranges, "k": negatives, "same": False})
        named = spark.createDataFrame(
            [(p["anchor"], p["rank"] - 1, int(ids[p["anchor"]]), p["vec_id"], p["score"]) for p in pairs],
            "anchor int, slot int, anchor_id long, positive_id long, positive_score long",
        )
        joined = found.join(F.broadcast(named), ["anchor", "slot"])
        result = joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        result.write.mode("append").parquet(path)
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)
