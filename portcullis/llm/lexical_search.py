"""Ranked lexical search by two trees: the best documents of every item under a term-weighting score, exactly.

A document's vector holds its credit for each term, an item's the weight of each of its terms times its repeats; the
score is their product. Both sides are hierarchies: a node holds, for every term, the largest value below it. The
product of two nodes' maxima is at least the score of any pair below them, so where it is less than the weakest of the
items' k-th best scores, the whole batch of pairs is left out; otherwise both nodes are opened. Nothing is estimated:
pairs whose bounds hold are multiplied out in whole numbers.

Documents are met in blocks, each with its own tree, in the tasks that read them. A sixteenth of the documents is
searched first; the k-th best scores found there are where all other tasks begin.

Items are searched for in blocks of bounded size. Only terms of a block's items matter to it, so a document's vector
holds these alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portcullis.llm.common import saved

#: Terms (with repeats) of the items that are searched for at once, on average.
ITEM_TERMS = 200_000
#: One of so many documents is searched first.
FIRST = 16
#: Documents and items at the bottom of the trees; children of a document node.
DOC_LEAF, ITEM_LEAF, FAN = 8, 8, 4
#: Cells (documents x terms) of a block of documents.
CELLS = 4 << 20
#: A document's credit is below this; the constants of its length (fixed values of the contract's formula).
FULL_CREDIT, GAIN, SLOPE = 1_000_000_000, 1000, 12
#: Up to this size, sums of products are exact in doubles.
EXACT = 2**52
#: Stands for a null id: it comes after all others.
NO_ID = 2**63 - 1

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"

#: Letters of A-Z lower-cased; ASCII letters, digits and all bytes of other characters kept; the rest parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def credits(counts: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What a document of n terms gets for a term that it holds so many times."""
    m = 100 - 25 + (25 * n * n_docs) // length
    return (FULL_CREDIT * counts) // (GAIN * counts + SLOPE * m)


class Items:
    """The tree over items: a binary hierarchy over items in the order of their weightiest terms."""

    def __init__(self, weights: list[dict[int, int]], k: int, least: np.ndarray) -> None:
        self.k = k
        self.weights = weights
        self.least = least.copy()
        self.scores = [np.empty(0, np.int64) for _ in weights]
        self.ids = [np.empty(0, np.int64) for _ in weights]
        # Where sums may be too large for doubles, whole numbers are used.
        self.kind = np.float64 if all(sum(w.values()) * (FULL_CREDIT // GAIN) < EXACT for w in weights) else np.int64
        kept = [i for i, w in enumerate(weights) if w]
        order = sorted(kept, key=lambda i: (-max(weights[i].values()), max(weights[i], key=lambda t: (weights[i][t], t)), i))
        self.root = self._node(order) if order else None

    def _node(self, items: list[int]) -> dict[str, Any]:
        highest: dict[int, int] = {}
        for i in items:
            for t, w in self.weights[i].items():
                highest[t] = max(highest.get(t, 0), w)
        terms = np.array(sorted(highest), np.int64)
        node = {"items": np.array(items), "terms": terms, "highest": np.array([highest[t] for t in terms.tolist()], self.kind)}
        if len(items) <= ITEM_LEAF:
            place = {t: j for j, t in enumerate(terms.tolist())}
            rows = np.zeros((len(terms), len(items)), self.kind)
            for column, i in enumerate(items):
                for t, w in self.weights[i].items():
                    rows[place[t], column] = w
            return node | {"rows": rows, "children": []}
        half = len(items) // 2
        return node | {"children": [self._node(items[:half]), self._node(items[half:])]}

    def weakest(self, node: dict[str, Any]) -> int:
        """The weakest k-th best score of the items below a node."""
        return int(self.least[node["items"]].min())

    def take(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Keeps the k best of what an item has and these."""
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        self.scores[item], self.ids[item] = scores, ids
        if len(scores) == self.k:
            self.least[item] = max(self.least[item], int(scores.min()))

    def found(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        items = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        ids = np.concatenate([*self.ids, np.empty(0, np.int64)])
        scores = np.concatenate([*self.scores, np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


class Documents:
    """The tree over a block of documents: levels of maxima over documents in the order of their lengths."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        self.levels = [np.maximum.reduceat(matrix, np.arange(0, len(matrix), DOC_LEAF))]
        while len(self.levels[-1]) > FAN:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN)))


def meet(items: Items, docs: Documents) -> int:
    """Searches one tree for all of another; returns how many pairs were multiplied out."""
    done = 0
    if items.root is None:
        return 0
    top = len(docs.levels) - 1
    stack = [(items.root, top, np.arange(len(docs.levels[top])))]
    while stack:
        node, level, nodes = stack.pop()
        bounds = docs.levels[level][np.ix_(nodes, node["terms"])] @ node["highest"]
        nodes = nodes[bounds >= max(1, items.weakest(node))]
        if not len(nodes):
            continue
        if level:
            below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < len(docs.levels[level - 1])]
        else:
            below = nodes
        if node["children"]:
            stack += [(child, max(0, level - 1), below) for child in node["children"]]
        elif level:
            stack.append((node, level - 1, below))
        else:
            rows = (nodes[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
            rows = rows[rows < len(docs.ids)]
            scores = (docs.matrix[np.ix_(rows, node["terms"])] @ node["rows"]).astype(np.int64)
            done += scores.size
            for column, item in enumerate(node["items"].tolist()):
                fits = scores[:, column] >= max(1, items.least[item])
                if fits.any():
                    items.take(item, scores[fits, column], docs.ids[rows[fits]])
    return done


def totals(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """N and L: the documents with a term, and all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            for text in batch.column(0):
                size = len(terms_of(text.as_py()))
                n, length = n + (size > 0), length + size
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["n", "length"])

    row = docs.select(text_col).mapInArrow(count, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return row[0] or 0, row[1] or 0


def doc_vectors(docs: DataFrame, id_col: str, text_col: str, book: dict[bytes, int]) -> DataFrame:
    """VECTORS of all documents with a term: their size, and the numbers and counts of the terms that are in the book."""
    shared = docs.sparkSession.sparkContext.broadcast(book)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            for begin in range(0, len(batch), 512):
                rows = []
                for key, text in zip(*(c.to_pylist() for c in batch.slice(begin, 512).columns), strict=True):
                    words = terms_of(text)
                    if words:
                        held = {book[w]: c for w, c in Counter(words).items() if w in book}
                        rows.append((key, len(words), list(held), list(held.values())))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, VECTORS)


@dataclass
class Query:
    """A block of items: the weights of their terms, and the corpus numbers that credits depend on."""

    weights: list[dict[int, int]]
    n_terms: int
    n_docs: int
    length: int
    k: int


def _found(vectors: DataFrame, query: Query, least: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((query, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, least = shared.value
        items = Items(query.weights, query.k, least)
        rows = max(16, min(2048, CELLS // max(1, query.n_terms)))
        for batch in batches:
            for begin in range(0, len(batch), rows):
                meet(items, _block(batch.slice(begin, rows), query, items.kind))
        yield items.found()

    return vectors.mapInArrow(search, FOUND)


def _block(batch: pa.RecordBatch, query: Query, kind: type) -> Documents:
    """The tree over the documents of a batch."""
    n = batch.column(1).to_numpy()
    order = np.argsort(n, kind="stable")
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    sizes = np.diff(batch.column(2).offsets.to_numpy())
    place = np.empty(len(n), int)
    place[order] = np.arange(len(n))
    rows = np.repeat(place, sizes)
    counts = batch.column(3).flatten().to_numpy().astype(np.int64)
    matrix = np.zeros((len(n), query.n_terms), kind)
    matrix[rows, batch.column(2).flatten().to_numpy()] = credits(counts, np.repeat(n, sizes), query.n_docs, query.length)
    return Documents(ids[order], matrix)


def _best(vectors: DataFrame, query: Query) -> DataFrame:
    """The k best (item, doc_id, score, rank) of every item."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= query.k)
    early = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0
    first = saved(top(_found(vectors.where(early), query, np.zeros(len(query.weights), np.int64))), "first-found")
    least = np.zeros(len(query.weights), np.int64)
    for row in first.where(F.col("rank") == query.k).collect():  # at most one for each item of the block
        least[row["item"]] = row["score"]
    return top(first.drop("rank").unionByName(_found(vectors.where(~early), query, least)))


def search(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, k: int = 20) -> DataFrame:
    """The k documents with the highest scores above 0 for every item: item_id, rank, doc_id, score (RESULT).

    Terms, weights, credits and scores are as the functions above define them; equal scores are ranked by ascending
    doc_id, a null id last. Null texts have no terms. Every row is a document or an item of its own, also where ids
    repeat or are null. An item without terms that documents hold, like any item of an empty corpus, has no rows.
    """
    spark = docs.sparkSession
    n_docs, length = totals(docs, text_col)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    _, all_terms = totals(asked, "text")
    asked = saved(asked.withColumn("place", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-all_terms // ITEM_TERMS))
    parts = [_block_of_items(spark, docs, id_col, text_col, asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b), n_docs, length, k) for b in range(blocks)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _block_of_items(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, n_docs: int, length: int, k: int) -> DataFrame:
    ids, texts = (c.to_pylist() for c in asked.select("item_id", "text").toArrow().columns)  # a block of bounded size
    counted = [Counter(terms_of(t)) for t in texts]
    book = {w: i for i, w in enumerate(sorted(set().union(*counted)))}
    vectors = saved(doc_vectors(docs, id_col, text_col, book), "vectors")
    df = Counter({r["term"]: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()})  # the book's terms
    weight = {w: weight_of(n_docs, df[i]) if df[i] else 0 for w, i in book.items()}
    # Terms of weight 0 add nothing to any score.
    query = Query([{book[w]: c * weight[w] for w, c in item.items() if weight[w]} for item in counted], len(book), n_docs, max(1, length), k)
    named = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], "item int, item_id long")
    best = saved(_best(vectors, query), "found").join(F.broadcast(named), "item")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
