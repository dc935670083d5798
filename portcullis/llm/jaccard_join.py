"""Near-duplicate documents: an exact join on the Jaccard similarity of word n-grams, as connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import saved, small, small_batches

#: Words of a shingle, and the least similarity in per cent.
SHINGLE, PERCENT = 5, 75
#: A document's first prefix leaves out this share of its shingles: those with the largest hashes.
LEFT_OUT = 5 / 8
#: Members of a block that meet in one task at most; larger blocks are cut into tiles, and each two tiles meet.
TILE = 1024
#: Seeds of the further token orders, besides the one by document frequency.
ORDERS = (101, 202)

_MIX = [np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; with fewer words, one of all of them; else none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(SHINGLE, len(hashed))
    n = len(hashed) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = (total ^ hashed[k : k + n]) * _MIX[0]
        total ^= total >> np.uint64(29)
        total = total * _MIX[1] + _MIX[2]
    total ^= total >> np.uint64(32)
    return np.unique(total.view(np.int64))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: shingles take several times the memory of their texts."""
    return (batch.slice(begin, rows) for batch in batches for begin in range(0, len(batch), rows))


def _class_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of each text's set and a key of its elements, null for the empty set."""
    for batch in _few(batches):
        found = [shingles(t) for t in batch.column(1).to_pylist()]
        keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "set_key", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with each set's first prefix."""
    for batch in _few(batches):
        found = [shingles(t) for t in batch.column(1).to_pylist()]
        keys, sizes = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], [len(x) for x in found]
        prefixes = [x[: len(x) - int(LEFT_OUT * len(x))] for x in found]
        offsets = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
        values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))],
            ["doc_id", "set_key", "n", "prefix"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        found = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "own"])


def _flag_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their tokens: whether a neighbour has the same token. The partition's first and last row are edges."""

    def out(rows: tuple, before, after, first: bool, last: bool) -> pa.RecordBatch:
        token = rows[0]
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        same[:-1] |= token[1:] == token[:-1]
        same[0] |= before is not None and before == token[0]
        same[-1] |= after is not None and after == token[-1]
        edge = np.zeros(len(token), bool)
        edge[0] |= first
        edge[-1] |= last
        keep = same | edge
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*rows, same, edge)], ["token", "doc_id", "n", "shared", "edge"])

    held, before = None, None
    for batch in batches:
        if not len(batch):
            continue
        rows = tuple(batch.column(i).to_numpy() for i in range(3))
        if held is not None:
            yield out(held, before, rows[0][0], before is None, False)
            before = held[0][-1]
        held = rows
    if held is not None:
        yield out(held, before, None, before is None, True)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            one, two = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _common(lists: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many values the lists of rows share with those of columns, in slices of the values to bound memory."""
    total = np.zeros((len(rows), len(columns)), np.float32)
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, at = np.unique(flat, return_inverse=True)
    for begin in range(0, int(at.max(initial=-1)) + 1, 2048):
        low, high = np.searchsorted(at, [begin, begin + 2048])
        part = np.zeros((len(lists), 2048), np.float32)
        part[owner[low:high], at[low:high] - begin] = 1
        total += part[rows] @ part[columns].T
    return total


def _need_checks(group: pd.DataFrame) -> pd.DataFrame:
    """For each block's two tiles: the members with a pair that only an exact comparison can decide, and is due here.

    A pair is due in the block of the smallest token that both keep; it is out if its sizes differ too much, if the
    documents are joined already, or if their first prefixes share too few tokens for the larger one.
    """
    out = []
    for _, g in group.groupby(["block", "tile"], sort=False):
        if g.comp.nunique() < 2:
            continue
        need = g.comp.to_numpy()[:, None] != g.comp.to_numpy()[None, :]
        n = g.n.to_numpy()
        need &= (100 * np.minimum(n[:, None], n[None, :])) >= PERCENT * np.maximum(n[:, None], n[None, :])
        every = np.arange(len(g))
        need &= _common([np.asarray(x, np.int64) for x in g.earlier], every, every) == 0
        least = g.least.to_numpy()
        need &= _common([np.asarray(x, np.int64) for x in g.shared], every, every) >= np.maximum(least[:, None], least[None, :])
        mine = need.any(axis=1)
        if mine.any():
            out.append(g.loc[mine, ["block", "tile", "doc_id", "comp"]])
    return pd.concat(out) if out else pd.DataFrame({"block": [], "tile": [], "doc_id": [], "comp": []}).astype({"block": "int64", "tile": "int64", "doc_id": "int64", "comp": "int64"})


def _check_tile(group: pd.DataFrame) -> pd.DataFrame:
    """Compares all members of each group with each other; one link for each two components that a pair joins."""
    pairs = []
    for _, g in group.groupby(["block", "tile"], sort=False):
        sets = [np.frombuffer(x, np.int64) for x in g.own]
        sizes, ids, comps = np.array([len(s) for s in sets]), g.doc_id.to_numpy(), g.comp.to_numpy()
        every = np.arange(len(sets))
        for begin in range(0, len(sets), 256):
            rows = every[begin : begin + 256]
            both = _common(sets, rows, every)
            close = 100 * both >= PERCENT * (sizes[rows][:, None] + sizes[None, :] - both)
            at, other = np.nonzero(close & (comps[rows][:, None] < comps[None, :]))
            found = pd.DataFrame({"a": ids[rows][at], "b": ids[other], "ca": comps[rows][at], "cb": comps[other]})
            pairs.append(found.drop_duplicates(["ca", "cb"])[["a", "b"]])
    found = pd.concat(pairs) if pairs else pd.DataFrame({"a": [], "b": []})
    return found.astype({"a": "int64", "b": "int64"})


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, comp): the smallest id that links reach from each node, itself included.

    Labels spread to neighbours and jump to the labels of labels until nothing changes; each round is a written table.
    """
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(nodes.select("doc_id", F.col("doc_id").alias("comp")), "labels")
    if both.isEmpty():
        return labels
    active = saved(both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("low")).select("doc_id", F.least("doc_id", "low").alias("comp")), "labels")
    while True:
        near = both.join(active.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("low"))
        spread = active.join(near, "doc_id").select("doc_id", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        far = active.select(F.col("doc_id").alias("comp"), F.col("comp").alias("jump"))
        moved = saved(spread.join(far, "comp", "left").select("doc_id", "was", F.least("comp", "jump").alias("comp")), "labels")
        changed = moved.where("was <> comp").limit(1).count()
        active = moved.select("doc_id", "comp")
        if not changed:
            break
    return labels.select("doc_id").join(active, "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"))


def _links(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Documents in question and links among class representatives (doc_id, n, prefix) that join all their components."""
    postings = reps.select(F.explode("prefix").alias("token"), "doc_id", "n")
    # Ranges of (token, document) also divide the rows of one frequent token; only border rows need a second look.
    flagged = saved(postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id").mapInArrow(_flag_shared, "token long, doc_id long, n long, shared boolean, edge boolean"), "shared")
    edges = flagged.where("edge").groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("token")
    shared = flagged.where("shared").select("token", "doc_id", "n").unionAll(
        flagged.where("edge and not shared").join(edges, "token", "left_semi").select("token", "doc_id", "n")
    )
    # Two similar documents, the larger of m tokens, share 75 % of m or more and leave out 5/8 of m at most, so their
    # prefixes share m / 8 or more tokens, which no partner's size lowers below n / 8. With fewer a document is out.
    least = F.greatest(F.lit(1), F.ceil(F.lit(PERCENT / 100 - LEFT_OUT) * F.col("n"))).cast("long").alias("least")
    lists = shared.groupBy("doc_id", "n").agg(F.collect_list("token").alias("tokens")).select("doc_id", "n", least, "tokens")
    alive = saved(lists.where(F.size("tokens") >= F.col("least")), "alive")
    again = alive.select("doc_id", "n", "least", F.explode("tokens").alias("token"))
    often = again.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = again.select("doc_id", "token").join(often, "token").groupBy("doc_id").agg(F.collect_list(F.struct("often", "token")).alias("t"))
    ranked = ranked.join(alive.select("doc_id", "n", "least"), "doc_id").where(F.size("t") >= F.col("least"))
    # Three global orders of the tokens: by frequency, then by two hashes; of each the first tokens are kept that any
    # two documents with so many shared ones must have one of in common.
    first = F.size("t") - F.col("least").cast("int") + 1
    by_hash = lambda seed: F.transform(F.slice(F.array_sort(F.transform("t", lambda x: F.struct(F.xxhash64(x["token"], F.lit(seed)).alias("h"), x["token"].alias("token")))), 1, first), lambda x: x["token"])
    kept = F.transform(F.slice(F.array_sort("t"), 1, first), lambda x: x["token"])
    # Where only the number of equal tokens counts, short hashes will do: equal ones by chance only let a pair pass to its
    # exact comparison.
    short = lambda c: F.array_distinct(F.transform(c, lambda t: F.hash(t)))
    prefix = short(F.transform("t", lambda x: x["token"])).alias("shared")
    # Tokens that fall together may make the list shorter by a few, so that many fewer are asked for.
    fewer = (F.col("least") - (F.size("t") - F.size(prefix))).alias("least")
    docs_kept = saved(ranked.select("doc_id", "n", fewer, F.array_sort(kept).alias("kept"), short(by_hash(ORDERS[0])).alias("other0"), short(by_hash(ORDERS[1])).alias("other1"), prefix), "kept")
    # Tokens that the same documents keep make one block.
    tokens = docs_kept.select(F.explode("kept").alias("token"), "doc_id")
    member = F.xxhash64("doc_id")
    blocks = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 20)).alias("s"), F.min("doc_id").alias("leader")).where("members > 1")
    blocks = saved(blocks.groupBy("members", "x", "s", "leader").agg(F.min("token").alias("block")).select("block", "members", "leader"), "blocks")
    if blocks.isEmpty():
        return None
    placed = saved(tokens.join(blocks, tokens["token"] == blocks["block"]).select("block", "members", "leader", "doc_id"), "placed")
    # First each block's members are compared with its first document.
    stars = placed.where("leader <> doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = lambda name: docs_kept.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "least", "other0", "other1", "shared")))
    alike = stars.join(side("a"), "a").join(side("b"), "b").where(
        (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & F.arrays_overlap("other0_a", "other0_b") & F.arrays_overlap("other1_a", "other1_b")
        & (F.size(F.array_intersect("shared_a", "shared_b")) >= F.greatest("least_a", "least_b"))
    )
    pairs = saved(alike.select("a", "b"), "pairs")
    whom = saved(docs_kept.select("doc_id"), "whom")
    # Whole sets are made of the documents alone that have a pair to compare.
    sets_of = lambda ids, name: saved(docs.join(small(saved(ids, "ids")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "doc_id long, own binary"), name)
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sets")
    own = lambda name: sets.select(F.col("doc_id").alias(name), F.col("own").alias(f"own_{name}"))
    star_links = saved(pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "own_a", "own_b").mapInArrow(_linked, "a long, b long"), "stars")
    joined = saved(components(whom, star_links), "joined")
    # Then, in blocks whose members are not all joined yet, the pairs between components. Blocks of two are done.
    open_rows = placed.where("members > 2").join(joined, "doc_id")
    mixed = open_rows.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("block")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("members") * 2 / TILE)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    tiled = open_rows.join(mixed, "block").withColumn("tiles", tiles).withColumn("mine", mine)
    # Tile i of t meets tile j in the group numbered min * t + max; with one tile that is group 0.
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn(
        "tile", (F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other")).cast("long")
    )
    packed = docs_kept.select("doc_id", "n", "least", "kept", "shared")
    earlier = F.filter("kept", lambda t: t < F.col("block")).alias("earlier")
    rows = tiled.select("block", "tile", "doc_id", "comp").join(packed, "doc_id").select("block", "tile", "doc_id", "comp", "n", "least", earlier, "shared")
    bins = max(1, tiled.count() // 10_000)
    grouped = lambda df, count: df.withColumn("bin", F.pmod(F.xxhash64("block", "tile"), F.lit(count)))
    due = saved(grouped(rows, bins).groupBy("bin").applyInPandas(_need_checks, "block long, tile long, doc_id long, comp long"), "due")
    bins = max(1, due.count() // 2_000)
    more = grouped(due.join(sets_of(due.select("doc_id").distinct(), "due-sets"), "doc_id"), bins).groupBy("bin").applyInPandas(_check_tile, "a long, b long")
    return whom, saved(star_links.unionAll(more), "all-links")


def _of_repeated(rows: DataFrame) -> DataFrame:
    """The same where ids repeat: each row gets a key of its own, and then rows are joined that share an id."""
    keyed = saved(rows.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    found = saved(keyed.select("row_key", "doc_id").join(near_duplicates(keyed, "row_key", "text").withColumnRenamed("doc_id", "row_key"), "row_key"), "by-row")
    groups = saved(found.groupBy(F.col("component_id").alias("group")).agg(F.min("doc_id").alias("low")), "groups")
    links = found.join(groups, found["component_id"] == groups["group"]).where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    comps = components(found.select("doc_id").distinct(), links)
    return found.select("doc_id", "n_shingles").join(comps.withColumnRenamed("comp", "component_id"), "doc_id")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs with a non-null id: doc_id, n_shingles, component_id.

    Two documents are linked when 100 * shared shingles >= 75 * all their shingles; the component is the smallest id
    that links reach. Documents with equal sets are one class, of which only the smallest id is compared. Texts that
    are null or have no words have no shingles and no links. Rows that share an id are one document with several texts:
    all of them are compared, and the id is linked to whatever any of them is linked to.

    Candidates share prefix tokens under several global token orders: first by hash, which needs no counting, then by
    document frequency among what is left, then by two more hashes. All pairs that pass are decided by their whole sets.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _of_repeated(rows)
    # Prefixes are made once more where they are needed: that takes less than to keep them.
    first = saved(rows.mapInArrow(_class_keys, "doc_id long, set_key binary, n long"), "first")
    reps = rows.mapInArrow(_prefixes, "doc_id long, set_key binary, n long, prefix array<long>").where("n > 0").groupBy("set_key", "n").agg(F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"))
    found = _links(rows, reps)
    classes = saved(first.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = first.select("doc_id", "set_key", "n").join(classes, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    if found is None:
        return members.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    comps = saved(components(*found), "components").where("doc_id <> comp").select(F.col("doc_id").alias("rep"), "comp")
    return members.join(comps, "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
