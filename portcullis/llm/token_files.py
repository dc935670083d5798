"""Token ids in files of word-aligned blocks: encoding of texts, packing, writing, reading."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Selector s of a 64-bit word: the top four bits; the rest holds COUNTS[s] ids of BITS[s] bits each, the first one lowest.
#: Selector 0 marks an escape: its word holds the place of one larger id in the block's list of escapes.
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
#: Ids of a sub-block, whose words begin at a stored offset, so that it can be decoded by itself.
SUB = 512
#: A block ends with the document that brings it to so many ids.
BLOCK = 1 << 18

BLOCK_SCHEMA = "part int, block int, first_id long, doc_ids array<long>, doc_sizes array<long>, offsets array<int>, words binary, escapes binary"

# Whole pre-tokens end between two such characters, so pieces are encoded alike alone and within their text.
_PIECES = re.compile(r"(?<=\S) (?=\S)")
# A space next to other white space, where that does not hold for all spaces.
_RUNS = re.compile(r" \s|[^\S ] ")
_CACHE_PIECES = 1_000_000
_state: dict = {}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the sub-blocks and escapes of unsigned 64-bit ids.

    Each word takes as many ids as fit. All sub-blocks are packed side by side, one word of each at a time.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int32), np.zeros(0, np.uint64)
    subs = -(-n // SUB)
    left = np.minimum(SUB, n - np.arange(n) // SUB * SUB) - np.arange(n) % SUB
    # How many bits each id needs; the largest need among the next c ids shows which selectors fit at a place.
    need = np.searchsorted(np.array([1 << int(b) for b in BITS[1:]], dtype=np.uint64), ids, side="right") + 1
    best = np.where(need > 14, 0, 14)
    places = np.flatnonzero(need <= 14)
    most = need[places]
    for c in range(2, 61):
        # Where the next c ids do not fit in a word, no more of them do. A selector must have room for c of them.
        inside = left[places] >= c
        places, most = places[inside], most[inside]
        most = np.maximum(most, need[places + c - 1])
        fits = (most <= 14) & (COUNTS[np.minimum(most, 14)] >= c)
        places, most = places[fits], most[fits]
        if not len(places):
            break
        exact = np.flatnonzero(COUNTS == c)
        if len(exact):
            best[places] = exact[0]
    taken = COUNTS[best]
    at, ends, starts, order = np.arange(subs) * SUB, np.minimum(n, np.arange(1, subs + 1) * SUB), [], []
    active = np.arange(subs)
    while len(active):
        starts.append(at[active])
        order.append(active)
        at[active] += taken[at[active]]
        active = active[at[active] < ends[active]]
    starts, order = np.concatenate(starts), np.concatenate(order)
    starts = starts[np.argsort(order, kind="stable")]
    offsets = np.r_[0, np.cumsum(np.bincount(order, minlength=subs))].astype(np.int32)
    words = best[starts].astype(np.uint64) << np.uint64(60)
    escapes = ids[starts[best[starts] == 0]]
    words[best[starts] == 0] |= np.arange(len(escapes), dtype=np.uint64)
    for s in range(1, len(BITS)):
        mine = np.flatnonzero(best[starts] == s)
        for k in range(COUNTS[s] if len(mine) else 0):
            words[mine] |= ids[starts[mine] + k] << np.uint64(k * BITS[s])
    return words, offsets, escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a block, or of the words of one sub-block with the block's escapes."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    begins = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selectors):
        mine = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            ids[begins[mine] + k] = (words[mine] >> np.uint64(k * BITS[s])) & mask
        if s == 0:
            ids[begins[mine]] = escapes[ids[begins[mine]].astype(np.int64)]
    return ids


def cut_text(text: str) -> list[str]:
    """The pieces of a text between single spaces that stand between other characters; most texts have no other spaces."""
    if text[:1] == " " or text[-1:] == " " or _RUNS.search(text):
        return _PIECES.split(text)
    return text.split(" ")


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts (null: empty) by the tokenizers library, special tokens as it finds them in the text.

    A text is cut at single spaces between other characters; the library encodes each distinct piece once, and a
    worker remembers a bounded number of pieces.
    """
    if _state.get("path") != path:
        # A task has one core; the library's threads would only wait for each other there.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _state.update(path=path, tokenizer=tokenizer, cache={})
    if len(_state["cache"]) > _CACHE_PIECES:
        _state["cache"] = {}
    cache = _state["cache"]
    encode = lambda part: [array("I", x.ids).tobytes() for x in _state["tokenizer"].encode_batch_fast(part, add_special_tokens=False)]
    # The first piece of a text has no space before it; the others are remembered without theirs.
    cuts = [cut_text(text or "") for text in texts]
    firsts = encode([cut[0] for cut in cuts])
    rests = [cut[1:] for cut in cuts]
    missing = list(set(chain.from_iterable(rests)).difference(cache))
    for begin in range(0, len(missing), 50_000):
        part = missing[begin : begin + 50_000]
        cache.update(zip(part, encode([" " + piece for piece in part]), strict=True))
    return [np.frombuffer(first + b"".join(map(cache.__getitem__, rest)), np.uint32) for first, rest in zip(firsts, rests, strict=True)]


def blocks_of(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Packed blocks (BLOCK_SCHEMA) of all texts, end_id behind each, in ascending order of the ids of the documents.

    Texts are dealt out by ranges of the document id, so partitions and the blocks in them follow its order. A null id
    comes first; rows that share an id stay together in the order of their texts; a null or empty text has end_id
    alone. No block holds more than BLOCK ids, but for the rest of its last document. first_id counts ids within the
    partition ("part").
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Long texts take longer, so ranges are cut by the id and, for equal ids, the text.
    keys = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, written = TaskContext.get().partitionId(), 0, 0
        names, ids, held = [], [], 0

        def emit() -> pa.RecordBatch:
            words, offsets, escapes = pack(np.concatenate(ids))
            values = [[part], [block], [written], [names], [[len(x) for x in ids]], [offsets.tolist()], [words.astype("<u8").tobytes()], [escapes.astype("<u8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["part", "block", "first_id", "doc_ids", "doc_sizes", "offsets", "words", "escapes"])

        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.slice(begin, 256)
                for name, own in zip(some.column(0).to_pylist(), encode_texts(some.column(1).to_pylist(), tokenizer_path), strict=True):
                    names.append(name)
                    ids.append(np.append(own, np.uint32(end_id)))
                    held += len(ids[-1])
                    if held >= BLOCK:
                        yield emit()
                        block, written, names, ids, held = block + 1, written + held, [], [], 0
        if names:
            yield emit()

    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(pack_part, BLOCK_SCHEMA)


def write_files(blocks: DataFrame, path: str) -> None:
    """Writes the blocks, a file for each partition, in order; Spark's writer replaces the files of lost tasks."""
    blocks.write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at path: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The checksum is taken of the decoded ids as little-endian unsigned 32-bit integers. Only one number for each file
    is ordered over all, to find where its ids begin.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8")).astype("<u4")
                at = 0
                for name, size in zip(row["doc_ids"], row["doc_sizes"], strict=True):
                    out.append((row["part"], name, row["first_id"] + at, size, zlib.crc32(ids[at : at + size])))
                    at += size
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = blocks.select("part", "first_id", "doc_ids", "doc_sizes", "words", "escapes").mapInArrow(decode, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", F.expr("aggregate(doc_sizes, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
