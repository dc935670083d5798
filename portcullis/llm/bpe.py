"""Byte-level BPE by dynamic programming over prefixes: exact ids and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which this kind of tokenizer splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A worker remembers so many encoded words, and as many tested pairs, at most, then begins anew.
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in this kind of vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a tokenizer file, with an automaton that finds every token ending at each place."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in name) for name, i in ids.items()}
        self.bytes |= {i: name.encode() for name, i in self.special.items()}
        self.length = {i: len(b) for i, b in self.bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}  # of a pair that merges
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # the pair that a token is first made of
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            self.merged[ids[left], ids[right]] = made
            self.parts.setdefault(made, (ids[left], ids[right]))
        self.made_at = {t: self.rank[p] for t, p in self.parts.items()}
        # Tokens that merging never makes cannot be in a result.
        single = {i for i, b in self.bytes.items() if len(b) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in ids.values():
            if i in single or i in self.parts:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two.

        Walks back through the merges that made them, the latest first. Each pair that then met at the border must not
        have merged before the later of the two steps that changed it.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, fits = left, right, float("inf"), True
        while True:
            if (rank := self.rank.get((a, b))) is not None and rank < limit:
                fits = False
                break
            made_a, made_b = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            # Undo the later merge; at equal ranks the left one comes first, so the right one is undone before it.
            if made_a > made_b:
                limit, a = made_a, self.parts[a][1]
            else:
                # The pair at the border stands left of this merge and would win against it at the same rank.
                limit, b = made_b + 1, self.parts[b][0]
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word: for each prefix the one token that its encoding ends with, then back from the end."""
        data = word.encode()
        last, length, compatible = [-1] * (len(data) + 1), self.length, self.compatible
        # Matches come by their ends, the longest of each end first.
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - length[token]
                if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end + 1] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens' texts are their ids."""
        words, out = self.words, []
        if len(words) > CACHE:
            words.clear()
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for word in self.split.findall(part):
                got = words.get(word)
                if got is None:
                    got = np.array(self.encode_word(word), "<u4").tobytes()
                    words[word] = got
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _map(df: DataFrame, column: Column, kind: str, arrow: pa.DataType, name: str, one) -> DataFrame:
    @F.arrow_udf(kind)
    def mapped(values: pa.Array) -> pa.Array:
        return pa.array([one(v) for v in values.to_pylist()], arrow)

    return df.withColumn(name, mapped(column))


def encode(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """All columns of df, with the ids of the whole text as little-endian unsigned 32-bit integers in column out.

    Null and empty texts have no ids. Only tokenizer files of the byte-level kind, read on each worker from path.
    """
    return _map(df, F.col(text), "binary", pa.binary(), out, lambda v: vocabulary(path).encode(v) if v else b"")


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """All columns of df, with the text of the ids in column out; null ids give an empty text."""
    return _map(df, F.col(ids), "string", pa.string(), out, lambda v: vocabulary(path).decode(v) if v else "")


def round_trip(df: DataFrame, text: str, path: str) -> DataFrame:
    """All columns of df, with n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the text they give.

    Ids and decoded texts stay inside the worker, so that only digests travel back.
    """
    import hashlib

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.arrow_udf(schema)
    def digests(values: pa.Array) -> pa.Array:
        book, rows = vocabulary(path), []
        for value in values.to_pylist():
            ids = book.encode(value or "")
            rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(book.decode(ids).encode()).hexdigest()})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return df.drop(*names).withColumn("_digests", digests(F.col(text))).select("*", *(f"_digests.{n}" for n in names)).drop("_digests")
