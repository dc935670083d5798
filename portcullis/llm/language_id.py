"""Language identification with hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: Rows of the letter memory: 0 separates words, 1-26 are a-z, 27-59 the letters U+00DF-U+00FF, the rest is shared by hash.
LETTERS = 128
SEED = 11


@lru_cache(1)
def letter_rows() -> np.ndarray:
    """The memory row of every code point."""
    rows = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    rows[letters] = 60 + (letters * 2654435761 >> 7) % (LETTERS - 60)
    rows[ord("a") : ord("z") + 1] = np.arange(1, 27)
    latin = letters[(letters >= 0xDF) & (letters <= 0xFF)]
    rows[latin] = 27 + latin - 0xDF
    return rows


@lru_cache(1)
def memory() -> tuple[np.ndarray, np.ndarray]:
    """Random letter vectors of -1 and 1, and for every pair of letters the bound vector of its permuted letters."""
    vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (LETTERS, DIMENSIONS))
    vectors[0] = np.random.default_rng(SEED + 1).choice(np.array([-1, 1], np.float32), DIMENSIONS)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    pairs = (first[:, None, :] * second[None, :, :]).astype(np.int8)
    return vectors, pairs.reshape(LETTERS * LETTERS, DIMENSIONS)


def symbols(text: str | None) -> np.ndarray:
    """Memory rows of a whole text, runs of other characters as one separator; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = letter_rows()[points].astype(np.int64)
    if not rows.any():
        return np.zeros(0, np.int64)
    rows = rows[(rows > 0) | np.r_[True, rows[:-1] > 0]]
    return np.concatenate([[0] * bool(rows[0]), rows, [0] * bool(rows[-1])]).astype(np.int64)


def bundle(rows: np.ndarray) -> np.ndarray:
    """The sum of the vectors of all trigrams: a pair's vector is bound with the bundle of the letters that follow it."""
    vectors, pairs = memory()
    if len(rows) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    codes, counts = np.unique(rows[:-2] * LETTERS * LETTERS + rows[1:-1] * LETTERS + rows[2:], return_counts=True)
    pair, at = np.unique(codes // LETTERS, return_inverse=True)
    total = np.zeros(DIMENSIONS, np.float32)
    for begin in range(0, len(pair), 1024):  # bounded memory, whatever the alphabet
        inside = (at >= begin) & (at < begin + 1024)
        follow = np.zeros((min(1024, len(pair) - begin), LETTERS), np.float32)
        follow[at[inside] - begin, codes[inside] % LETTERS] = counts[inside]
        total += np.einsum("pd,pd->d", pairs[pair[begin : begin + 1024]].astype(np.float32), follow @ vectors)
    return total


def prototypes(docs: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """One vector per language: the bundle of all trigrams of all its texts, as learned from every row of docs.

    Rows without text or language are left out. Each task sums its texts by language, Spark adds these sums up by
    language and dimension; the driver gets one vector for each language.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (rows := symbols(whole)).size:
                    found[name] = found.get(name, 0) + bundle(rows).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = rows.mapInArrow(sums, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("dimension", "value"))
    totals = parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value")).toPandas()
    return {k: g.sort_values("dimension").value.to_numpy() for k, g in sorted(totals.groupby("lang"))}


def identify(df: DataFrame, text: str, profiles: dict[str, np.ndarray]) -> DataFrame:
    """All columns of df, with lang_pred and score in place of columns of these names.

    lang_pred is the language whose prototype has the largest cosine with the text's bundle (of equal ones the first by
    name); score is the share that this cosine has among all, sharpened. Both vectors have the mean prototype's
    direction taken out, as all languages share it. Texts that are null or have no letter are "und" with score 0;
    without any profile all texts are.
    """
    names = list(profiles)
    matrix = np.array([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-9) for n in names]).reshape(len(names), DIMENSIONS)
    common = matrix.mean(axis=0) if names else np.zeros(DIMENSIONS)
    common = common / max(np.linalg.norm(common), 1e-9)
    if len(names) > 1:
        matrix = matrix - np.outer(matrix @ common, common)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    shared = df.sparkSession.sparkContext.broadcast((names, matrix.astype(np.float32), common.astype(np.float32)))

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts):
        import pandas as pd

        names, matrix, common = shared.value
        out = []
        for whole in texts:
            rows = symbols(whole)
            if not rows.size or not names:
                out.append(("und", 0.0))
                continue
            vector = bundle(rows)
            if len(names) > 1:
                vector = vector - (vector @ common) * common
            cosines = matrix @ vector / max(float(np.linalg.norm(vector)), 1e-9)
            best = int(np.argmax(cosines))
            sharp = np.exp(10 * (cosines - cosines[best]))
            out.append((names[best], float(1 / sharp.sum())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return df.drop("lang_pred", "score").withColumn("_judged", judged(F.col(text))).select("*", "_judged.lang_pred", "_judged.score").drop("_judged")
