"""Benchmark passages in training documents, found by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import ascii_lower, let, once, saved, small

#: Words of a window that counts as a hit, and words of the grams that are hashed.
WINDOW, GRAM = 10, 5
#: Any WINDOW shared words hold so many grams, of which both sides keep the one with the smallest hash.
KEEP = WINDOW - GRAM + 1


def words_of(text: Column) -> Column:
    """Words of a whole text: runs of a-z (A-Z lower-cased), digits and all non-ASCII characters; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(words: Column, size: int) -> Column:
    """Hashes of all grams of size words, in order."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) < size, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(size))))
        ),
    )


def _winnowed(words: Column) -> Column:
    """(hash, place) of the grams that are the smallest of some KEEP successive grams; places count words from 0."""
    return let(
        _grams(words, GRAM),
        lambda g: let(
            F.when(F.size(g) < KEEP, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.size(g) - KEEP), lambda i: F.least(*(F.get(g, i + k) for k in range(KEEP))))
            ),
            lambda low: F.filter(
                F.transform(g, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))),
                # Beyond either end of low there is nothing, and null is no match.
                lambda x: F.coalesce(F.greatest(*(F.coalesce(F.get(low, x["place"] - k) == x["hash"], F.lit(False)) for k in range(KEEP))), F.lit(False)),
            ),
        ),
    )


def _pieces(df: DataFrame, key: str, text: str, short_sizes: list[int]) -> DataFrame:
    """Rows (key, words, size, hash, place): winnowed grams with size 0, and all grams of each short size."""
    rows = once(df, key=F.col(key), words=words_of(F.col(text)))
    kinds = [F.transform(_winnowed(F.col("words")), lambda x: F.struct(F.lit(0).alias("size"), x["hash"].alias("hash"), x["place"].alias("place")))]
    for n in short_sizes:
        grams = F.transform(_grams(F.col("words"), n), lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
        kinds.append(F.transform(grams, lambda g: F.struct(F.lit(n).alias("size"), g["hash"].alias("hash"), g["place"].alias("place"))))  # noqa: B023  called at once
    return rows.select("key", "words", F.explode(F.concat(*kinds)).alias("piece")).select("key", "words", "piece.*")


def hits(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """Rows (doc_id, item_id, start, length): every place where a window of an item occurs in a document.

    A window is WINDOW successive words of an item, or all words of an item that has fewer. Documents and items keep
    the smallest gram hash of any KEEP successive ones; equal hashes meet, and each meeting is extended over the words
    around it, which are compared as words. So every shared window is found and nothing else. Items with fewer words
    are looked up by the hash of the whole item among all grams of that size. The items' pieces are broadcast while
    they are few; else both sides are joined by the hash. Null ids or texts without words have no hits; equal rows give
    equal hits.
    """
    benchmark = once(items.where(F.col(item_id).isNotNull()), item=F.col(item_id), words=words_of(F.col(item_text))).where(F.size("words") > 0)
    sizes = sorted(r[0] for r in benchmark.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # at most nine
    shorter = F.size("words") < WINDOW
    long_ones = benchmark.where(~shorter).select("item", "words", F.explode(_winnowed(F.col("words"))).alias("piece")).select("item", "words", F.lit(0).alias("size"), "piece.*")
    short_ones = [
        benchmark.where(F.size("words") == n).select("item", "words", F.lit(n).alias("size"), _grams(F.col("words"), n)[0].alias("hash"), F.lit(0).alias("place")) for n in sizes
    ]
    pieces = long_ones
    for more in short_ones:
        pieces = pieces.unionByName(more)
    # Words around a gram: those of all windows that hold it; absent words stay null.
    around = lambda words, place: F.transform(F.sequence(place - (KEEP - 1), place + (WINDOW - 1)), lambda i: F.get(words, i))
    known = saved(pieces.select("item", "size", "hash", F.when(F.col("size") > 0, F.col("words")).otherwise(around(F.col("words"), F.col("place"))).alias("item_words")).distinct(), "items")
    found = _pieces(docs.where(F.col(doc_id).isNotNull()), doc_id, text, sizes).join(small(known, 200_000), ["size", "hash"])
    own = F.when(F.col("size") > 0, F.slice("words", F.col("place") + 1, F.greatest("size", F.lit(1)))).otherwise(around(F.col("words"), F.col("place")))
    met = found.select("key", "item", "size", "place", own.alias("own"), "item_words")
    whole = F.when(F.col("own") == F.col("item_words"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    # A window agrees if all its words are there and equal; null == null is no agreement.
    windows = F.filter(
        F.sequence(F.lit(0), F.lit(KEEP - 1)),
        lambda k: F.forall(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda j: F.coalesce(F.get(F.col("own"), k + j) == F.get(F.col("item_words"), k + j), F.lit(False))),
    )
    starts = F.when(F.col("size") > 0, whole).otherwise(F.transform(windows, lambda k: k - (KEEP - 1)))
    return met.select(
        F.col("key").alias("doc_id"),
        F.col("item").alias("item_id"),
        "place",
        F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(WINDOW)).alias("length"),
        F.explode(starts).alias("shift"),
    ).select("doc_id", "item_id", (F.col("place") + F.col("shift")).cast("int").alias("start"), "length")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """Per document (one row for each distinct id): doc_id, n_words, n_hit (words in any hit), n_items, items_sha256, contaminated.

    Documents with a null id are left out of the hits and reported with none. Where an id repeats, its hits count for
    each of its rows.
    """
    found = hits(docs, items, doc_id, text, item_id, item_text).distinct()
    by_start = found.groupBy("doc_id", "start").agg(F.max("length").alias("length"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    spans = by_start.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"].cast("long")))).cast("long").alias("n"),
            F.greatest(acc["end"], (s["start"] + s["length"]).cast("long")).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    summary = saved(
        spans.select("doc_id", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "hits"
    )
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    return counted.join(summary, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
