"""Document fingerprints from the terms of a middle band of document frequency, over several random lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.llm.common import let, saved

#: Terms are kept that occur in more than LEAST and at most MOST of all documents. As each document has few terms on
#: average, the share LEAST bounds how many terms the lexicon can hold, whatever the number of documents.
LEAST, MOST = 0.001, 0.2
#: Random lexicons are dealt out in groups: in each group a term is in one lexicon, told by bits of its hash that no other
#: group reads. Lexicons of different groups overlap, and a term is in each one with a chance of 1 in 2 ** BITS.
GROUPS, BITS = 2, 7
#: Lists of the lookup table of terms.
LISTS = 1 << 14
#: Rows between two places where the order of ids is cut, and the most such places.
RUN_ROWS, MOST_RUNS = 1024, 1 << 16


def terms_of(text: Column) -> Column:
    """Hashes of the distinct terms (lower-cased, between white space and ASCII punctuation) of a whole text; null has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str, least: float = LEAST, most: float = MOST) -> DataFrame:
    """One row with the band's terms, in lists by the low bits of their hashes: a lookup reads one short list.

    Frequencies are counted over all documents; a term needs two documents at least.
    """
    total = docs.select(F.count(F.lit(1)).alias("n")).first()["n"]
    counted = docs.select(F.explode(terms_of(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counted.where((F.col("n") >= max(2, int(least * total))) & (F.col("n") <= max(2, int(most * total)))).select("term")
    lists = band.groupBy(F.col("term").bitwiseAND(LISTS - 1).cast("int").alias("list")).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    empty = F.array().cast("array<bigint>")
    # Lists without terms are filled in, so that the place of a list is its number.
    every = docs.sparkSession.range(LISTS).select(F.col("id").cast("int").alias("list")).join(lists, "list", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("list", F.coalesce("terms", empty).alias("terms")))), lambda x: x["terms"]).alias("lists"))


def fingerprint(text: Column, lists: Column) -> Column:
    """A text's fingerprint: (digest, parts).

    The digest is the hash of its sorted distinct terms in the whole lexicon, or of all its terms where it has none there.
    Parts has for each random lexicon with terms of the text its number (high bits) and 16 bits of the hash of these
    terms. Equal texts have equal fingerprints.
    """

    def group(terms: Column, g: int) -> Column:
        # Shifted, a group's bits are the highest ones, so in sorted terms each lexicon's lie together.
        cell = lambda t: (F.shiftright(t, 64 - BITS) + (1 << BITS - 1)).cast("int")

        def parts(some: Column, begins: Column) -> Column:
            own = lambda b, i: F.slice(some, b, F.coalesce(F.get(begins, i + 1), F.size(some) + 1) - b)
            number = lambda b: cell(F.get(some, b - 1)) + (g << BITS)
            return F.transform(begins, lambda b, i: F.shiftleft(number(b), 16).bitwiseOR(F.xxhash64(own(b, i)).bitwiseAND(0xFFFF).cast("int")))

        def runs(some: Column) -> Column:
            places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(some), F.lit(1))), lambda i: i <= F.size(some))
            return F.filter(places, lambda i: (i == 1) | (cell(F.get(some, i - 1)) != cell(F.get(some, i - 2))))

        shifted = F.array_sort(F.transform(terms, lambda t: F.shiftleft(t, g * BITS)))
        return let(shifted, lambda some: let(runs(some), lambda begins: parts(some, begins)))

    def of(terms: Column) -> Column:
        kept = F.filter(terms, lambda t: F.array_contains(F.get(lists, t.bitwiseAND(LISTS - 1).cast("int")), t))
        return let(
            let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(terms)),
            lambda k: F.struct(F.xxhash64(F.array_sort(k)).alias("digest"), F.concat(*(group(k, g) for g in range(GROUPS))).alias("parts")),
        )

    return let(terms_of(text), of)


def as_text(found: Column) -> Column:
    """A fingerprint as a text: 16 hexadecimal digits of the digest, a dot, six for each part (two of them its lexicon)."""
    digits = lambda n, size: F.lpad(F.lower(F.hex(n)), size, "0")
    return F.concat(digits(found["digest"], 16), F.lit("."), F.array_join(F.transform(found["parts"], lambda p: digits(p, 6)), ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal digests, else the share of equal parts among the random lexicons that either text has terms in."""
    numbers = lambda c: F.transform(c["parts"], lambda p: F.shiftright(p, 16))
    either = F.size(F.array_union(numbers(a), numbers(b)))
    share = F.when(either > 0, F.size(F.array_intersect(a["parts"], b["parts"])) / either).otherwise(F.lit(0.0))
    return F.when(a["digest"] == b["digest"], F.lit(1.0)).otherwise(share).cast("double")


def with_fingerprints(docs: DataFrame, text: str, lists: DataFrame, out: str = "fingerprint") -> DataFrame:
    """All columns of docs and the fingerprint of the text; lists: what lexicon() returns, saved.

    The lexicon is the value of a scalar subquery, which each task holds once; it never becomes part of the rows.
    """
    return docs.withColumn("_lists", lists.scalar()).withColumn(out, fingerprint(F.col(text), F.col("_lists"))).drop("_lists")


def with_next(docs: DataFrame, key: str, more: list[str], rows: int = RUN_ROWS) -> DataFrame:
    """docs with next_<name> for each name of more: the values of the next row by descending key, for the last row the first's.

    Keys are whole numbers, distinct and not null. The order is cut into runs at quantiles of the keys, so a run is a
    window of about so many rows, and each row moves once, the first row of a run twice: it also ends the run before.
    Where the cuts lie has no effect on the result.
    """
    cuts = _cuts(docs, key, rows)
    run = _run(F.col(key), F.col("_cuts"))
    placed = lambda df: df.withColumn("_cuts", cuts.scalar()).withColumn("_run", run).drop("_cuts")
    # One row for each run: its largest key and the run that comes before it in descending order.
    largest = placed(docs.select(key)).groupBy("_run").agg(F.max(key).alias("_largest"))
    before = F.coalesce(F.lead("_run").over(Window.partitionBy(F.lit(0)).orderBy("_run")), F.min("_run").over(Window.partitionBy(F.lit(0))))
    heads = F.broadcast(largest.select("_largest", before.alias("_before")))
    rows_ = placed(docs).join(heads, F.col(key) == F.col("_largest"), "left")
    place = lambda run, ends: F.struct(F.col(run).alias("run"), F.lit(ends).alias("ends"))
    twice = F.when(F.col("_before").isNull(), F.array(place("_run", False))).otherwise(F.array(place("_run", False), place("_before", True)))
    order = Window.partitionBy("_place.run").orderBy("_place.ends", F.col(key).desc())
    following = F.lead(F.struct(*more)).over(order)
    out = rows_.withColumn("_place", F.explode(twice)).withColumn("_next", following).where("not _place.ends")
    return out.select(*docs.columns, *(F.col(f"_next.{name}").alias(f"next_{name}") for name in more))


def _cuts(docs: DataFrame, key: str, rows: int) -> DataFrame:
    """One row with the ascending keys that cut the order into runs, in lists of 256; saved, as quantiles may vary by run."""
    runs = max(1, min(-(-docs.count() // rows), MOST_RUNS))
    shares = [i / runs for i in range(1, runs)] or [0.5]
    found = docs.agg(F.array_sort(F.array_distinct(F.percentile_approx(key, shares, max(10_000, 20 * runs)))).alias("cuts"))
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / 256).cast("int")), lambda c: F.slice("cuts", c * 256 + 1, 256))
    return saved(found.select(lists.alias("cuts")), "cuts")


def _run(key: Column, cuts: Column) -> Column:
    """The number of cuts at or below the key."""
    below = lambda some: F.size(F.filter(some, lambda c: c <= key))
    full = F.size(F.filter(cuts, lambda some: some[0] <= key)) - 1
    return F.when(full < 0, 0).otherwise(full * 256 + below(F.get(cuts, full)))
