"""The registered fingerprint query against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from portcullis.llm import fingerprints
from portcullis.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fingerprint string, n_chars int"


def ask(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["op10_imatch"](spark, str(tmp_path)).collect()


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def by_hand(one, two):
    """The share of equal parts among the lexicons that either fingerprint has; 1 for equal ones."""
    if one[:16] == two[:16]:
        return 1.0
    a, b = ({p[:2]: p[2:] for p in re.findall("......", t[17:])} for t in (one, two))
    return sum(a.get(k) == b.get(k) for k in a | b) / len(a | b) if a | b else 0.0


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_every_document_meets_the_next(spark, tmp_path):
    rows = [(3 * i, t, "x", 1) for i, t in enumerate(texts(60, 1))] + [(1, None, "x", 1), (2, "", "x", 1), (4, "é😀ß", "x", 1), (1000, "w1 " * 20_000, "x", 1), (1001, "w1 w2 w3", "x", 1), (1002, "w1 w2 w3", "x", 1)]
    got = {r.doc_id: r for r in ask(spark, tmp_path, rows)}
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, text), (j, following) in zip(order, order[1:] + order[:1], strict=True):
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
        assert abs(r.near_next - by_hand(r.fingerprint, got[j].fingerprint)) < 1e-9 and abs(r.near_edited - by_hand(r.fingerprint, r.edited_fingerprint)) < 1e-9
    assert got[1001].fingerprint == got[1002].fingerprint and got[1002].near_next == 1.0


def test_one_row_for_each_row(spark, tmp_path):
    """Ids that repeat and ids that are missing."""
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, "d e f g", "x", 1), (2, "d e f g", "x", 1), (2, "d e f g", "x", 1), (None, "h i j k", "x", 1), (3, "l m", "x", 1)]
    got = ask(spark, tmp_path, rows)
    order = ["l m", "d e f g", "d e f g", "d e f g", "a b c", "a b c", "h i j k"]
    want = sorted(hashlib.sha256(edited(a, b).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got) == want and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


def test_no_documents_and_one(spark, tmp_path):
    assert ask(spark, tmp_path / "none", []) == []
    (one,) = ask(spark, tmp_path / "one", [(5, "w1 w2", "x", 1)])
    assert one.edited_sha256 == hashlib.sha256(edited("w1 w2", "w1 w2").encode()).hexdigest() and one.near_next == 1.0


def test_next_rows_by_short_runs(spark):
    """Runs of three rows, keys in clumps; the last row is followed by the first."""
    keys = [*range(-40, 0), *range(10**12, 10**12 + 60), 5, 700, 2**60]
    docs = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").repartition(5)
    order = sorted(keys, reverse=True)
    want = {k: f"t{n}" for k, n in zip(order, order[1:] + order[:1], strict=True)}
    for rows in (3, 1, 1000):
        assert {r.doc_id: r.next_text for r in fingerprints.with_next(docs, "doc_id", ["text"], rows).collect()} == want
    assert fingerprints.with_next(docs.limit(0), "doc_id", ["text"]).columns == ["doc_id", "text", "next_text"]


def test_parts_equal_brute_force(spark):
    """Each random lexicon's hash is that of its terms alone."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(50, 7))], "doc_id long, text string")
    lists = fingerprints.saved(fingerprints.lexicon(docs, "text", 0.02, 0.9), "lexicon")
    kept = {t for r in lists.collect() for some in r.lists for t in some}
    found = fingerprints.with_fingerprints(docs, "text", lists).withColumn("terms", fingerprints.terms_of(F.col("text"))).collect()
    signed = lambda n: (n + 2**63) % 2**64 - 2**63
    for r in found:
        terms, want = [t for t in r.terms if t in kept] or r.terms, {}
        for g in range(fingerprints.GROUPS):
            for t in terms:
                moved = signed(t << g * fingerprints.BITS)
                want.setdefault((moved >> 64 - fingerprints.BITS) + 2 ** (fingerprints.BITS - 1) + (g << fingerprints.BITS), []).append(moved)
        assert [p >> 16 for p in r.fingerprint.parts] == sorted(want)
        sets = spark.createDataFrame([(k, sorted(v)) for k, v in want.items()], "k int, v array<bigint>")
        assert {x.k: x.h for x in sets.select("k", F.xxhash64("v").bitwiseAND(0xFFFF).alias("h")).collect()} == {p >> 16: p & 0xFFFF for p in r.fingerprint.parts}
        if r.doc_id > 5:
            break
