"""Legacy archives, hard negatives and lexical search against brute force, also through the registered queries."""

import gzip
import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, duck
from portcullis.llm import hard_negatives, lexical_search, warc
from portcullis.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lexical_search", "op13_arc_to_warc"])
def test_queries_agree_with_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), duck(SMALL), ORACLES[name]) is None


def written(spark, tmp_path, tables):
    """A folder with these tables: {name: (rows, schema)}."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# Archives

PAGES = "page_id long, url string, html string, payload string, record_key int, file string"


def page_rows():
    long = "<p>" + "long é😀 " * 400_000
    copy = "<html>" + "c" * 200
    texts = [None, "", "x", "x" * 99, "x" * 99, "y" * 100, "y" * 100, copy, copy, copy, long, long, "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n", "filedesc://x 1 2\n"]
    urls = [None, "", "http://a b/c\n", "https://é.example/?q=1 2", "filedesc://no 0.0.0.0 20240101000000 text/plain 5", "dns:a"]
    rows = [(i, urls[i % len(urls)], t, "clash", 1, "clash") for i, t in enumerate(texts)]
    return rows + [(7, "http://twice", copy, None, None, None), (None, "http://none", copy, None, None, None), (None, None, None, None, None, None)]


def expected_pages(rows):
    """What the contract asks for, by hand; equal ids with equal payloads: one of them is the response."""
    firsts, out = {}, Counter()
    described = [(i, (t or "").encode()) for i, _, t, *_ in rows]
    for i, body in sorted(described, key=lambda r: (r[0] is None, r[0] or 0)):
        first = firsts.setdefault(body, i) if len(body) >= 100 else None
        again = len(body) >= 100 and out[("seen", body)] > 0
        out[("seen", body)] += 1
        out[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    return Counter({k: v for k, v in out.items() if k[0] != "seen"})


def test_archives_keep_every_page(spark, tmp_path):
    rows = page_rows()
    sf = written(spark, tmp_path, {"pages": (rows, PAGES)})
    got = Counter(tuple(r) for r in QUERIES["op13_arc_to_warc"](spark, sf).collect())
    assert got == expected_pages(rows)
    empty = written(spark, tmp_path / "empty", {"pages": ([], PAGES)})
    assert QUERIES["op13_arc_to_warc"](spark, empty).count() == 0


def test_archives_by_shuffled_revisits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    rows = page_rows()
    sf = written(spark, tmp_path, {"pages": (rows, PAGES)})
    assert Counter(tuple(r) for r in QUERIES["op13_arc_to_warc"](spark, sf).collect()) == expected_pages(rows)


def test_files_are_readable_gzip_archives(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    warc.write_arc(pages, "page_id", "url", "html", f"{tmp_path}/arc")
    warc.write_warc(warc.converted(spark, f"{tmp_path}/arc"), f"{tmp_path}/warc")
    for kind, first in (("arc", b"filedesc://"), ("warc", b"WARC/1.1\r\nWARC-Type: warcinfo")):
        files = [f"{tmp_path}/{kind}/{f}" for f in os.listdir(f"{tmp_path}/{kind}") if f.startswith("part")]
        assert files and all(gzip.open(f).read().startswith(first) for f in files)
    back = warc.read_warc(spark, f"{tmp_path}/warc")
    assert back.where("problem is not null").count() == 0
    bodies = sorted(bytes(r.payload) for r in back.where("warc_type = 'response'").collect())
    # Short payloads are all kept, of longer ones one each.
    texts = [(t or "").encode() for _, _, t, *_ in page_rows()]
    assert bodies == sorted([t for t in texts if len(t) < 100] + list({t for t in texts if len(t) >= 100}))


def test_both_versions_of_the_header(spark, tmp_path):
    """Plain files by hand: fields as the file names them, urls with spaces, short bodies and lines that are no header."""
    body = b"HTTP/1.0 404 Not Found\nContent-Type: text/html\n\nhello"
    one = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 77\n1 0 old\nURL IP-address Archive-date Content-type Archive-length\n" + b"x" * 9 + b"\n"
    opening = one[: one.index(b"\n") + 1].replace(b"77", b"%d" % (len(one) - one.index(b"\n") - 1)) + one[one.index(b"\n") + 1 :]
    first = opening + b"\nhttp://a/b c 1.2.3.4 20010203040506 text/html %d\n" % len(body) + body + b"\nno header here\ndns:a 1.2.3.4 20010203040506 text/dns 3\nabc\n"
    fields = b"2 0 new\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    second = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc %d\n" % len(fields) + fields
    second += b"\nhttp://x/ 1.2.3.4 20010203 text/html 404 - - 7 b.arc 99\n" + body
    os.makedirs(tmp_path / "arc")
    (tmp_path / "arc/a.arc").write_bytes(first)
    (tmp_path / "arc/b.arc.gz").write_bytes(gzip.compress(second))
    rows = warc.read_arc(spark, f"{tmp_path}/arc").orderBy("file", "place").collect()
    assert [(r.version, r.warc_type, r.url, r.problem) for r in rows] == [
        (1, "warcinfo", "filedesc://a.arc", None),
        (1, "response", "http://a/b c", None),
        (1, None, None, "no header"),
        (1, "resource", "dns:a", None),
        (2, "warcinfo", "filedesc://b.arc", None),
        (2, "response", "http://x/", "truncated"),
    ]
    assert (rows[1].warc_date, rows[1].status, bytes(rows[1].payload), rows[1].ip) == ("2001-02-03T04:05:06Z", 404, b"hello", "1.2.3.4")
    assert rows[1].payload_digest == hashlib.sha256(b"hello").hexdigest() and rows[5].warc_date == "2001-02-03T00:00:00Z"
    assert len({r.record_id for r in rows}) == len(rows)
    warc.write_warc(warc.converted(spark, f"{tmp_path}/arc"), f"{tmp_path}/warc")
    back = {r.url: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert bytes(back["http://a/b c"].payload) == b"hello" and back["dns:a"].warc_type == "resource"


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score long, vector string"


def score_of(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))


def mined_by_hand(rows, positives=5, negatives=10):
    kept = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y, *_ in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for anchor, v, label in kept:
        if anchor % 100:
            continue
        scored = sorted((-score_of(v, w), i, y) for i, w, y in kept if i != anchor)
        for s, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out.update((anchor, positive, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit, 1))
    return out


def vector_rows(n=700, dims=8, seed=5):
    rng = random.Random(seed)
    made = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(dims)], rng.randrange(4), 0, "") for i in range(n)]
    return [(i, [float(f"{x:.3f}") for x in v], y, s, t) for i, v, y, s, t in made]


def odd_vectors():
    rows = vector_rows()
    rows += [(i + 1000, rows[0][1], i % 3, 0, "") for i in range(60)]  # many equal vectors, so ties
    rows += [(100, rows[5][1], 2, 0, ""), (200, rows[200][1], rows[200][2], 0, ""), (300, [], 1, 0, ""), (301, [1.0], 1, 0, ""), (400, [0.0] * 8, 1, 0, "")]
    nan = float("nan")
    return rows + [(None, rows[1][1], 1, 0, ""), (500, None, 1, 0, ""), (2, [nan] * 8, 1, 0, ""), (3, [None] * 8, 1, 0, ""), (4, [float("inf")] * 8, 1, 0, ""), (600, rows[3][1], None, 0, "")]


def mined(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in hard_negatives.mine(df, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0).collect())


def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch):
    rows = [(i, [float(x) for x in v] if v is not None else None, y, s, t) for i, v, y, s, t in vector_rows()]
    stored = [tuple(r) for r in spark.createDataFrame(rows, VECTORS).collect()]
    want = mined_by_hand(stored)
    assert len(want) > 100 and mined(spark, rows) == want
    # Small buckets, blocks of one or two anchors, and only one focus coordinate: same rows.
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    monkeypatch.setattr(hard_negatives, "FIRST", 4)
    monkeypatch.setattr(hard_negatives, "FOCUS", 1)
    assert mined(spark, rows) == want


def test_hard_negatives_of_odd_rows(spark):
    stored = [tuple(r) for r in spark.createDataFrame(odd_vectors(), VECTORS).collect()]
    assert mined(spark, odd_vectors()) == mined_by_hand(stored)
    assert not mined(spark, []) and not mined(spark, [(1, [1.0], 1, 0, "")]) and not mined(spark, [(100, [1.0], 1, 0, "")])


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    stored = [tuple(r) for r in spark.createDataFrame(vector_rows(), VECTORS).collect()]
    assert mined(spark, vector_rows()) == mined_by_hand(stored)


def test_coordinate_ranges_prune_and_lose_nothing():
    """In clusters, few rows are verified, and every row that scores enough is among the candidates."""
    np = hard_negatives.np
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = np.floor(256 * (centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.05)).astype(np.int64)
    bucket = hard_negatives.Bucket(np.arange(2000), np.zeros(2000, np.int64), vectors)
    wanted = hard_negatives.Search(np.array([-1]), np.array([0]), vectors[:1], [[(-(2**63), 2**63 - 1)]], 5, True)
    wanted.meet(bucket)
    first = wanted.verified
    wanted.meet(bucket)
    assert first == 2000 and wanted.verified - first < 500
    scores = vectors @ vectors[0]
    needed = int(np.sort(scores)[-50])
    cosines = bucket.least_cosines(wanted.lengths, np.array([needed - 0.5]))
    found = wanted.candidates(bucket, 0, wanted.spans(bucket, cosines))
    assert set(np.flatnonzero(scores >= needed)) <= set(found.tolist()) and len(found) < 1000


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100, [3e6, 1.0], 1, 0, ""), (101, [3e6, 0.5], 1, 0, ""), (102, [2e6, 0.25], 2, 0, ""), (103, [2e6, 0.254], 2, 0, "")]
    stored = [tuple(r) for r in spark.createDataFrame(rows, VECTORS).collect()]
    assert mined(spark, rows) == mined_by_hand(stored)


# Lexical search

DOCS = "doc_id long, text string, item_id string, score string, terms int"


def terms_by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def searched_by_hand(docs, items, k=20):
    counted = [(i, Counter(terms_by_hand(t))) for i, t, *_ in docs]
    n_docs, length = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        asked, scored = terms_by_hand(text), []
        for i, c in counted:
            m = 75 + (25 * c.total() * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1))
    return out


def found(spark, docs, items):
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    return Counter(tuple(r) for r in lexical_search.search(d, "doc_id", "text", i, "item_id", "text").collect())


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.03)), 300)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 80))), "x", "y", 1) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(30)]
    return docs, items


def test_search_is_that_of_brute_force(spark):
    docs, items = corpus()
    assert found(spark, docs, items) == searched_by_hand(docs, items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 60)
    monkeypatch.setattr(lexical_search, "CELLS", 1)
    docs, items = corpus(150)
    assert found(spark, docs, items) == searched_by_hand(docs, items)


def test_search_of_odd_rows(spark):
    docs, items = corpus(60)
    docs += [(900, None, "", "", 1), (901, "", "", "", 1), (902, " \n\t-.", "", "", 1), (903, "É é Éa w1W2", "", "", 1), (904, "w1 " * 50_000, "", "", 1)]
    docs += [(i, "w5 w6 the same", "", "", 1) for i in range(2000, 2040)] + [(2000, "w5 w6 the same", "", "", 1), (None, "w5 w6 the same", "", "", 1), (None, "w7", "", "", 1)]
    items += [(90, None), (91, ""), (92, "no-such-term"), (93, "w5 w6"), (93, "W5"), (94, "É éA w1w2"), (95, "w1 " * 3000)]
    assert found(spark, docs, items) == searched_by_hand(docs, items)
    assert not found(spark, [], items) and not found(spark, docs, []) and not found(spark, [(1, None, "", "", 1)], items)


def test_trees_leave_out_pairs_and_lose_none():
    """The search of two trees keeps the same best documents as all products, with fewer products."""
    np = lexical_search.np
    rng = random.Random(2)
    matrix = np.zeros((2000, 60))
    for row in matrix:
        for t in rng.sample(range(60), 6):
            row[t] = rng.randrange(1, 1000) * (100 if rng.random() < 0.01 else 1)
    weights = [{t: rng.randrange(1, 50) for t in rng.sample(range(60), 3)} for _ in range(40)]
    items = lexical_search.Items(weights, 5, np.zeros(40, np.int64))
    done = sum(lexical_search.meet(items, lexical_search.Documents(np.arange(b, b + 500), matrix[b : b + 500])) for b in range(0, 2000, 500))
    assert done < 2000 * 40
    for i, w in enumerate(weights):
        scores = matrix[:, list(w)] @ np.array(list(w.values()))
        assert sorted(items.scores[i].tolist()) == sorted(scores.astype(int).tolist())[-5:]
    assert list(itertools.islice(items.ids[0], 1))
