"""The operators of portcullis.llm against brute force, exact round trips and held-out accuracy on small inputs."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from portcullis.llm import bpe, decontamination, fingerprints, jaccard_join, language_id, pii, sharding, token_files, toxicity, url_rules
from portcullis.llm.common import saved
from portcullis.llm.queries import tokenizer_path

ODD = [None, "", " ", "\n\t", "a", "é😀", "x" * 3000, "the same text twice over again", "the same text twice over again"]
SCHEMA = "doc_id long, text string, score string, kind string"


def frame(spark, texts, first=0):
    """Documents with columns whose names clash with those of results, one of them without an id."""
    rows = [(i + first, t, "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed, book=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(book)}" for _ in range(n)]


# Sharding


def filled_by_hand(names, slots):
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    prefs = [[(number(f"{n}:offset") % slots + j * (number(f"{n}:skip") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    table = {}
    for turn in range(slots):
        mine = turn % len(names)
        table[next(s for s in prefs[mine] if s not in table)] = names[mine]
    return table


def test_lookup_table_is_filled_in_turns(spark):
    names = ["a", "b", "c", "d"]
    got = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 101).collect()}
    assert got == filled_by_hand(names, 101)
    heavy = [r.shard for r in sharding.lookup_table(spark, ["a", "b"], 101, [3, 1]).collect()]
    assert abs(heavy.count("a") - 76) <= 1
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 100)


def test_place_keeps_all_rows(spark):
    docs = frame(spark, ODD).withColumn("slot", F.lit("old")).unionByName(frame(spark, ["n"]).withColumn("slot", F.lit("old")).withColumn("doc_id", F.lit(None).cast("long")))
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    assert placed.count() == len(ODD) + 1 and placed.where("shard is null").count() == 0
    assert sharding.place(docs.limit(0), "doc_id", ["a"], 101).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}
            if fits[kind]():
                out.append((m.start(), k + 1, kind, m.end()))
    return sorted(out)


BITS = ["a.b", "@", "x", "example", ".com", "+1 ", "(555) ", "555-", "1234", "4111 1111 1111 1111", "4111111111111111", " ", "192.", "168.1.1", ".", "-", "0", "256.1.1.1", "é", "😀", "\n", "(at)", "[dot]", "4012.8888.8888.1881", "555-123-4567 ", "_", "%", "call "]


def test_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    texts = ODD + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1 " * 2000, "a.b@" * 300] + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    docs = frame(spark, texts)
    found = pii.with_spans(docs, "text", pii.learn(docs, "text"))
    for row in found.collect():
        assert [(s.start, s.kind_no, s.kind, s.end) for s in row.spans if s.base] == base_spans(row.text), row.text
    assert found.columns == [*docs.columns, "spans"]
    masked = found.where(F.col("text") == "a@b.c_d@e.f").select(pii.masked(F.col("text"), F.col("spans"))).first()[0]
    assert masked == "[EMAIL][EMAIL]"
    assert pii.with_spans(docs.limit(0), "text", pii.learn(docs.limit(0), "text")).count() == 0


def constant_model():
    """A classifier that gives every candidate the same probability."""
    kinds = len(pii.ALL_KINDS)
    return pii.Model([0.5] * kinds, [[[[1 / 3] * 3] * 2] * pii.LABELERS] * kinds, [0.0] * (pii.FEATURE_CELLS * kinds))


def test_overlapping_spans_are_masked_to_their_ends(spark):
    texts = ["10.0.0.0 4111 1111 1111 1111", "4111 1111 1111 1111.jo@x.com", "a 10.0.0.0 4111 1111 1111 1111.jo@x.com b c@d.e", "a@b.c 10.0.0.1"]
    found = pii.with_spans(frame(spark, texts), "text", constant_model())
    got = [r[0] for r in found.orderBy("doc_id").select(pii.masked(F.col("text"), F.col("spans"))).collect()]
    assert got == ["[IP]", "[CARD]", "a [IP] b [EMAIL]", "[EMAIL] [IP]"]


def plain_mask(text, spans):
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_masking_equals_plain_masking(spark):
    """Texts of many spans and of several pieces, with signs of two code units."""
    rng = random.Random(8)
    texts = ["".join(rng.choice([*BITS, "word " * 40, "😀" * 30]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["é😀 a@b.co " * 16_000, "x" * 4096 + "a@b.co" + "y" * 4090, "a@b.co", "😀" * 9000 + " 10.0.0.1"]
    found = pii.with_spans(frame(spark, texts), "text", pii.learn(frame(spark, texts), "text")).withColumn("masked", pii.masked(F.col("text"), F.col("spans")))
    for row in found.collect():
        assert row.masked == plain_mask(row.text, [(s.start, s.kind, s.end) for s in row.spans])


def test_secrets_are_found_by_the_classifier(spark):
    """Values that a name of secrets goes before are spans; check sums, long names and paths alike are not."""
    rng = random.Random(3)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    texts = []
    for k in range(240):
        yes = rng.choice(['token = "{}"', "api_key: {}", 'TOKEN = "{}"!!', "password={}", "secret: '{}'"])
        no = rng.choice(["commit {} by", "see /files/{}", "sha1sum {}", "release-notes-{}-final"])
        texts.append(f"words é {k} " + (yes if k % 2 else no).format(value(40)) + f" then jo.{k}@mail.example.com or 10.1.{k}.7 and 300.1.2.{k}")
    docs = frame(spark, texts)
    model = pii.learn(docs, "text")
    secrets = lambda m: {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "secret"] for r in pii.with_spans(docs, "text", m).collect()}
    got = secrets(model)
    assert [k for k in got if got[k]] == [k for k in got if re.search(r"(?i)token =|api_key:|password=|secret:", texts[k])]
    assert all(len(v[0]) == 40 for v in got.values() if v)
    assert not any(secrets(constant_model()).values())


def test_running_sums(spark):
    sizes = list(range(300))
    got = spark.createDataFrame([(sizes,), ([],)], "a array<int>").select(pii.running_sums(F.col("a")).alias("s")).collect()
    assert got[0].s == [0, *itertools.accumulate(sizes)] and got[1].s == [0]


# Languages


def test_languages_held_out(spark):
    syllables = {"p": ["ba", "de", "ko"], "q": ["ñu", "lli", "ez"]}
    rng = random.Random(1)
    text = lambda k: " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(30))
    rows = [(i, text(k), k) for i in range(60) for k in "pq"]
    profiles = language_id.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    tests = frame(spark, [text("p"), text("q"), *ODD, "123 !"])
    got = [r.lang_pred for r in language_id.identify(tests, "text", profiles).orderBy("doc_id").collect()]
    assert got[:2] == ["p", "q"] and got[2:6] == ["und"] * 4 and got[-1] == "und" and "und" not in got[6:-1]
    assert {r.lang_pred for r in language_id.identify(tests, "text", {}).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    vectors, _ = language_id.memory()
    rows = language_id.symbols("ab, a!")
    want = sum(np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c] for a, b, c in zip(rows, rows[1:], rows[2:]))
    assert rows[0] == rows[-1] == 0 and np.allclose(language_id.bundle(rows), want)


# Jaccard join


def brute_components(texts):
    pattern, lower = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = pattern.findall((t or "").translate(lower))
        sets.append({tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:])))
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    return {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)  # blocks of the large group are cut into tiles
    rng, texts = random.Random(3), list(ODD)
    for g in range(12):
        first = words(rng.randint(6, 150), g)
        for _ in range(40 if g == 0 else 6):
            copy = list(first)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, texts), "doc_id", "text").collect()}
    assert got == brute_components(texts)
    assert jaccard_join.near_duplicates(frame(spark, ["a"]).limit(0), "doc_id", "text").count() == 0


def test_sets_just_similar_enough_are_linked(spark):
    """Sets of n tokens inside sets of 4 n / 3: the larger one's prefix may hold few of the smaller one's tokens."""
    texts = []
    for seed in range(60):
        long = words(8 if seed < 40 else 12, 5000 + seed, 10**6)
        texts += [" ".join(long), " ".join(long[: 7 if seed < 40 else 10])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, texts), "doc_id", "text").collect()}
    assert got == brute_components(texts)
    assert all(c == i - i % 2 for i, (_, c) in got.items())


def test_ids_on_two_texts_are_linked_by_both(spark):
    texts = [" ".join(words(40, 700 + k, 10**6)) for k in range(8)]
    near = lambda k: " ".join([*texts[k].split()[:-1], "other"])
    # 9 holds texts 0 and 1, 8 a near copy of text 0 and 2 of text 1; 5 and 7 share nothing but the id 6; 4 holds a blank too.
    rows = [(9, texts[0]), (9, texts[1]), (8, near(0)), (2, near(1)), (6, texts[2]), (6, texts[3]), (7, near(2)), (5, near(3)), (4, texts[4]), (4, " "), (3, texts[5]), (3, texts[5]), (None, texts[5])]
    want = {9: 2, 8: 2, 2: 2, 6: 5, 7: 5, 5: 5, 4: 4, 3: 3}
    for order in (rows, rows[::-1]):
        got = jaccard_join.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), "doc_id", "text").collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, 0 if t == " " else 36, want[i]) for i, t in rows if i is not None)


# Decontamination


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(n, 50 + i, 30))) for i, n in enumerate([12, 25, 10, 9, 4, 1, 0])] + [(7, None), (8, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    texts = list(ODD) + ["w1 " * 30]
    for k in range(60):
        text = words(rng.randint(0, 40), 900 + k, 30)
        item = (items[rng.randrange(7)][1] or "").split()
        cut = rng.randrange(len(text) + 1)
        texts.append(" , ".join(text[:cut] + item[rng.randrange(3) :] + text[cut:]).upper())
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(frame(spark, texts), bench, "doc_id", "text", "item_id", "text").collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in enumerate(texts):
        own, hit, met = split(t), set(), set()
        for item, text in items:
            theirs = split(text)
            size = min(10, len(theirs))
            for b in range(len(theirs) - size + 1 if size else 0):
                for a in range(len(own) - size + 1):
                    if own[a : a + size] == theirs[b : b + size]:
                        hit |= set(range(a, a + size))
                        met.add(str(item))
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].contaminated) == (len(own), len(hit), len(met), bool(hit))
        assert rows[i].items_sha256 == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


# Toxicity


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.3
        w = words(30, i, 60) + (["insult"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_on_labels(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") % 5 == 0)
    got = toxicity.score(docs, "text", model).where("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    odd = toxicity.score(frame(spark, ODD), "text", model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    cells = np.array([3, 5, 3, 5, 9])
    machine = toxicity.Machine(0.5, rng_weights := np.arange(10) / 10.0, factors := np.arange(20).reshape(10, 2) / 10.0)
    pair = lambda a, b: float(factors[a] @ factors[b])
    want = [0.5 + rng_weights[3] + rng_weights[5] + pair(3, 5), 0.5 + rng_weights[[3, 5, 9]].sum() + pair(3, 5) + pair(3, 9) + pair(5, 9), 0.5]
    assert np.allclose(machine.logits(cells, np.array([2, 3, 0])), want)


# Token files


@pytest.mark.parametrize("seed", range(4))
def test_pack_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, 50257, 3000), 2 ** rng.integers(0, 63, 2000), np.zeros(1500, int), [2**62]]).astype(np.uint64)
    found, offsets, escapes = token_files.pack(ids)
    assert (token_files.unpack(found, escapes) == ids).all()
    for i in range(len(offsets) - 1):
        assert (token_files.unpack(found[offsets[i] : offsets[i + 1]], escapes) == ids[i * token_files.SUB : (i + 1) * token_files.SUB]).all()


def test_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ODD + ["Hello  world, it's\n\nfine <|endoftext|> then", " lead and trail ", "a\x1c b"]
    token_files.write_files(token_files.blocks_of(frame(spark, texts[::-1]), "doc_id", "text", tokenizer_path(), 2, 3), str(tmp_path / "t"))
    got = token_files.read_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    book, start = Tokenizer.from_file(tokenizer_path()), 0
    import zlib

    for row, text in zip(got, texts[::-1], strict=True):
        ids = [*book.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_cut_texts_without_threads(monkeypatch):
    """Texts are cut as by the pattern, and the library starts no threads of its own in a task."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab  \n\t\x1c\x85　") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert all(token_files.cut_text(t) == token_files._PIECES.split(t) for t in texts if t is not None)
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    monkeypatch.setattr(token_files, "_state", {})
    book = Tokenizer.from_file(tokenizer_path())
    for got, text in zip(token_files.encode_texts(texts, tokenizer_path()), texts, strict=True):
        assert got.tolist() == book.encode(text or "", add_special_tokens=False).ids
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


# BPE


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    alphabet = "aeiou thnsr  \n\n'’\"0123é漢字😀ABC.,-_=\t\x1c\xa0　"
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["a" * 3000, "x<|endoftext|> y <|endoftext|>", "".join(rng.choice("theinr ") for _ in range(5000))]
    book = Tokenizer.from_file(tokenizer_path())
    encoded = bpe.decode(bpe.encode(frame(spark, texts), "text", tokenizer_path()), "ids", tokenizer_path()).orderBy("doc_id").collect()
    for row, text in zip(encoded, texts, strict=True):
        want = book.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.decoded == book.decode(want, skip_special_tokens=False)
    null = bpe.round_trip(frame(spark, [None]), "text", tokenizer_path()).first()
    assert null.n_tokens == 0 and null.ids_sha256 == null.decoded_sha256 == hashlib.sha256(b"").hexdigest()


# URL rules


def test_rules_equal_brute_force(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/e"), ("block", "net", "")]
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.com/en/1?q=/x#y", "http://example.com", "https://a.net/es/1", "http://net/en#", "x://a.com/://b", "http://xexample.com/en/", "http://m.example.com/en", "http://.com/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("old"))
    for row in url_rules.judge(df, "url", rules, "block").collect():
        rest = (row.url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, *(max(fit)[2:] if fit else (None, "block")))


# Fingerprints


def test_fingerprints(spark):
    texts = ODD + [" ".join(words(80, k, 300)) for k in range(60)]
    near = " ".join(words(80, 5, 300)[:-1] + ["other"])
    docs = frame(spark, [*texts, near])
    lists = saved(fingerprints.lexicon(docs, "text", 0.02, 0.5), "lexicon")
    got = {r.doc_id: r.fingerprint for r in fingerprints.with_fingerprints(docs, "text", lists).collect()}
    assert got[7] == got[8] and got[0] == got[1]
    kind = "struct<digest: bigint, parts: array<int>>"
    pairs = spark.createDataFrame([(got[len(ODD) + 5], got[len(texts)]), (got[len(ODD) + 5], got[len(ODD) + 6]), (got[0], got[1])], f"a {kind}, b {kind}")
    same, other, empty = (r[0] for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect())
    assert same > 0.7 and other < 0.3 and empty == 1.0
    kept = {t for r in lists.collect() for some in r.lists for t in some}
    counts = {}
    for t in [*texts, near]:
        for w in set(re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())) - {""}:
            counts[w] = counts.get(w, 0) + 1
    n = len(texts) + 1
    assert len(kept) == sum(max(2, int(0.02 * n)) <= c <= max(2, int(0.5 * n)) for c in counts.values())


def test_each_term_of_the_band_is_in_random_lexicons(spark):
    """Each term alone gives a part in every group, so a text that keeps one term of the band can be like its source."""
    docs = frame(spark, [" ".join(words(80, k, 300)) for k in range(60)])
    lists = saved(fingerprints.lexicon(docs, "text", 0.02, 0.5), "lexicon")
    alone = fingerprints.with_fingerprints(frame(spark, [f"w{i}" for i in range(300)]), "text", lists)
    assert {len(r.fingerprint.parts) for r in alone.collect()} == {fingerprints.GROUPS}
