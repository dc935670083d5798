"""The queries of this package, with production parameters, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import bpe, decontamination, fingerprints, hard_negatives, jaccard_join, language_id, lexical_search, pii, sharding, token_files, toxicity, url_rules, warc
from portcullis.llm.common import id_remainder, saved, shared_dir, table

#: The id that ends each document in token files.
END_ID = 2


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizers on each machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SHARDS = [f"shard-{i:02d}" for i in range(32)]

#: The rules that the query is defined with.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, and its shard after the loss of the last one."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    after = sharding.place(docs, "doc_id", SHARDS[:-1]).select("doc_id", F.col("shard").alias("shard_after_loss"))
    # The second placement is another lookup on the same row, not a join by id.
    now = sharding.place(after, "doc_id", SHARDS)
    return now.select("doc_id", "slot", "shard", "shard_after_loss")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the base patterns, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, "text", pii.learn(docs, "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the three quarters of documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_remainder(F.col("doc_id"), 4) == 2)
    profiles = language_id.prototypes(docs.where(~F.col("held_out")), "text", "lang")
    return language_id.identify(docs, "text", profiles).select("doc_id", "held_out", "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside passages of the benchmark, and the items they come from."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs.select("doc_id", "text"), items.select("item_id", "text"), "doc_id", "text", "item_id", "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0)
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"), F.col("held_out"))
    return toxicity.score(docs, "text", model).select("doc_id", "held_out", "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum in token files that are written and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_files(token_files.blocks_of(docs, "doc_id", "text", tokenizer_path(), END_ID), path)
    return token_files.read_files(spark, path)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, "text", tokenizer_path()).drop("text")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    The edited text ends with the beginning of the next document in descending order of doc_id. Texts are shuffled once,
    by runs of ids. Every row has a result of its own: where ids repeat, their rows stand one after the other in any
    order; rows without an id come last.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if twice.isEmpty():
        return _compared_with_edited(docs)
    # A number for each row that has the order of the ids; written, it holds whenever it is read.
    dealt = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    placed = saved(dealt.select(F.col("doc_id").alias("own_id"), F.monotonically_increasing_id().alias("doc_id"), "text"), "placed")
    found = _compared_with_edited(placed.select("doc_id", "text"))
    return found.join(placed.select("doc_id", "own_id"), "doc_id").select(F.col("own_id").alias("doc_id"), *found.columns[1:])


def _compared_with_edited(docs: DataFrame) -> DataFrame:
    """The columns of op10_imatch for documents with distinct non-null ids and non-null texts."""
    lists = saved(fingerprints.lexicon(docs, "text"), "lexicon")
    both = fingerprints.with_next(fingerprints.with_fingerprints(docs, "text", lists), "doc_id", ["text", "fingerprint"])
    sized = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("cast(n_chars div 2 as int)"))
    whole = sized.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - half), left(next_text, half))"))
    found = fingerprints.with_fingerprints(whole, "edited", lists, "edited_fingerprint")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        *(fingerprints.as_text(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path with the rule that decides and the verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, "url", URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector and each of its positives; every seventh vector has a wrong label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs.select("doc_id", "text"), "doc_id", "text", items.select("item_id", "text"), "item_id", "text")


def op13_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in WARC archives, converted from legacy archives that the pages are first written to."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_arc(pages, "page_id", "url", "html", f"{path}/arc")
    warc.write_warc(warc.converted(spark, f"{path}/arc"), f"{path}/warc")
    back = warc.pages_of(saved(warc.read_warc(spark, f"{path}/warc", payloads=False), "warc-index"))
    number = lambda key: F.col(key).cast("long")
    return back.select(
        number("record_key").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to_key").alias("refers_to")
    )


QUERIES = {
    "op1_shard_placement": op1_shard_placement,
    "op2_personal_data": op2_personal_data,
    "op3_language_profiles": op3_language_profiles,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_bpe": op8_bpe,
    "op9_url_rules": op9_url_rules,
    "op10_imatch": op10_imatch,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_arc_to_warc": op13_arc_to_warc,
}


def _sharding_sql() -> str:
    number = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
    m = sharding.SLOTS

    def filled(name: str, shards: list[str]) -> str:
        rows = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
        n = len(shards)
        return f"""
        {name}_shards AS (SELECT n, shard, {number.format("shard || ':offset'")} % {m} AS first, {number.format("shard || ':skip'")} % {m - 1} + 1 AS skip
            FROM (VALUES {rows}) AS t(n, shard)),
        {name}_prefs AS (SELECT n, list_transform(range({m}), lambda j: ((first + j * skip) % {m})::INT) AS prefs FROM {name}_shards),
        {name}_fill AS (
            SELECT 0 AS turn, list_transform(range({m}), lambda i: -1) AS slots
            UNION ALL
            SELECT turn + 1, list_transform(slots, lambda x, i: CASE WHEN i = mine + 1 THEN turn % {n} ELSE x END)
            FROM (SELECT f.turn, f.slots, list_filter(p.prefs, lambda s: f.slots[s + 1] = -1)[1] AS mine
                  FROM {name}_fill f JOIN {name}_prefs p ON p.n = f.turn % {n} WHERE f.turn < {m})),
        {name} AS (SELECT unnest(range({m})) AS slot, unnest(slots) AS n FROM {name}_fill WHERE turn = {m})"""

    return f"""WITH RECURSIVE {filled("every", SHARDS)}, {filled("fewer", SHARDS[:-1])},
        placed AS (SELECT doc_id, CAST({number.format("CAST(doc_id AS VARCHAR)")} % {m} AS INT) AS slot FROM documents)
        SELECT p.doc_id, p.slot, a.shard, b.shard AS shard_after_loss FROM placed p
        JOIN every e ON e.slot = p.slot JOIN every_shards a ON a.n = e.n
        JOIN fewer f ON f.slot = p.slot JOIN fewer_shards b ON b.n = f.n"""


def _url_rules_sql() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH rules AS (SELECT * FROM (VALUES {rows}) AS t(verdict, rule_host, rule_path)),
        parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
            SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        fit AS (
            SELECT page_id, max_by(rule_host || rule_path, (len(string_split(rule_host, '.')), len(rule_path))) AS rule,
                   max_by(verdict, (len(string_split(rule_host, '.')), len(rule_path))) AS verdict
            FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM split s LEFT JOIN fit f USING (page_id)"""


def _decontamination_sql() -> str:
    words = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
        sizes AS (SELECT DISTINCT least(len(w), 10) AS size FROM b WHERE len(w) > 0),
        windows AS (SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram
                    FROM b WHERE len(w) > 0),
        places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size),
        grams AS (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS gram FROM places),
        met AS (SELECT DISTINCT g.doc_id, g.pos, g.size, x.item_id FROM grams g JOIN windows x ON x.size = g.size AND x.gram = g.gram),
        hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM met) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _hard_negatives_sql() -> str:
    return """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id AS other, list_dot_product(a.v, e.v)::BIGINT AS score
            FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.*, other AS negative_id, score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10"""


def _lexical_search_sql() -> str:
    terms = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
    return f"""
        WITH d AS (SELECT doc_id, {terms} AS terms FROM documents),
        sizes AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM sizes),
        asked AS (SELECT item_id, unnest({terms}) AS term FROM benchmark),
        i AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
        held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, totals GROUP BY term),
        c AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // length)))) AS credit
              FROM held JOIN w USING (term) JOIN sizes USING (doc_id), totals),
        s AS (SELECT item_id, doc_id, sum(times * credit)::BIGINT AS score FROM i JOIN c USING (term) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20"""


def _warc_sql() -> str:
    return f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.LEAST_COPY} GROUP BY payload_digest)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN firsts USING (payload_digest)"""


ORACLES = {
    "op5_decontamination": _decontamination_sql(),
    "op1_shard_placement": _sharding_sql(),
    "op9_url_rules": _url_rules_sql(),
    "op11_hard_negatives": _hard_negatives_sql(),
    "op12_lexical_search": _lexical_search_sql(),
    "op13_arc_to_warc": _warc_sql(),
}
