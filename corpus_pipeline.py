"""A training corpus from documents: toxic ones go, near duplicates are reduced to one, benchmark passages and personal
data are taken out, and the rest becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns; the last returns ids.
Decisions are joined to documents by row_key, which the first stage gives each row: ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import bpe, decontamination, jaccard_join, pii, toxicity
from portcullis.llm.common import id_remainder, saved, small, table
from portcullis.llm.queries import tokenizer_path


#: The column that tells rows apart. Its values hold once the documents that have it are written.
KEY = "row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, where it is not there yet; write it before the key is used."""
    return docs if KEY in docs.columns else docs.withColumn(KEY, F.monotonically_increasing_id())


def _written(docs: DataFrame) -> DataFrame:
    """docs with keys that hold; a stage that runs by itself writes them first."""
    return docs if KEY in docs.columns else saved(_keyed(docs), "keyed")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but for those with a key among keys."""
    gone = saved(keys.select(KEY), "gone")
    return docs.join(small(gone), KEY, "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns as in the toxicity query."""
    docs = _keyed(docs)
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) == 0)
    return toxicity.score(docs, "text", model).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near duplicates; one with an id before one without."""
    docs = _written(docs)
    found = jaccard_join.near_duplicates(docs, KEY, "text").select(F.col("doc_id").alias(KEY), "component_id")
    more = saved(found.where(F.col("component_id") != F.col(KEY)), "more")
    members = more.unionByName(more.select(F.col("component_id").alias(KEY), "component_id").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)
    placed = saved(members.join(docs.select(KEY, "doc_id"), KEY).select(KEY, "component_id", place.alias("place")), "members")
    kept = placed.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col(f"place.{KEY}").alias(KEY))
    return _without(docs, placed.select(KEY).join(kept, KEY, "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs = _written(docs)
    found = decontamination.hits(docs, table(spark, sf_dir, "benchmark"), KEY, "text", "item_id", "text")
    return _without(docs, found.select(F.col("doc_id").alias(KEY)).distinct())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars is that of the new text."""
    found = pii.with_spans(docs, "text", pii.learn(docs, "text"), out="_spans")
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs.select("doc_id", "text"), "text", tokenizer_path()).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
