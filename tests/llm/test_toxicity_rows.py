"""Which labelled rows the toxicity model learns from, and that it learns pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from portcullis.llm import toxicity
from portcullis.llm.queries import QUERIES

DOCS, LABELS = "doc_id long, text string, toxic string, score string", "doc_id long, toxic int, text string"


def rows_of(spark, docs, labels, most=1000):
    d, x = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    return {r.doc_id: (r.label, sorted(r.cells)) for r in toxicity.labelled_rows(d, x, F.col("doc_id") % 5 == 0, most).collect()}


def cells(spark, text):
    return sorted(spark.range(1).select(toxicity.term_cells(F.lit(text))).first()[0])


def test_rows_with_clear_labels(spark):
    docs = [(1, "a b", "t", "s"), (2, None, "t", "s"), (3, "c", "t", "s"), (5, "held", "t", "s"), (None, "no id", "t", "s"), (6, "no label", "t", "s"), (7, "null label", "t", "s")]
    labels = [(1, 1, "x"), (2, 0, "x"), (3, 1, "x"), (3, 0, "x"), (3, 1, "x"), (5, 1, "x"), (None, 1, "x"), (7, None, "x"), (8, 1, "no document")]
    got = rows_of(spark, docs * 3, labels)
    assert got == {1: (1, cells(spark, "a b")), 2: (0, []), 3: (0, cells(spark, "c"))}
    assert rows_of(spark, [], labels) == {} and rows_of(spark, docs, []) == {}


def test_one_text_of_an_id(spark):
    """An id with a third of all rows counts once, with the same text whatever the order of the rows."""
    docs = [(1, f"text {i % 7}", "t", "s") for i in range(300)]
    first, second = rows_of(spark, docs, [(1, 1, "x")]), rows_of(spark, docs[::-1], [(1, 1, "x")])
    assert first == second and len(first) == 1


def test_bound_of_the_sample(spark):
    docs = [(i, f"w{i}", "t", "s") for i in range(3000)]
    labels = [(i, i % 2, "x") for i in range(3000)]
    got = rows_of(spark, docs, labels, 300)
    assert 200 < len(got) < 450 and set(got) <= {i for i in range(3000) if i % 5}
    model = toxicity.train_on_labels(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.col("doc_id") % 5 == 0, 50)
    again = toxicity.train_on_labels(spark.createDataFrame(docs[::-1], DOCS), spark.createDataFrame(labels, LABELS).repartition(5), F.col("doc_id") % 5 == 0, 50)
    assert model.bias == again.bias and np.array_equal(model.weights, again.weights) and np.array_equal(model.factors, again.factors)


def test_pairs_that_single_words_do_not_show():
    """Two words are toxic together and harmless alone."""
    rng = random.Random(9)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + rng.sample(range(10, 40), 6)))
        labels.append(float(a and b))
    model = toxicity.fit(np.array(labels), rows)
    logit = lambda *c: float(model.logits(np.array(c), np.array([len(c)]))[0])
    others = list(range(11, 17))
    assert logit(1, 2, *others) > 0 > max(logit(1, *others), logit(2, *others), logit(*others))


def test_query_on_odd_tables(spark, tmp_path):
    def ask(name, docs, labels):
        spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        return QUERIES["op6_toxicity"](spark, f"{tmp_path}/{name}").collect()

    odd = [(1, None, "t", "s"), (1, "", "t", "s"), (None, "x", "t", "s"), (2, "y " * 50_000, "t", "s")]
    for name, labels in (("none", []), ("one kind", [(i, 1, "x") for i in range(9)]), ("contradicting", [(1, 1, "x"), (1, 0, "x")])):
        got = ask(name, odd, labels)
        assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert ask("empty", [], []) == []
