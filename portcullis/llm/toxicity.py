"""Toxicity scores of a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import ascii_lower

#: Hash cells of the terms; a power of two.
CELLS = 1 << 18
#: The model is fitted on at most so many labelled documents, those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
FACTORS = 4


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise products of the factors of the present terms)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of rows whose distinct cells lie one after the other in cells; rows without terms get the bias."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(row, self.weights[cells], minlength=len(sizes)).astype(float)  # whole numbers where there are no cells
        for k in range(self.factors.shape[1]):
            v = self.factors[cells, k]
            total += 0.5 * (np.bincount(row, v, minlength=len(sizes)) ** 2 - np.bincount(row, v * v, minlength=len(sizes)))
        return self.bias + total


def _shrunk(values: np.ndarray, grad: np.ndarray, step: np.ndarray, penalty: float) -> np.ndarray:
    """A gradient step, then a step towards zero that does not cross it."""
    moved = values - step * grad
    return np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)


def term_cells(text: Column) -> Column:
    """The distinct hash cells of a text's terms (runs of ASCII letters, digits and all other non-ASCII characters)."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w).bitwiseAND(CELLS - 1).cast("int"))
    return F.array_distinct(hashed)


def fit(labels: np.ndarray, cells_of: list[np.ndarray], seed: int = 7, epochs: int = 8, batch: int = 128) -> Machine:
    """Fits the machine on labels (0 or 1) and the cells of their rows, by Adagrad on mini-batches.

    Without any rows the machine scores 0; with labels of one kind it scores that kind.
    """
    rng = np.random.default_rng(seed)
    model = Machine(-20.0, np.zeros(CELLS), rng.normal(0, 0.01, (CELLS, FACTORS)))
    if not len(labels):
        return model
    rate = labels.mean()
    model.bias = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    # Words of few rows say little about others; without them and with sparse weights rare words are not learned by heart.
    least = max(3, min(20, len(labels) // 800))
    known = np.bincount(np.concatenate(cells_of), minlength=CELLS) >= least
    model.factors[~known] = 0
    cells_of = [c[known[c]] for c in cells_of]
    seen_w, seen_v = np.full(CELLS, 0.01), np.full((CELLS, FACTORS), 0.01)
    weight = np.where(labels > 0, min(10.0, 0.5 / max(rate, 1e-9)), 0.5 / max(1 - rate, 1e-9))
    for _ in range(max(epochs, 1000 * batch // len(labels))):
        order_now = rng.permutation(len(labels))
        for start in range(0, len(order_now), batch):
            ids = order_now[start : start + batch]
            sizes = np.array([len(cells_of[i]) for i in ids])
            cells_now = np.concatenate([cells_of[i] for i in ids])
            row = np.repeat(np.arange(len(ids)), sizes)
            z = model.logits(cells_now, sizes)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[ids]) * weight[ids] / len(ids)
            touched, inverse = np.unique(cells_now, return_inverse=True)
            for k in range(FACTORS):
                v = model.factors[cells_now, k]
                sums = np.bincount(row, v, minlength=len(ids))
                grad = np.bincount(inverse, error[row] * (sums[row] - v), minlength=len(touched))
                seen_v[touched, k] += grad**2
                model.factors[touched, k] = _shrunk(model.factors[touched, k], grad, 0.01 / np.sqrt(seen_v[touched, k]), 1e-4)
            grad = np.bincount(inverse, error[row], minlength=len(touched))
            seen_w[touched] += grad**2
            model.weights[touched] = _shrunk(model.weights[touched], grad, 0.3 / np.sqrt(seen_w[touched]), 1e-3)
            model.bias -= 0.05 * float(error.sum())
    return model


def score(df: DataFrame, text: str, model: Machine) -> DataFrame:
    """All columns of df, with score (0 to 1) and predicted (1 if score >= 0.5) in place of columns of these names.

    Null and empty texts have no terms and get the score of the bias. The model has a fixed size and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast((np.float64(model.bias), model.weights.astype(np.float32), model.factors.astype(np.float32)))

    @F.pandas_udf("double")
    def scored(cells: pd.Series) -> pd.Series:
        sizes = cells.map(len).to_numpy(dtype=np.int64)
        flat = np.concatenate(cells.to_numpy()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        z = Machine(*shared.value).logits(flat, sizes)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return df.withColumn("score", scored(term_cells(F.col(text)))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled_rows(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, order, label and cells of about max_rows labelled documents (or all, if fewer) that are not held out.

    Ids are chosen first, by a hash of the id alone, so that only they are broadcast and only the terms of their
    documents are made; no step sorts texts or terms. An id counts once: of contradictory labels the smaller one holds,
    of several texts that of the smallest hash. Rows with a null id or a null label are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    # A third more, since some are held out or have no document; what is too much is cut where the rows arrive.
    share = min(1.0, 4 / 3 * max_rows / max(1, known.count()))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = known.where(order < int(share * (1 << 40))).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.where(~held_out & (order < int(share * (1 << 40)))).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.struct(F.xxhash64("text").alias("hash"), term_cells(F.col("text")).alias("cells")).alias("found"))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("found").alias("found")).select("doc_id", order.alias("order"), "label", "found.cells")


def train_on_labels(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = TRAIN_ROWS) -> Machine:
    """Fits a machine on labelled documents (doc_id, text) that are not held out, at most max_rows of them.

    The rows come to the driver as lists of cells in Arrow form: their number is bounded, and texts stay on the
    executors. Whatever the partitions, the same rows come in the same order.
    """
    found = labelled_rows(docs, labels, held_out, max_rows).toArrow().combine_chunks()
    picked = found.sort_by([("order", "ascending"), ("doc_id", "ascending")]).slice(0, max_rows).combine_chunks()
    cells = picked.column("cells").combine_chunks() if picked.num_rows else None
    cells_of = [] if cells is None else np.split(cells.flatten().to_numpy().astype(np.int64), np.cumsum(cells.value_lengths().to_numpy())[:-1])
    return fit(picked.column("label").to_numpy().astype(float), cells_of)
