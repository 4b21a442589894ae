"""Bounded samples of labelled documents, and linear models on sparse features, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is divisible by 5 (a null id's is 0)."""
    return F.pmod(F.crc32(F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def _ours(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(id, y): each label that is not held out, once."""
    return labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).distinct()


def sampled_shares(labels: DataFrame, label: str, most: tuple[int, int], id_col: str = "doc_id") -> dict[int, float]:
    """The share of each class's labels that labelled_sample() takes."""
    sizes = {r["y"]: r["n"] for r in _ours(labels, label, id_col).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return {y: min(1.0, most[y] / n) for y, n in sizes.items()}


def chosen_labels(labels: DataFrame, label: str, most: tuple[int, int], id_col: str = "doc_id") -> DataFrame:
    """(id, y) of ``most[y]`` labels of each class, or all of a smaller class: those of the least hash of the id."""
    ours = _ours(labels, label, id_col)
    parts = [ours.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(n) for y, n in enumerate(most)]
    return parts[0].union(parts[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, text) of at most ``most[y]`` labelled documents of each class.

    Chosen by a hash of the id among the labels that are not held out, so the choice does not depend on order or on
    partitions. The chosen labels, of which there are no more than that, are sent to all tasks: documents stay in
    place. Of the documents that share an id the least text counts, so repeated rows add nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen_labels(labels, label, most, id_col)), "id")
    return found.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")


def first_of_copies(marks: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of one document for each (mark, y), in order of mark: copies must not count as evidence again."""
    order = np.lexsort((np.arange(len(marks)), y, marks))
    m, z = marks[order], y[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (m[1:] != m[:-1]) | (z[1:] != z[:-1])
    return order[fresh]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: list[np.ndarray], n_features: int, target: np.ndarray, penalty: float = 1e-4, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence features, by minibatch Adagrad; target in 0 to 1."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_features), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    gw, gb = np.full(n_features, 1e-6), 1e-6
    sizes = np.array([len(r) for r in rows])
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            flat = np.concatenate([rows[k] for k in at]) if sizes[at].sum() else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(at)), sizes[at])
            error = sigmoid(np.bincount(own, weights=w[flat], minlength=len(at)) + b) - target[at]
            g = np.bincount(flat, weights=error[own], minlength=n_features) / len(at) + penalty * w
            gw += g * g
            w -= 0.3 * g / np.sqrt(gw)
            gb += error.mean() ** 2
            b -= 0.3 * error.mean() / np.sqrt(gb)
    return w, float(b)
