"""A quality classifier on supervised subword embeddings.

A word's features are its own hash and those of its runs of three and four code points, with its ends marked, all in
fixed numbers of buckets. A word is the mean of its features' learned vectors, and a text the mean of its words. Pairs
of neighbouring words have vectors too, by the difference of their hashes, so that all pairs of a word with itself
share one; their mean is added. A softmax over the sum gives the class. Vectors and softmax are trained together by
stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import first_of_copies, held_out, labelled_sample, sigmoid
from .scratch import as_row
from .textkernel import Block, U, blocks, lean, mix, packed, rolled, unpacked

#: Labelled rows to learn from at most, of low and of high quality.
SAMPLE = (3000, 4500)
BUCKETS, DIMENSIONS, EPOCHS, BATCH = 1 << 15, 8, 5, 64
#: Code points of a run; all features: of words, runs and pairs.
RUNS, FEATURES = (3, 4), 3 * BUCKETS


def _word_features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's distinct words: features, offsets of each word's, and the word of each word in the text."""
    _, one, which = np.unique(b.hashes, return_index=True, return_inverse=True)
    points = np.append(np.flatnonzero((b.data & 0xC0) != 0x80), len(b.data))  # where code points begin
    first, last = np.searchsorted(points, b.start[one]), np.searchsorted(points, b.end[one])
    owner, found = [np.arange(len(one))], [mix(b.hashes[one]) % U(BUCKETS)]
    for n in RUNS:
        runs = np.maximum(last - first - n + 1, 0)
        word = np.repeat(np.arange(len(one)), runs)
        at = first[word] + np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs)
        ends = (at == first[word]).astype(U) + U(2) * (at + n == last[word]).astype(U)  # a run at an end is another
        owner.append(word)
        found.append(mix(b.span_hash(points[at], points[at + n]) + ends) % U(BUCKETS) + U(BUCKETS))
    owner, found = np.concatenate(owner), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(one) + 1)), which


def _pairs(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of each pair of neighbouring words."""
    doc = b.doc_of_word()
    same = np.flatnonzero(doc[1:] == doc[:-1])
    return doc[same], (mix(b.hashes[same + 1] - b.hashes[same]) % U(BUCKETS)).astype(np.int64) + 2 * BUCKETS


@dataclass
class Model:
    vectors: np.ndarray
    softmax: np.ndarray  # of class 1 less those of class 0: weights, then bias

    def score(self, b: Block) -> np.ndarray:
        """Of class 1; a text without words gets what the bias says."""
        total = np.zeros((b.texts, self.vectors.shape[1]))
        if len(b.hashes):
            features, at, which = _word_features(b)
            words = np.add.reduceat(self.vectors[features], at[:-1], axis=0) / np.diff(at)[:, None]
            filled = np.flatnonzero(np.diff(b.first))
            total[filled] = np.add.reduceat(words[which], b.first[filled], axis=0) / np.diff(b.first)[filled, None]
            doc, pair = _pairs(b)
            more = np.flatnonzero(np.diff(b.first) > 1)
            total[more] += np.add.reduceat(self.vectors[pair], np.searchsorted(doc, more), axis=0) / np.diff(b.first)[more, None] if len(more) else 0
        return sigmoid(total @ self.softmax[:-1] + self.softmax[-1])


def train(ids: list[np.ndarray], weights: list[np.ndarray], y: np.ndarray, prior: float, seed: int = 11) -> Model:
    """ids, weights: features of each text and their shares. prior: share of class 1 to be expected."""
    rng = np.random.default_rng(seed)
    n = FEATURES
    vectors = rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    grown, grown_soft = np.full((n, DIMENSIONS), 1e-8, np.float32), np.full((DIMENSIONS + 1, 2), 1e-8)
    sizes = np.array([len(i) for i in ids])
    for epoch in range(EPOCHS):
        rate = 0.25 * (1 - epoch / EPOCHS) + 0.02
        order = rng.permutation(len(ids))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            flat, share = np.concatenate([ids[k] for k in at]).astype(np.int64), np.concatenate([weights[k] for k in at])
            filled = sizes[at] > 0
            mean = np.zeros((len(at), DIMENSIONS))
            begins = (np.cumsum(sizes[at]) - sizes[at])[filled]
            if len(begins):
                mean[filled] = np.add.reduceat(vectors[flat] * share[:, None], begins, axis=0)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            to_mean = p @ soft.T
            g = np.concatenate([mean.T @ p, p.sum(0)[None]])
            grown_soft += g * g
            step = rate * g / np.sqrt(grown_soft)
            soft -= step[:-1]
            bias -= step[-1]
            own = np.repeat(np.arange(len(at)), sizes[at])
            used, place = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(place, weights=share * to_mean[own, d], minlength=len(used)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            grown[used] += g * g
            vectors[used] -= rate * g / np.sqrt(grown[used])
    seen = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = np.clip(prior, 1e-3, 1 - 1e-3)
    shift = np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return Model(vectors, np.append(soft[:, 1] - soft[:, 0], bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: tuple[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, learnt on the driver from a sample of labelled rows; see SAMPLE."""
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, marks = [], []
            for b in blocks(batch.column(1)):
                features, at, which = _word_features(b)
                grams, (doc, pair) = rolled(b.hashes, 5), _pairs(b)
                cut = np.searchsorted(doc, np.arange(b.texts + 1))
                for i in range(b.texts):
                    lo, hi = b.first[i], b.first[i + 1]
                    words, times = np.unique(which[lo:hi], return_counts=True)
                    size = at[words + 1] - at[words]
                    own = np.repeat(np.arange(len(words)), size)
                    flat = features[np.repeat(at[words] - (np.cumsum(size) - size), size) + np.arange(len(own))]
                    ids, place = np.unique(flat, return_inverse=True)
                    share = np.bincount(place, weights=(times / np.maximum(size, 1))[own] / max(1, hi - lo), minlength=len(ids))
                    near, often = np.unique(pair[cut[i] : cut[i + 1]], return_counts=True)
                    ids, share = np.append(ids, near), np.append(share, often / max(1, hi - lo))
                    blobs.append(packed(ids.astype(np.uint32), share.astype(np.float16)))
                    own5 = grams[lo : max(hi - 4, lo)]
                    marks.append(int((own5.min() if len(own5) else b.hashes[lo:hi].sum(dtype=U)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(marks, pa.int64())], ["y", "blob", "mark"])

    rows = labelled_sample(docs, labels, label, sample, id_col, text_col).mapInArrow(lean(shrink), "y int, blob binary, mark long").toArrow()
    y, marks = np.array(rows.column("y").to_pylist(), np.int64), np.array(rows.column("mark").to_pylist(), np.int64)
    blobs = rows.column("blob")
    keep = first_of_copies(marks, y)
    y, parts = y[keep], [unpacked(blobs[i].as_py(), "<u4", "<f2") for i in keep.tolist()]
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return Model(np.zeros((FEATURES, DIMENSIONS), np.float32), np.append(np.zeros(DIMENSIONS), 4.0 if len(y) and y[0] else (-4.0 if len(y) else 0.0)))
    ours = labels.where(~held_out(id_col) & F.col(label).isin(0, 1))
    prior = ours.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train([p[0] for p in parts], [p[1] for p in parts], y, prior)


def scored(docs: DataFrame, model: Model, cut: float = 0.3, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1, higher for class 1) and predicted (score >= cut).

    Whole texts are scored; null and empty ones get the score of the bias. Nothing but the text counts. Other columns
    pass through; a column named as one that is added is replaced.
    """
    rows = docs.select(as_row(docs, names))
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS and DIMENSIONS

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([sent.value.score(b) for b in blocks(batch.column(0).field(text_col))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["row", *names])

    return rows.mapInArrow(lean(go), schema).select("row.*", *(F.col(f"`{n}`") for n in names))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from labels that are not held out.

    Null labels and ids without a document teach nothing. Labels of one class only give every text that class. No
    documents give no rows; rows that repeat are scored alike, and teach once.
    """
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return scored(rows, fit(docs, labels, label, sample)).select("doc_id", "held_out", "score", "predicted")
