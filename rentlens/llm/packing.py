"""Packing documents into sequences by patterns found with non-negative least squares.

Documents become pieces of at most ``length`` tokens. How many pieces there are of each length is all the driver sees.
It enumerates all patterns of up to three lengths that fill a sequence, fits how often to use each to the histogram by
non-negative least squares, rounds down, and packs what is left by best fit, longest first, whole runs of equal pieces
at a time. Pieces of one length are alike, so the n-th of them takes the n-th place that the patterns have for that
length; pieces are numbered in buckets, whose counts give every bucket its first number.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import as_row, partitions, store
from .textkernel import lean

LENGTH, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Steps of the least-squares fit.
STEPS = 100
#: Texts of other characters go to the tokenizers library: white space and special tokens are its own there. So do long
#: runs without a break, which cost the other more than in proportion.
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-ɏ]|<\\||[^\\s]{400}|\\s{400}")


#: Pieces that a task numbers, about.
TASK_PIECES = 1_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _encoders(json_path: str, ranks_path: str | None):
    """The tokenizers library's encoder, and a faster one of the same ids for plain Latin text."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return slow, None
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return slow, tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, json_path: str, ranks_path: str | None) -> list[int]:
    slow, fast = _encoders(json_path, ranks_path)
    if fast is None or _OTHER.search(text):
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids and ``end``, cut if over ``length``.

    All pieces of a cut document but the first have ``length`` ids. Null text is empty: one piece, ``end`` alone.
    json_path, ranks_path: vocabulary files; the second, of the same ids, is optional and faster.
    """
    if json_path is None:
        json_path, ranks_path = vocabulary_path(VOCABULARY + ".json"), vocabulary_path(VOCABULARY + ".tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, size, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*token_ids(text.as_py() or "", json_path, ranks_path), end], "<u4")
                first = len(ids) % length or length
                at = [0, *range(first, len(ids), length), len(ids)] if len(ids) > length else [0, len(ids)]
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def _patterns(have: np.ndarray, length: int) -> np.ndarray:
    """All patterns of one to three lengths that occur and fill a sequence, longest first, with 0 for no piece."""
    there = np.flatnonzero(have)
    there = there[there > 0]
    out = [np.array([[length, 0, 0]], np.int64)] if have[length] else []
    for a in there[(there < length) & (3 * there >= length)].tolist()[::-1]:
        rest = length - a
        b = there[(there <= min(a, rest)) & (2 * there >= rest)][::-1]
        b = b[(b == rest) | (have[rest - b] > 0)]
        out.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _least_squares(patterns: np.ndarray, have: np.ndarray) -> np.ndarray:
    """How often to use each pattern: x >= 0 of the least squared error to the histogram, by multiplicative steps."""
    have = np.where(np.arange(len(have)) > 0, have, 0).astype(float)
    real = patterns > 0
    want = np.where(real, have[patterns], 0).sum(1)
    x = np.full(len(patterns), max(1.0, have.sum() / max(1, real.sum())))
    for _ in range(STEPS):
        made = np.bincount(patterns.ravel(), weights=(x[:, None] * real).ravel(), minlength=len(have))
        x *= want / np.maximum(np.where(real, made[patterns], 0).sum(1), 1e-12)
    return x


def _best_fit(have: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for runs of equal lengths: (lengths of a sequence, sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    for size in np.flatnonzero(have)[::-1].tolist():
        left = int(have[size])
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                each = length // size
                for k, n in ((each, left // each), (left % each, 1 if left % each else 0)):
                    if n:
                        open_.setdefault(length - k * size, []).append(((size,) * k, n))
                left = 0
                continue
            held, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
            use = min(n, left)
            left -= use
            if n > use:
                open_.setdefault(room, []).append((held, n - use))
            open_.setdefault(room - size, []).append(((*held, size), use))
        done += [x for x in open_.pop(0, [])]
    return done + [x for group in open_.values() for x in group]


def packing_plan(have: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use every piece of the histogram once."""
    have = have.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = _patterns(have, length)
    if len(patterns):
        x = _least_squares(patterns, have)
        for i in np.argsort(-x, kind="stable").tolist():
            sizes = tuple(p for p in patterns[i].tolist() if p)
            n = min(int(x[i]), *(int(have[s]) // sizes.count(s) for s in sizes))
            if n > 0:
                for s in sizes:
                    have[s] -= n
                out.append((sizes, n))
    return out + _best_fit(have, length)


def _slots(plan: list[tuple[tuple[int, ...], int]], length: int) -> tuple[np.ndarray, ...]:
    """For each length in turn: first numbers of its runs of places, their first sequence and their offset; bounds by length."""
    by: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
    sequence = 0
    for sizes, n in plan:
        offset = 0
        for size in sizes:
            by[size].append((n, sequence, offset))
            offset += size
        sequence += n
    first, base, offsets = [], [], []
    for runs in by:
        at = 0
        for n, s, o in runs:
            first.append(at)
            base.append(s)
            offsets.append(o)
            at += n
    return np.array(first, np.int64), np.array(base, np.int64), np.array(offsets, np.int64), np.cumsum([0, *map(len, by)])


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (pieces(), or any table with doc_id, piece, length and ids_crc32) with sequence_id and offset.

    Every row gets a place; no two places overlap, and a sequence has no gap. Equal rows get places of their own.
    Rows are numbered within their length: bucket by bucket, so no task sees all of a length. No rows give no rows.
    Other columns pass through, whatever their names; those named as one that is added are replaced.
    """
    spark = cut.sparkSession
    added = ("sequence_id", "offset")
    cut = store(cut.select(as_row(cut, added), "doc_id", "piece", "ids_crc32", "length"))
    buckets = 4 * partitions(spark, cut.count(), TASK_PIECES)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = store(cut.groupBy("bucket", "length").agg(F.count("*").alias("n")))
    have = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        have[r["length"]] = r["n"]
    first, base, offsets, bounds = _slots(packing_plan(have, length), length)
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(counts.select("bucket", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    # Both sides grow with the input: neither is sent to all tasks.
    rows = cut.join(starts.hint("merge"), ["bucket", "length"]).withColumn("number", F.col("before") + F.row_number().over(inside) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                own = size == s
                at[own] = bounds[s] + np.searchsorted(first[bounds[s] : bounds[s + 1]], number[own], "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(base[at] + number - first[at]), pa.array(offsets[at])], ["row", *added])

    schema = T.StructType([cut.schema["row"], *(T.StructField(n, T.LongType()) for n in added)])
    return rows.select("row", "length", "number").mapInArrow(lean(place), schema).select("row.*", *added)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, of pieces made with with_ids; at most ``length`` a row."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
