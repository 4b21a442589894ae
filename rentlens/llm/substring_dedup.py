"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one text. Its minimiser is the least hash among the ``mer``-word runs
inside it. Consecutive windows that share a minimiser travel as one packed string to the bucket of that minimiser,
so that equal windows meet in one bucket whatever surrounds them; there all windows are sorted and counted.

Runs that are very common would draw their neighbourhood into one bucket. They rank last among the minimisers, so
only windows that consist of them alone use them, and such strings are equal, shipped once for each map batch.
What counts as very common is a share of all runs, so at most ``2 * HOT_SHARE`` of them exist in any corpus.
Runs below that share may still fill a bucket, as buckets keep their size while the corpus grows. So the words that each
bucket would get are counted beforehand, and the windows of a heavy one are dealt by a second minimiser too, under
another order: by what surrounds the common run. Equal windows have both minimisers in common and still meet.

A string that a map batch holds twice repeats, whatever others hold: all of its windows do. Its places stay there and
only the string travels, to be counted. So a passage of every text brings one string a batch to its bucket.

Windows are told apart by two independent 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import as_row, partitions, store
from .textkernel import Block, U, block_of, blocks, lean, mix, packed, rolled, row_key, unpacked

WIDTH, MER, HOT_SHARE = 35, 6, 4096
#: Bytes of text whose super-k-mers are packed together; bytes of the corpus for each task that counts.
SENT_BYTES, TASK_BYTES = 8 << 20, 48 << 20
#: Of the compression of what travels.
LEVEL = 6
#: A bucket is heavy with this many times the mean of words.
HEAVY = 4
_TOP, _OTHER = U(1 << 63), U(0xD1B54A32D192ED03)


def _surveyed(rows: DataFrame, width: int, mer: int, dealt: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that make up over 1 / HOT_SHARE of all runs (any such run has half that share in some map task); heavy buckets.

    A bucket is heavy if its words, copies and all, are over HEAVY times the mean: at most 1 / HEAVY of them are.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, loads = 0, [], np.zeros(dealt, np.int64)
        none = np.zeros(0, U)
        for batch in batches:
            for b in blocks(batch.column(0)):
                h = rolled(b.hashes, mer)
                total += len(h)
                values, counts = np.unique(h, return_counts=True)
                often = counts >= max(2, len(h) // (2 * HOT_SHARE))
                kept.append((values[often], counts[often]))
                _, _, n, deal = _super_kmers(b, width, mer, none, none, dealt)
                loads += np.bincount((deal % U(dealt)).astype(np.int64), weights=n + width - 1, minlength=dealt).astype(np.int64)
        if total:
            full = np.flatnonzero(loads)
            values = np.concatenate([v for v, _ in kept] + [np.zeros(1, U), full.astype(U)])
            counts = np.concatenate([c for _, c in kept] + [np.array([total]), loads[full]])
            kind = np.zeros(len(values), np.int32)
            kind[len(values) - len(full) - 1 :] = 2
            kind[len(values) - len(full) - 1] = 1
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(kind)], ["run", "n", "kind"])

    found = store(rows.select("text").mapInArrow(lean(counted), "run long, n long, kind int").groupBy("run", "kind").agg(F.sum("n").alias("n")))
    total = found.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    hot = found.where((F.col("kind") == 0) & (F.col("n") >= max(64, total // (2 * HOT_SHARE)))).select("run").collect()
    mean = (found.where("kind = 2").agg(F.sum("n")).first()[0] or 0) / dealt
    heavy = found.where((F.col("kind") == 2) & (F.col("n") > HEAVY * mean)).select("run").collect()
    return np.sort(np.array([r[0] for r in hot], np.int64).view(U)), np.sort(np.array([r[0] for r in heavy], np.int64).view(U))


def _least_of(keys: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive keys."""
    out, have = keys, 1
    while 2 * have <= k:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - k + 1], out[k - have :]) if k > have else out


def _among(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x if len(sorted_set) else np.zeros(len(x), bool)


def _super_kmers(b: Block, width: int, mer: int, hot: np.ndarray, heavy: np.ndarray, dealt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, windows and deal hash of each super-k-mer of a block: of the minimiser, in heavy buckets of two."""
    if len(b.hashes) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    runs = rolled(b.hashes, mer)
    keys = runs >> U(1)
    if len(hot):
        keys = np.where(_among(hot, runs), keys | _TOP, keys)
    least = mix(_least_of(keys, width - mer + 1))
    if len(heavy):
        crowded = _among(heavy, least % U(dealt))
        least = np.where(crowded, mix(least ^ mix(_least_of(mix(runs ^ _OTHER), width - mer + 1))), least)
    doc = b.doc_of_word()
    inside = doc[: len(least)] == doc[width - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
    first = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    return doc[first], first, np.flatnonzero(ends) + 1 - first, least[first]


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, those that touch joined."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    base = row * (int(stop.max(initial=0)) + 2)
    reach = np.maximum.accumulate(base + stop)
    fresh = np.ones(len(row), bool)
    fresh[1:] = base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return row[at], start[at], (reach - base)[np.append(at[1:], len(row)) - 1] if len(row) else stop


class _Batch:
    """Super-k-mers of some text: each string once, and the places of all."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.windows, self.least, self.places = [], [], []
        self.size = 0

    def add(self, b: Block, width: int, doc: np.ndarray, first: np.ndarray, n: np.ndarray, least: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> None:
        last, text, known = first + n + width - 1, b.data.tobytes(), self.known
        before = len(known)
        which = np.array([known.setdefault(text[x:y], len(known)) for x, y in zip(b.start[first].tolist(), b.end[last - 1].tolist(), strict=True)], np.int64)
        fresh, at = np.unique(which, return_index=True)
        at = at[fresh >= before]
        self.windows.append(n[at])
        self.least.append(least[at])
        self.places.append((which, keys[doc + b.rows], marks[doc + b.rows], first - b.first[doc], n))
        self.size += len(b.data)

    def sealed(self, width: int, dealt: int) -> Iterator[tuple[int, bytes, bool]]:
        """(bucket, blob, whether it holds spans): the strings of each bucket, and the spans of those that are here twice."""
        if not self.known:
            return
        zip_ = zstandard.ZstdCompressor(LEVEL)
        strings = list(self.known)
        windows, least = np.concatenate(self.windows), np.concatenate(self.least)
        which, key, mark, at, n = (np.concatenate(x) for x in zip(*self.places, strict=True))
        often = np.bincount(which, minlength=len(strings)) > 1
        here = often[which]
        if here.any():
            one, row = np.unique(np.stack([key[here], mark[here]]), axis=1, return_inverse=True)
            row, start, stop = _merged(row.ravel(), at[here], at[here] + n[here] + width - 1)
            blob = packed(one[0][row], one[1][row], start.astype(np.int32), stop.astype(np.int32))
            yield int(mix(one[0][:1].view(U))[0] % U(dealt)), zip_.compress(blob), True
        place = np.empty(len(strings), np.int64)  # of the one place of a string that is here once
        place[which] = np.arange(len(which))
        bucket = (least % U(dealt)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(dealt + 1))
        sizes = np.fromiter(map(len, strings), np.int32, len(strings))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[k] : cut[k + 1]]
            single = ~often[own]
            of = place[own[single]]
            text = np.frombuffer(b"".join([strings[i] for i in own.tolist()]), np.uint8)
            yield k, zip_.compress(packed(text, sizes[own], windows[own].astype(np.int32), single, key[of], mark[of], at[of].astype(np.int32))), False


def shipped(rows: DataFrame, width: int, mer: int, dealt: int) -> DataFrame:
    """(bucket, blob, spans): the super-k-mers of ``rows`` by bucket, and spans that are known to repeat."""
    hot, heavy = _surveyed(rows, width, mer, dealt)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: _Batch) -> Iterator[pa.RecordBatch]:
            made = list(held.sealed(width, dealt))
            if made:
                bucket, blob, spans = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), pa.array(spans)], ["bucket", "blob", "spans"])

        held = _Batch()
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(2)):
                if held.size + len(b.data) > SENT_BYTES:
                    yield from sent(held)
                    held = _Batch()
                doc, first, n, least = _super_kmers(b, width, mer, hot, heavy, dealt)
                if len(first):
                    held.add(b, width, doc, first, n, least, keys, marks)
        yield from sent(held)

    return rows.select("key", "mark", "text").mapInArrow(lean(ship), "bucket int, blob binary, spans boolean")


def repeated_spans(rows: DataFrame, width: int = WIDTH, mer: int = MER) -> DataFrame:
    """(key, mark, start, stop): word spans of ``rows`` (key, mark, text) that repeated windows cover."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions(rows.sparkSession, size, TASK_BYTES)
    dealt = 4 * tasks  # a task has four buckets, one after the other

    def count(blobs: list[bytes]) -> pa.RecordBatch | None:
        open_ = zstandard.ZstdDecompressor()
        parts = [unpacked(open_.decompress(x), "u1", "<i4", "<i4", "?", "<i8", "<i8", "<i4") for x in blobs]
        base = np.cumsum([0, *(len(p[1]) for p in parts)])
        single, key, mark, at = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5, 6))
        times = np.where(single, 1, 2)
        one, two, string, place = [], [], [], []
        for p, x in zip(parts, base, strict=False):
            b = block_of(p[0], np.concatenate([[0], np.cumsum(p[1], dtype=np.int64)]))
            first = np.repeat(b.first[:-1], p[2])
            inner = np.arange(len(first)) - np.repeat(np.cumsum(p[2]) - p[2], p[2])
            for to, salt in ((one, 1), (two, 2)):
                to.append(rolled(b.hashes if salt == 1 else b.second, width, salt)[first + inner])
            string.append(np.repeat(np.arange(len(p[1])) + x, p[2]).astype(np.int32))
            place.append(inner.astype(np.int32))
        h, g, string, place = map(np.concatenate, (one, two, string, place))
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)  # as the window before it in the order
        same[1:] = h[order[1:]] == h[order[:-1]]
        if (g[order][1:][same[1:]] != g[order][:-1][same[1:]]).any():  # one hash, several windows
            order = np.lexsort((g, h))
            same[1:] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        group = np.cumsum(~same) - 1
        often = np.zeros(len(h), bool)
        often[order] = (np.bincount(group, weights=times[string[order]]) > 1.5)[group]
        often &= single[string]  # the others' places know
        string, place = string[often], place[often]
        if not len(string):
            return None
        order = np.lexsort((place, string))
        string, place = string[order], place[order]
        begins = np.ones(len(string), bool)
        begins[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
        i = np.flatnonzero(begins)
        n = np.diff(np.append(i, len(string)))
        of = (np.cumsum(single) - 1)[string[i]]
        start = at[of] + place[i]
        return pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(mark[of]), pa.array(start.astype(np.int32)), pa.array((start + n + width - 1).astype(np.int32))], ["key", "mark", "start", "stop"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if spans:
                    found = unpacked(zstandard.ZstdDecompressor().decompress(blob.as_py()), "<i8", "<i8", "<i4", "<i4")
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "mark", "start", "stop"])
                    continue
                if bucket != now and held:
                    if (found := count(held)) is not None:
                        yield found
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held and (found := count(held)) is not None:
            yield found

    sent = shipped(rows, width, mer, dealt)
    # A task gets four buckets, whatever their numbers hash to.
    sent = sent.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    return sent.mapInArrow(lean(reduce), "key long, mark long, start int, stop int")


def _kept(b: Block, keep: np.ndarray) -> pa.Array:
    """The texts of a block, of the words to keep alone, joined by one space."""
    doc = b.doc_of_word()[keep]
    start, size = b.start[keep], (b.end - b.start)[keep] + 1
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size -= last  # no space behind a text's last word
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    data = b.data[np.minimum(at, len(b.data) - 1)] if len(at) else np.zeros(0, np.uint8)
    data[(ends - 1)[~last]] = 32
    offsets = np.zeros(b.texts + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=size, minlength=b.texts).astype(np.int64), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(b.texts, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def dedup(docs: DataFrame, width: int = WIDTH, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the words that no repeated window covers, joined by one space.

    A window of ``width`` words repeats if its words also start anywhere else, the same text included; windows are
    judged on the input. Null and empty texts have no words, and kept_text ''. Texts of fewer than ``width`` words
    keep all. Rows that repeat whole, with equal ids or not, remove each other's windows. A null id is a value like
    any other. No rows give no rows. Other columns pass through, whatever their names; a column named as one that is
    added is replaced.
    """
    if not 1 <= mer < width:
        raise ValueError("mer has to lie under width")
    names = ("n_words", "n_removed", "kept_text")
    spans = repeated_spans(docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")), width, mer)
    spans = spans.groupBy("key", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    wide = docs.select(as_row(docs, names), *row_key(id_col, text_col)).join(spans, ["key", "mark"], "left")
    wide = wide.select("row", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))
    schema = T.StructType([wide.schema["row"], *(T.StructField(n, T.LongType()) for n in names[:2]), T.StructField(names[2], T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("spans")
            owner = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            flat = listed.flatten()
            start, stop = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            words, removed, kept = [], [], []
            for b in blocks(batch.column("row").field(text_col)):
                ours = slice(*np.searchsorted(owner, [b.rows, b.rows + b.texts]))
                base = b.first[owner[ours] - b.rows]
                step = np.bincount(base + start[ours], minlength=len(b.start) + 1) - np.bincount(base + stop[ours], minlength=len(b.start) + 1)
                keep = np.cumsum(step[: len(b.start)]) == 0
                words.append(np.diff(b.first))
                removed.append(np.bincount(b.doc_of_word()[~keep], minlength=b.texts))
                kept.append(_kept(b, keep))
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.concat_arrays(kept)], ["row", *names])

    return wide.mapInArrow(lean(cut), schema).select("row.*", *names)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple], width: int = WIDTH) -> list[tuple]:
    """(id, n_words, n_removed, kept_sha256) of (id, text) rows, for tests."""
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen: dict[tuple, int] = {}
    for _, w in words:
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] = seen.get(tuple(w[k : k + width]), 0) + 1
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out
