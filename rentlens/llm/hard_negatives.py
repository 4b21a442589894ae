"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

A row's score for an anchor is their integer inner product. With one more component, sqrt(M - |x|^2) for rows and 0
for anchors, M the greatest squared norm, the score s of row x for anchor q is a distance: |q|^2 + M - 2 s, squared.
So the best rows are the nearest ones, and a window of scores is a shell around the anchor.

1. Anchors go to the cell of their nearest pivot; a cell knows its radius. A bounded sample of rows, scored against
   every anchor, gives each anchor a bound: enough of the sample are at least that near. From its anchors' bounds a
   cell knows the farthest, and the nearest, distance that any of them asks for.
2. By the triangle inequality a row can serve a cell's anchors only if its distance to the pivot lies within these
   two, widened by the radius. Rows are copied to those cells alone.
3. Cells are cut into chunks of anchors and slices of rows, counted beforehand, and each pair of them joins by itself:
   all scores of a block of rows, then the best of each anchor and window.
4. The join runs twice: for the positives (one window: all that is near enough), then, with the windows that the
   positives' scores open, for the negatives. Slices' findings merge by anchor and window.

Of rows with one label and one vector only the first ids can ever be asked for; the others stay out, so copies have
no weight. Pivots, sample, chunks and slices share out the work; they never change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import partitions, store
from .textkernel import lean

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256  # per anchor; per positive; per cent of its score; of components
#: Anchors of a cell that a pivot stands for, pivots at most, rows of the sample, anchors and rows that join at once,
#: rows of a slice.
CELL, MOST_PIVOTS, SAMPLED, CHUNK, PROBES, SLICE = 128, 512, 1024, 512, 2048, 16384
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _whole(vectors: DataFrame, scale: float, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, width, size, raw, key) of the rows that take part, once each: whole components, two bytes each if that is enough."""
    kind = vectors.schema[vec_col].dataType.elementType
    made = pa.float32() if isinstance(kind, T.FloatType) else pa.float64()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(np.asarray(column.values.cast(made).to_numpy(zero_copy_only=False), np.float64) * scale) + 0.0  # null is nan, -0 is 0
            at = column.offsets.to_numpy().astype(np.int64)
            upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
            bad, wide = upto(~np.isfinite(x)), upto(~(np.abs(x) < 32768))
            good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
            large = wide[at[1:]] > wide[at[:-1]]
            with np.errstate(invalid="ignore", over="ignore"):
                short = np.where(np.abs(x) < 32768, x, 0).astype("<i2")
            raw = [None if not g else (x[i:j].tobytes() if w else short[i:j].tobytes()) for g, w, i, j in zip(good.tolist(), large.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(large, 8, 2).astype(np.int32)), pa.array((at[1:] - at[:-1]).astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "label", "width", "size", "raw"])

    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).where("vec_id is not null and label is not null")
    rows = given.mapInArrow(lean(go), "vec_id long, label long, width int, size int, raw binary").where("raw is not null").distinct()
    return store(rows.withColumn("key", F.xxhash64("vec_id", "label", "width", "raw")))


def _matrix(raw: list[bytes], width: list[int], size: int) -> np.ndarray:
    out = np.empty((len(raw), size))
    for kind, w in (("<i2", 2), ("<f8", 8)):
        own = [i for i, x in enumerate(width) if x == w]
        if own:
            out[own] = np.frombuffer(b"".join([raw[i] for i in own]), kind).reshape(len(own), size)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; beyond 64 bits the greatest or least of them."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = np.dot(whole(a), whole(b).T)
    return np.array([[min(_MOST, max(_LEAST, int(x))) for x in row] for row in found], np.int64).reshape(len(a), len(b))


@dataclass
class _Space:
    """What a length of vectors has: pivots (the first of the sample), the sample, the greatest squared norm."""

    sample: np.ndarray
    label: np.ndarray
    key: np.ndarray
    pivots: int
    most: float

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + self.most) ** 0.5

    def apart(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances of rows or anchors to the pivots."""
        p = self.sample[: self.pivots]
        own, theirs = (x * x).sum(1), (p * p).sum(1)
        beside = lambda n: np.sqrt(np.maximum(self.most - n, 0))
        near = x @ p.T + (0 if anchors else np.outer(beside(own), beside(theirs)))
        return np.sqrt(np.maximum((own[:, None] if anchors else self.most) + self.most - 2 * near, 0))


def _spaces(rows: DataFrame, anchors: DataFrame) -> dict[int, _Space]:
    """Of the lengths with more rows than a sample; others have one cell and no bounds."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, width, raw = (batch.column(i).to_pylist() for i in range(3))
            for n in sorted(set(size)):
                own = [i for i, x in enumerate(size) if x == n]
                x = _matrix([raw[i] for i in own], [width[i] for i in own], n)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([float((x * x).sum(1).max(initial=0))])], ["size", "n", "most"])

    found = rows.select("size", "width", "raw").mapInArrow(lean(squares), "size int, n long, most double").groupBy("size").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    many = {r["size"]: r["most"] for r in found.where(F.col("n") > SAMPLED).collect()}
    asked = {r["size"]: r["n"] for r in anchors.where(F.col("size").isin(*many)).groupBy("size").agg(F.count("*").alias("n")).collect()} if many else {}
    out = {}
    for size, n in asked.items():
        some = rows.where(F.col("size") == size).orderBy(F.xxhash64("key", F.lit("sample")), "key").limit(SAMPLED).collect()
        sample = _matrix([bytes(r["raw"]) for r in some], [r["width"] for r in some], size)
        out[size] = _Space(sample, np.array([r["label"] for r in some]), np.array([r["key"] for r in some]), min(MOST_PIVOTS, -(-n // CELL), len(some)), many[size])
    return out


def _windows(scores: list[int] | None, low: int, high: int) -> tuple[list[int], list[int]]:
    """Least and greatest score of each window: any for the positives, shares of the positives' scores for negatives."""
    if scores is None:
        return [_LEAST], [_MOST]
    return [-((-low * p) // 100) for p in scores], [high * p // 100 for p in scores]


def _asked(anchors: DataFrame, spaces: dict[int, _Space], k: int, same: bool, low: int, high: int) -> DataFrame:
    """Anchors with their windows (narrowed by the sample), cell, distance to its pivot, and the distances they ask for."""

    def narrowed(space: _Space, x: np.ndarray, label: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        score = _scores(x, space.sample)
        fit = ((label[:, None] == space.label) == same) & (key[:, None] != space.key)
        for j in range(lo.shape[1]):
            inside = np.where(fit & (score <= hi[:, j, None]), score, _LEAST)
            if inside.shape[1] >= k:
                lo[:, j] = np.maximum(lo[:, j], np.partition(inside, -k, axis=1)[:, -k])
        return lo

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                size = batch.column(3).to_numpy()
                for n in np.unique(size).tolist():
                    own = batch.take(pa.array(np.flatnonzero(size == n)))
                    rows = own.num_rows
                    key, label = own.column(0).to_numpy(), own.column(1).to_numpy()
                    pairs = [_windows(s, low, high) for s in own.column(5).to_pylist()]
                    wide = max(len(a) for a, _ in pairs)
                    lo, hi = np.full((rows, wide), 1, np.int64), np.zeros((rows, wide), np.int64)  # none
                    for i, (a, b) in enumerate(pairs):
                        lo[i, : len(a)], hi[i, : len(b)] = np.clip(a, _LEAST, _MOST), np.clip(b, _LEAST, _MOST)
                    open_ = lo <= hi
                    cell, apart, far, near = np.zeros(rows, np.int32), np.zeros(rows), np.full(rows, np.inf), np.zeros(rows)
                    if n in spaces:
                        space, x = spaces[n], _matrix(own.column(4).to_pylist(), own.column(2).to_pylist(), n)
                        lo = np.where(open_, narrowed(space, x, label, key, lo.copy(), hi), lo)
                        d = space.apart(x, True)
                        cell = d.argmin(1).astype(np.int32)
                        apart = d[np.arange(rows), cell] + space.slack
                        reach = lambda s: np.sqrt(np.maximum((x * x).sum(1) + space.most - 2 * s, 0))  # noqa: B023, E731
                        far = reach(np.where(open_, lo, _MOST).min(1).astype(float)) + space.slack
                        near = reach(np.where(open_, hi, _LEAST).max(1).astype(float)) - space.slack
                    keep = pa.array(open_.any(1))
                    out = pa.RecordBatch.from_arrays(
                        [*own.columns[:5], pa.array([a.tobytes() for a in lo], pa.binary()), pa.array([a.tobytes() for a in hi], pa.binary()), pa.array(cell), pa.array(apart), pa.array(far), pa.array(near)],
                        ["key", "label", "width", "size", "raw", "lo", "hi", "cell", "apart", "far", "near"],
                    )
                    yield out.filter(keep)

    rows = anchors.select("key", "label", "width", "size", "raw", "scores")
    return store(rows.mapInArrow(lean(go), "key long, label long, width int, size int, raw binary, lo binary, hi binary, cell int, apart double, far double, near double"))


def _best(anchors: DataFrame, rows: DataFrame, spaces: dict[int, _Space], k: int, same: bool, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(key, window, score, vec_id): the ``k`` best rows of each anchor and window, of the anchor's label or of others."""
    spark = rows.sparkSession
    asked = _asked(anchors, spaces, k, same, low, high)
    cells = asked.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.max("far").alias("far"), F.min("near").alias("near")).collect()
    by: dict[int, list] = {}
    for r in sorted(cells, key=lambda r: (r["size"], r["cell"])):
        by.setdefault(r["size"], []).append(r)
    bounds = {n: tuple(np.array([r[c] for r in own]) for c in ("cell", "radius", "far", "near")) for n, own in by.items()}

    def served(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, rows of the batch, rows of those, cells that they may serve) of each length."""
        size = batch.column(3).to_numpy()
        for n in np.unique(size).tolist():
            if n not in bounds:
                continue
            cell, radius, far, near = bounds[n]
            own = np.flatnonzero(size == n)
            if n not in spaces:
                yield n, own, np.arange(len(own)), np.zeros(len(own), np.int64)
                continue
            part = batch.take(pa.array(own))
            d = spaces[n].apart(_matrix(part.column(4).to_pylist(), part.column(2).to_pylist(), n), False)[:, cell]
            row, at = np.nonzero((d - radius - spaces[n].slack <= far) & (d + radius + spaces[n].slack >= near))
            yield n, own, row, at

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, _, at in served(batch):
                there, times = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), n, np.int32)), pa.array(there.astype(np.int32)), pa.array(times.astype(np.int64))], ["size", "at", "n"])

    given = rows.select("key", "label", "width", "size", "raw", "vec_id")
    copies = {(r["size"], r["at"]): r["n"] for r in given.mapInArrow(lean(sizes), "size int, at int, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect()}
    base, chunks, slices, total = {}, {}, {}, 0
    for n, own in by.items():
        chunks[n] = np.array([-(-r["n"] // CHUNK) for r in own])
        slices[n] = np.array([max(1, -(-copies.get((n, i), 0) // SLICE)) for i in range(len(own))])
        base[n] = total + np.concatenate([[0], np.cumsum(chunks[n] * slices[n])])
        total = int(base[n][-1])
    dealt = partitions(spark, sum(float(copies.get((n, i), 0) * c) for n in by for i, c in enumerate(chunks[n].tolist())), 2 * SLICE)
    schema = "part long, probe boolean, key long, label long, width int, size int, raw binary, vec_id long, lo binary, hi binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def sent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PROBES):
                batch = whole.slice(i, PROBES)
                key = batch.column(0).to_numpy().view(np.uint64)
                for n, own, row, at in served(batch):
                    cut = (key[own[row]] % slices[n][at].astype(np.uint64)).astype(np.int64)
                    times = chunks[n][at]
                    each = np.repeat(np.arange(len(row)), times)
                    chunk = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                    part = base[n][at[each]] + chunk * slices[n][at[each]] + cut[each]
                    for j in range(0, len(each), 4 * PROBES):
                        them = batch.take(pa.array(own[row[each[j : j + 4 * PROBES]]]))
                        none = pa.nulls(them.num_rows, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(part[j : j + 4 * PROBES]), pa.array(np.ones(them.num_rows, bool)), *them.columns, none, none], names)

    def sent_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy()
            for n in np.unique(size).tolist():
                own = batch.take(pa.array(np.flatnonzero(size == n)))
                at = np.searchsorted(bounds[n][0], own.column(7).to_numpy())
                chunk = (own.column(0).to_numpy().view(np.uint64) % chunks[n][at].astype(np.uint64)).astype(np.int64)
                times = slices[n][at]
                each = np.repeat(np.arange(len(at)), times)
                cut = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                part = base[n][at[each]] + chunk[each] * slices[n][at[each]] + cut
                for j in range(0, len(each), 4 * PROBES):
                    them = own.take(pa.array(each[j : j + 4 * PROBES]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[j : j + 4 * PROBES]), pa.array(np.zeros(them.num_rows, bool)), *them.columns[:5], pa.nulls(them.num_rows, pa.int64()), them.column(5), them.column(6)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, built, held = None, [], []
        join = None
        for batch in batches:
            for part, probe, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if join is not None:
                        join.add(held)
                        yield join.found()
                    now, built, held, join = part, [], [], None
                if not probe:
                    built.append(row)
                    continue
                if join is None and built:
                    join = _Join(built, k, same)
                if join is not None:
                    held.append(row)
                    if len(held) >= PROBES:
                        join.add(held)
                        held = []
        if join is not None:
            join.add(held)
            yield join.found()

    both = given.mapInArrow(lean(sent_rows), schema).union(asked.mapInArrow(lean(sent_anchors), schema))
    both = both.repartitionById(dealt, F.pmod("part", F.lit(dealt)).cast("int")).sortWithinPartitions("part", "probe")
    met = both.mapInArrow(lean(meet), "key long, window int, score long, vec_id long")
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "vec_id")
    return store(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


class _Join:
    """A chunk of anchors that meets rows, some thousand at a time, and keeps the best of each anchor and window."""

    def __init__(self, built: list, k: int, same: bool):
        key, label, width, size, raw, _, lo, hi = zip(*built, strict=True)
        self.key, self.label, self.size, self.k, self.same = np.array(key), np.array(label), size[0], k, same
        self.x = _matrix(list(raw), list(width), self.size)
        wide = max(map(len, lo)) // 8
        self.lo, self.hi = np.full((len(key), wide), 1, np.int64), np.zeros((len(key), wide), np.int64)
        for to, given in ((self.lo, lo), (self.hi, hi)):
            for i, b in enumerate(given):
                to[i, : len(b) // 8] = np.frombuffer(b, np.int64)
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))  # anchor, window, score, id

    def add(self, rows: list) -> None:
        if not rows:
            return
        key, label, width, _, raw, ids, _, _ = zip(*rows, strict=True)
        score = _scores(self.x, _matrix(list(raw), list(width), self.size))
        ids = np.array(ids)
        fit = ((self.label[:, None] == np.array(label)) == self.same) & (self.key[:, None] != np.array(key))
        found = [self.best]
        for j in range(self.lo.shape[1]):
            inside = fit & (score >= self.lo[:, j, None]) & (score <= self.hi[:, j, None])
            if score.shape[1] > self.k and inside.sum() > 4 * self.k * len(score):  # all but the best and their equals
                inside &= score >= np.partition(np.where(inside, score, _LEAST), -self.k, axis=1)[:, -self.k, None]
            a, r = np.nonzero(inside)
            found.append((a, np.full(len(a), j), score[a, r], ids[r]))
        a, j, s, d = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.lexsort((d, ~s, j, a))  # ~s falls as s rises, and fits
        a, j, s, d = a[order], j[order], s[order], d[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (j[1:] != j[:-1])
        at = np.flatnonzero(fresh)
        rank = np.arange(len(a)) - np.repeat(at, np.diff(np.append(at, len(a))))
        self.best = tuple(x[rank < self.k] for x in (a, j, s, d))
        full = rank == self.k - 1
        self.lo[a[full], j[full]] = np.maximum(self.lo[a[full], j[full]], s[full])

    def found(self) -> pa.RecordBatch:
        a, j, s, d = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.key[a]), pa.array(j.astype(np.int32)), pa.array(s), pa.array(d.astype(np.int64))], ["key", "window", "score", "vec_id"])


def mine(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchors`` holds.

    Components become floor(scale * x); a score is the inner product of two rows. An anchor's positives are its first
    ``positives`` other rows of its label, by score descending, ties by id; each one's negatives the first
    ``negatives`` rows of other labels whose score lies within ``low`` to ``high`` per cent of the positive's.
    Rows with a null id or label, a null vector, or a component that is null, not finite or not finite once scaled take
    no part; rows that repeat whole count once, and rows that share an id are rows of their own. Vectors of different
    lengths never meet; empty ones score 0. Scores beyond 64 bits count as the nearest that fit. Labels are whole
    numbers. Other columns are not used but by ``anchors``. No rows, and anchors without positives, give no rows.
    """
    if not (positives > 0 and negatives > 0 and low >= 0):
        raise ValueError("positives and negatives have to be over 0, low not under it")
    rows = _whole(vectors, scale, id_col, label_col, vec_col)
    asked = _whole(vectors.where(anchors), scale, id_col, label_col, vec_col)
    alike = Window.partitionBy("label", "size", "width", "raw")
    few = Window.partitionBy("label", "size", "width", "raw", "salt").orderBy("vec_id")
    most = max(positives + 1, negatives)
    # The first ids of equal vectors, by a salt first: one vector may be a third of all rows.
    some = rows.withColumn("salt", F.pmod("key", F.lit(64))).withColumn("n", F.row_number().over(few)).where(F.col("n") <= most)
    some = store(some.withColumn("n", F.row_number().over(alike.orderBy("vec_id"))).where(F.col("n") <= most).drop("n", "salt"))
    spaces = _spaces(some, asked)
    near = _best(asked.withColumn("scores", F.lit(None).cast("array<long>")), some, spaces, positives, True)
    scores = near.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x.score).alias("scores"))
    far = _best(asked.join(scores, "key"), some, spaces, negatives, False, low, high)
    chosen = near.select("key", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = far.select("key", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = named.join(chosen, ["key", "window"]).join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def brute_force(rows: list[tuple], is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> list[tuple]:
    """mine() of (id, label, list) rows, for tests."""
    import math

    fit = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x * scale) for x in v):
            continue
        fit.append((i, label, tuple(math.floor(x * scale) for x in v)))
    fit = sorted(set(fit))
    out = []
    for a in fit:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-min(_MOST, max(_LEAST, sum(x * y for x, y in zip(a[2], b[2], strict=True)))), b[0], b[1]) for b in fit if b is not a and len(b[2]) == len(a[2]))
        for p, positive, _ in [s for s in scored if s[2] == a[1]][:positives]:
            good = [s for s in scored if s[2] != a[1] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a[0], positive, r, n, -p, -s) for r, (s, n, _) in enumerate(good, 1)]
    return out
