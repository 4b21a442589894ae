"""Exact range join of embeddings by cosine, over cells of pivots.

On unit vectors a cosine of c is a distance of sqrt(2 - 2 c), so near-duplicates are pairs within a radius. Every
vector belongs to the cell of its nearest pivot. The straight way from a vector to a partner in another cell crosses
the plane between the two pivots; by the triangle inequality no vector farther than the radius from that plane has a
partner beyond it, and only the others are copied to the other cell. Of two cells one, by a fixed rule, gets the
other's copies, so a pair meets once. Cells are cut into chunks of bounded size, each of which sees the copies and
the other chunks' vectors as a stream, and cells and chunks join independently.

In many dimensions vectors without structure lie near every plane: then nearly all are copied, and the join costs
what all pairs cost, in even parts. Pivots and cells never change the result, only how it is shared out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import class_components, forest
from .scratch import partitions, store
from .textkernel import lean

COSINE = 0.95
#: Vectors in a chunk of a cell, pivots at most, and probes compared at once.
CHUNK, MOST_PIVOTS, PROBES = 1024, 1024, 2048


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, raw): a vector's bytes, null if it is null, empty, zero or not finite; and their numpy type."""
    element = vectors.schema[vec_col].dataType.elementType
    kind, made = ("<f4", pa.float32()) if isinstance(element, T.FloatType) else ("<f8", pa.float64())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = np.ascontiguousarray(column.values.cast(made).to_numpy(zero_copy_only=False))  # null is nan
            at = column.offsets.to_numpy().astype(np.int64)
            upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
            bad, filled = upto(~np.isfinite(x)), upto(x != 0)
            good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (filled[at[1:]] > filled[at[:-1]])
            raw = pa.Array.from_buffers(pa.large_binary(), len(column), [pa.array(good).buffers()[1], pa.py_buffer(at * x.itemsize), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], ["vec_id", "raw"])

    return vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(lean(go), "vec_id long, raw binary"), kind


def _host(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether i, not j, is where the two meet; about half of all j for every i."""
    return ((i + j) % 2 == 0) == (i < j)


def _links(classes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(a, b, linked) as of components.class_components(). Vectors of different lengths never link: lengths are apart."""
    spark = classes.sparkSession
    width = np.dtype(kind).itemsize
    classes = classes.withColumn("size", (F.length("raw") / width).cast("int"))
    many = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).collect()}
    pivots, apart = {}, {}
    for size, n in many.items():  # other lengths have one cell and no pivot
        some = classes.where(F.col("size") == size).orderBy(F.xxhash64("raw", F.lit("pivot")), "class").limit(min(MOST_PIVOTS, -(-n // CHUNK)))
        pivots[size] = _units([r[0] for r in some.select("raw").collect()], kind)
        apart[size] = np.sqrt(np.maximum(2 - 2 * pivots[size] @ pivots[size].T, 0))
    radius = np.sqrt(2 - 2 * cosine) + 1e-9

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cells = batch.column(3).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for n in set(np.unique(size).tolist()) & set(pivots):
                own = np.flatnonzero(size == n)
                cells[own] = (_units(batch.column(2).take(pa.array(own)).to_pylist(), kind) @ pivots[n].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["class", "copies", "raw", "size", "cell"])

    same = store(classes.select("class", "copies", "raw", "size").mapInArrow(lean(home), "class long, copies long, raw binary, size int, cell int"))
    members = {n: np.zeros(len(p), np.int64) for n, p in pivots.items()}
    if pivots:
        for r in same.where(F.col("size").isin(*pivots)).groupBy("size", "cell").agg(F.count("*").alias("n")).collect():
            members[r["size"]][r["cell"]] = r["n"]
    chunks = {n: np.maximum(1, -(-m // CHUNK)) for n, m in members.items()}
    base = dict(zip(chunks, np.cumsum([0, *(int(c.sum()) for c in chunks.values())]).tolist(), strict=False))
    before = {n: base[n] + np.cumsum(c) - c for n, c in chunks.items()}
    dealt = partitions(spark, sum(int(c.sum()) for c in chunks.values()), 16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PROBES):
                batch = whole.slice(i, PROBES)
                size = batch.column(3).to_numpy()
                for n in np.unique(size).tolist():
                    own = batch.take(pa.array(np.flatnonzero(size == n)))
                    yield from dealt_out(own, n) if n in pivots else [made(own, np.arange(own.num_rows), np.full(own.num_rows, -1 - n), np.zeros(own.num_rows, bool))]

    def made(batch: pa.RecordBatch, who: np.ndarray, part: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        table = batch.select(["class", "copies", "raw"]).take(pa.array(who))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(probe), *table.columns], ["part", "probe", "class", "copies", "raw"])

    def dealt_out(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
        names, cell = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        near = _units(batch.column(2).to_pylist(), kind) @ pivots[n].T
        own = (names.view(np.uint64) % chunks[n][cell].astype(np.uint64)).astype(np.int64)
        between = apart[n][cell]
        # How far the plane between the two pivots is; pivots in one place have none, and all are copied.
        gap = np.where(between > 1e-6, (near[np.arange(len(cell)), cell][:, None] - near) / np.maximum(between, 1e-6), 0)
        others = np.arange(len(pivots[n]))
        row, to = np.nonzero((gap <= radius) & (others[None] != cell[:, None]) & _host(others[None], cell[:, None]))
        for r, c, probe in ((np.arange(len(cell)), cell, False), (row, to, True)):
            times = chunks[n][c]
            at = np.repeat(np.arange(len(r)), times)
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            if probe:
                is_probe = np.ones(len(at), bool)
            else:  # the home chunk, and those chunks of the cell that host the pair of chunks
                is_probe = chunk != own[r[at]]
                stay = ~is_probe | _host(chunk, own[r[at]])
                at, chunk, is_probe = at[stay], chunk[stay], is_probe[stay]
            who = r[at]
            for i in range(0, len(who), 8192):
                part = slice(i, i + 8192)
                yield made(batch, who[part], before[n][c[at[part]]] + chunk[part], is_probe[part])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, built, probes = None, [], []
        units = names = copies = None

        def compare(rows: list, alone: bool) -> Iterator[pa.RecordBatch]:
            near = (units if alone else _units([r[2] for r in rows], kind)) @ units.T
            if alone:
                near = np.triu(near, 1)
            y, x = np.nonzero(near >= cosine)
            if not len(x):
                return
            other, other_copies = (names, copies) if alone else (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
            left, right = names[x], other[y]
            who, at = np.unique(np.concatenate([left, right]), return_inverse=True)
            linked = np.bincount(at, weights=np.concatenate([other_copies[y], copies[x]])).astype(np.int64)
            tree = list(forest(left, right))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(p for p, _ in tree), *who.tolist()], pa.int64()), pa.array([*(q for _, q in tree), *[None] * len(who)], pa.int64()), pa.array([*[None] * len(tree), *linked.tolist()], pa.int64())],
                ["a", "b", "linked"],
            )

        for batch in batches:
            for part, probe, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    if probes and built:
                        yield from compare(probes, False)
                    elif built and units is None:
                        units, names, copies = _units([r[2] for r in built], kind), np.array([r[0] for r in built]), np.array([r[1] for r in built])
                        yield from compare(built, True)
                    now, built, probes, units = part, [], [], None
                if not probe:
                    built.append(row)
                    continue
                if units is None and built:
                    units, names, copies = _units([r[2] for r in built], kind), np.array([r[0] for r in built]), np.array([r[1] for r in built])
                    yield from compare(built, True)
                probes.append(row)
                if len(probes) >= PROBES:
                    if built:
                        yield from compare(probes, False)
                    probes = []
        if built and units is None:
            units, names, copies = _units([r[2] for r in built], kind), np.array([r[0] for r in built]), np.array([r[1] for r in built])
            yield from compare(built, True)
        if built and probes:
            yield from compare(probes, False)

    sent = same.mapInArrow(lean(deal), "part int, probe boolean, class long, copies long, raw binary")
    sent = sent.repartitionById(dealt, F.pmod("part", F.lit(dealt)).cast("int")).sortWithinPartitions("part", "probe")
    return sent.mapInArrow(lean(meet), "a long, b long, linked long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: rows link whose vectors' cosine is ``cosine`` or more.

    component_id is the least id that links reach, itself included; kept marks the row of that id. n_links counts the
    other rows linked directly, equal vectors among them. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors of different lengths never link. A null id takes part, but
    names no component unless alone. Other columns are not used. No rows give no rows. ``cosine`` has to be over 0.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine has to lie in (0, 1]")
    rows, kind = _rows(vectors, id_col, vec_col)
    rows = rows.withColumn("class", F.when(F.col("raw").isNotNull(), F.xxhash64("raw")))
    classes = store(rows.where("raw is not null").groupBy("class", "raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    full = class_components(classes.drop("raw"), store(_links(classes, kind, cosine)))
    own = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = rows.select("vec_id", "class").join(full, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def brute_force(rows: list[tuple], cosine: float = COSINE) -> list[tuple]:
    """near_duplicates of (id, list) rows, for tests."""
    def fit(v) -> bool:
        return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    label, links = list(range(len(rows))), [0] * len(rows)

    def top(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if fit(v) and fit(w) and len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= cosine:
                links[i] += 1
                links[j] += 1
                label[max(top(i), top(j))] = min(top(i), top(j))
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, links[i], least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows)]
