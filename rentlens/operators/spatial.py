"""Spatial joins: cells as equi keys, exact predicates behind them.

On the sphere one side's points lie in one cell each, and the other side's are copied to the cells that the radius
touches; see cells. Both are shuffled by cell. Polygons are copied to the cells of their boxes, on a grid of their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.sinks import settled
from . import cells as of_cells
from .cells import EARTH_M, FARTHEST_M, KEY, SAMPLE, Cells, cells, on_earth  # noqa: F401

#: Pairs of points that a task looks at in one step.
PAIRS = 1 << 19
#: Parts that points are split into where all pairs are returned: much work for a cell, while each part copies the other side.
PARTS = 32
#: Where pairs are returned: rows of each side that a piece of a cell has (by a sample), those that are paired at once, tasks at most.
SLICE, TILE, TASKS = 1 << 17, 4096, 1 << 12


def within_radius(left: DataFrame, right: DataFrame, metres: float, left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat"), distance: str = "distance_m", made: Cells | None = None) -> DataFrame:
    """Pairs no farther apart than ``metres`` on the sphere; points that are null, or beyond a pole, pair with nothing.

    made: cells() of ``left``, if there are some; else they are made, which counts its rows.
    """
    made = made or cells(left, metres, *left_xy)
    a, b = (_dealt(df) for df in (made.home(left, *left_xy), made.touched(right, *right_xy)))
    d = geo.haversine(F.col(left_xy[0]), F.col(left_xy[1]), F.col(right_xy[0]), F.col(right_xy[1]))
    return a.join(b, list(KEY)).withColumn(distance, d).where(F.col(distance) <= metres).drop(*KEY)


def _dealt(rows: DataFrame, pieces: int = 0) -> DataFrame:
    """Dealt by cell to as many tasks as the session says: points are few bytes, which would be one task, but much work.

    pieces: what crowded cells were split into; tasks are as many, up to eight times what the session says.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, min(pieces, 8 * n)), *KEY)


Fold = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray], dict]


def folded(
    left: DataFrame, right: DataFrame, metres: float, fold: Fold, schema: str, order: tuple[str, ...] = (), left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat"), ready: Callable[[pa.Table], Any] | None = None, parts: int = 1
) -> DataFrame:
    """What ``fold`` makes of the pairs of within_radius(), in the task that finds them: pairs are not shuffled, and few are held at once.

    fold(a, b, i, j, d) gets some rows ``a`` of ``left``, all rows ``b`` of ``right`` in reach of their cell, in
    ``order`` (nulls first), and the pairs: row i of a, row j of b, distance d. Pairs come by i, then j, and all pairs
    of a row come together. It returns the columns of ``schema``. Rows without pairs are not seen.
    ready(b): made once a cell, and given to ``fold`` in place of b. parts: as of cells().
    """
    made = cells(left, metres, *left_xy, parts=parts)
    sides = ((made.home(left.where(on_earth(*left_xy)), *left_xy), left, left_xy, "__a"), (made.touched(right, *right_xy), right, right_xy, "__b"))
    a, b = (rows.select(*KEY, F.col(xy[0]).cast("double").alias("__x"), F.col(xy[1]).cast("double").alias("__y"), F.struct(*(f"`{c}`" for c in of.columns)).alias(name)) for rows, of, xy, name in sides)
    both = _dealt(a.unionByName(b, allowMissingColumns=True), sum(4**k for k in made.deep.values()) if parts > 1 else 0)
    return both.mapInArrow(lambda batches: _fold_cells(batches, metres, fold, order, ready), schema)


def _fold_cells(batches: Iterable[pa.RecordBatch], metres: float, fold: Fold, order: tuple[str, ...], ready: Callable[[pa.Table], Any] | None = None) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    sides = []
    for name in ("__a", "__b"):
        own = rows.filter(pc.is_valid(rows[name]))
        own = pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in own[name].chunks], schema=pa.schema(rows.schema.field(name).type)), own
        if name == "__b" and order:
            at = pc.sort_indices(own[0], sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
            own = own[0].take(at), own[1].take(at)
        key = np.stack([own[1][k].to_numpy() for k in KEY], axis=1) if own[1].num_rows else np.zeros((0, len(KEY)), np.int64)
        sides.append((own[0].combine_chunks(), key, *(own[1][c].to_numpy() for c in ("__x", "__y"))))
    (a, a_key, *a_at), (b, b_key, *b_at) = sides
    cell = np.unique(np.concatenate([a_key, b_key]), axis=0, return_inverse=True)[1].reshape(-1)
    a_cell, b_cell = cell[: len(a_key)], cell[len(a_key) :]
    a_by, b_by = (np.argsort(c, kind="stable") for c in (a_cell, b_cell))
    a_cell, b_cell = a_cell[a_by], b_cell[b_by]
    unit = lambda x, y: np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)
    a_unit, b_unit = (unit(*np.radians(at)) for at in (a_at, b_at))
    least = np.cos(min(metres / EARTH_M, np.pi)) - 4e-15  # a little more than the radius; the distance itself decides
    for c in np.unique(a_cell):
        mine, theirs = (by[np.searchsorted(k, c) : np.searchsorted(k, c, "right")] for by, k in ((a_by, a_cell), (b_by, b_cell)))
        if not len(theirs):
            continue
        there, step = b.take(theirs), max(1, PAIRS // len(theirs))
        there = ready(there) if ready else there
        other, rx, ry = b_unit[theirs].T, b_at[0][theirs], b_at[1][theirs]
        for k in range(0, len(mine), step):
            own = mine[k : k + step]
            i, j = np.nonzero(a_unit[own] @ other >= least)
            x, y = a_at[0][own][i], a_at[1][own][i]
            # As geo.haversine(): differences in degrees first, which keeps the digits that roundings look at.
            h = np.sin(np.radians(ry[j] - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(ry[j])) * np.sin(np.radians(rx[j] - x) / 2) ** 2
            d = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
            near = d <= metres
            if near.any():
                yield pa.RecordBatch.from_pydict(fold(a.take(own), there, i[near], j[near], d[near]))


def pairs_near(left: DataFrame, right: DataFrame, metres: float, columns: tuple[str, ...], right_columns: tuple[str, ...], digits: int = 3, distance: str = "distance_m", left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat")) -> DataFrame:
    """The pairs of within_radius(), with these columns of both sides and the distance rounded to ``digits``.

    Pairs leave the task that finds them. Of a crowded cell slices of both sides meet, and a task holds one pair of
    slices at a time, however many rows there are; only equal rows can't be told apart, and stay in one slice. The pairs of TILE rows a side come by distance, then by place: files hold distances as runs, and ids
    as short numbers. within_radius() keeps all columns and digits.
    """
    types = {f.name: f.dataType.simpleString() for df in (left, right) for f in df.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in (*((c, types[c]) for c in (*columns, *right_columns)), (distance, "double")))
    both, pieces = _sliced(left, right, metres, columns, right_columns, left_xy, right_xy)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(max(n, min(4 * pieces, TASKS)), *KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(lambda batches: _pair_cells(batches, metres, digits, distance), schema)


def _sliced(left: DataFrame, right: DataFrame, metres: float, columns: tuple[str, ...], right_columns: tuple[str, ...], left_xy, right_xy) -> tuple[DataFrame, int]:
    """Rows of both sides by cell, as __a or __b with their places, and the number of pieces that crowded cells make.

    A cell with more work than one of PARTS, or with more than SLICE rows of a side, is dealt by place: each slice of
    one side meets each of the other. Many points in one place are dealt by a hash of the row. Sizes are read off samples.
    """
    plain = Cells(metres)
    sides = [
        df.where(on_earth(*xy)).select(F.col(xy[0]).cast("double").alias("__lon"), F.col(xy[1]).cast("double").alias("__lat"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("__r"))
        for df, xy, own in ((left, left_xy, columns), (right, right_xy, right_columns))
    ]
    count = [0, 0]
    for k, n in sides[0].select(F.lit(0).alias("k")).unionAll(sides[1].select(F.lit(1))).groupBy("k").count().collect():
        count[k] = n
    shares = [min(1.0, SAMPLE / max(n, 1)) for n in count]
    place = (plain.home, plain.touched)
    sizes, top = ({}, {}), 0.0
    if max(count) > of_cells.FEW:
        seen = [place[k](sides[k].select("__lon", "__lat").sample(shares[k], seed=11), "__lon", "__lat").select(F.lit(k).alias("k"), *KEY[:2], "__lon", "__lat") for k in (0, 1)]
        spots = seen[0].unionAll(seen[1]).groupBy("k", *KEY[:2], "__lon", "__lat").count()
        for k, cy, cx, n, most in spots.groupBy("k", *KEY[:2]).agg(F.sum("count"), F.max("count")).collect():  # as many as sampled rows, or the cells that they touch
            sizes[k][cy, cx] = n / shares[k]
            top = max(top, most / shares[k])
    work = {c: n * sizes[1].get(c, 0) for c, n in sizes[0].items()}
    rows = min(SLICE, max(of_cells.FEW, math.sqrt(sum(work.values()) / PARTS)))
    slices = [(*c, *(max(1, math.ceil(s.get(c, 0) / rows)) for s in sizes)) for c in {**sizes[0], **sizes[1]}]
    slices = [x for x in slices if x[2] * x[3] > 1]
    alike = math.ceil(16 * top / rows)
    out = []
    for k, rows_of in enumerate(sides):
        rows_of = place[k](rows_of, "__lon", "__lat").drop(*KEY[2:])
        told = [F.col("__r").getField(f.name) for f in rows_of.schema["__r"].dataType if "map<" not in f.dataType.simpleString()]
        spread = F.xxhash64("__lon", "__lat", *([F.pmod(F.xxhash64(*told), F.lit(alike))] if told and alike > 1 else []))
        mine, other = F.lit(1), F.lit(1)
        if slices:
            made = rows_of.sparkSession.createDataFrame(slices, f"{KEY[0]} int, {KEY[1]} int, __n0 int, __n1 int")
            rows_of = rows_of.join(F.broadcast(made), list(KEY[:2]), "left")
            mine, other = (F.coalesce(f"__n{x}", F.lit(1)) for x in (k, 1 - k))
        of = {KEY[2 + k]: F.pmod(spread, mine).cast("int"), KEY[3 - k]: F.explode(F.sequence(F.lit(0), other - 1)) if slices else F.lit(0)}
        rows_of = rows_of.select(*KEY[:2], *(of[x].alias(x) for x in KEY[2:4]), F.lit(0).alias(KEY[4]), "__lon", "__lat", F.col("__r").alias(("__a", "__b")[k]))
        out.append(rows_of)
    return out[0].unionByName(out[1], allowMissingColumns=True), sum(x[2] * x[3] for x in slices)


def _by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell in turn; they come by cell."""
    held, last = [], None
    for b in batches:
        keys = np.stack([b.column(k).to_numpy() for k in KEY], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                last = tuple(keys[lo])
    if held:
        yield pa.Table.from_batches(held)


def _pair_cells(batches: Iterable[pa.RecordBatch], metres: float, digits: int, distance: str) -> Iterator[pa.RecordBatch]:
    for rows in _by_cell(batches):
        if not 0 < rows["__a"].null_count < rows.num_rows:
            continue
        sides = []
        for name in ("__a", "__b"):
            own = rows.filter(pc.is_valid(rows[name])).select([name, "__lon", "__lat"]).combine_chunks()
            own = own.take(np.lexsort((own["__lat"].to_numpy(), own["__lon"].to_numpy())))
            sides.append((pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in own[name].chunks]), own["__lon"].to_numpy(), own["__lat"].to_numpy()))
        (a, x, y), (b, rx, ry) = sides
        for lo in range(0, b.num_rows, TILE):
            there = b.slice(lo, TILE).combine_chunks()
            for at in range(0, a.num_rows, TILE):
                here = a.slice(at, TILE).combine_chunks()
                near = _near(x[at : at + TILE], y[at : at + TILE], rx[lo : lo + TILE], ry[lo : lo + TILE], metres, digits)
                for k in range(0, len(near), PAIRS):
                    d, pair = np.divmod(near[k : k + PAIRS], here.num_rows * there.num_rows)
                    i, j = np.divmod(pair, there.num_rows)
                    out = {c: t[c].take(pa.array(of)).combine_chunks() for t, of in ((here, i), (there, j)) for c in t.column_names}
                    yield pa.RecordBatch.from_pydict({**out, distance: d / 10**digits})


def _near(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, metres: float, digits: int) -> np.ndarray:
    """Pairs in reach in order of distance, row and other row, these three as one number; distances in units of the last digit."""
    if (metres * 10**digits + 1) * len(x) * len(rx) >= 1 << 63:
        raise ValueError("too many digits for this radius")
    unit = lambda x, y: np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)
    own, other = unit(*np.radians((x, y))), unit(*np.radians((rx, ry))).T
    least = np.cos(min(metres / EARTH_M, np.pi)) - 4e-15  # a little more than the radius; the distance itself decides
    cosines, r_cosines = np.cos(np.radians(y)), np.cos(np.radians(ry))
    found, n, step = np.empty(len(x) * len(rx), np.int64), 0, max(1, PAIRS // len(rx))
    for k in range(0, len(x), step):
        i, j = np.nonzero(own[k : k + step] @ other >= least)
        i += k
        # As geo.haversine(): differences in degrees first, which keeps the digits that roundings look at.
        h = np.sin(np.radians(ry[j] - y[i]) / 2) ** 2 + cosines[i] * r_cosines[j] * np.sin(np.radians(rx[j] - x[i]) / 2) ** 2
        d = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        near = d <= metres
        m = n + np.count_nonzero(near)
        found[n:m] = (np.floor(d[near] * 10**digits + 0.5).astype(np.int64) * len(x) + i[near]) * len(rx) + j[near]
        n = m
    found[:n].sort()
    return found[:n]


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds what is not negative: halves go up."""
    return np.floor(d * 10**digits + 0.5) / 10**digits


def first_rows(*by: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Of each run of equal i, the pair that is least by the columns in turn; the first one among equals."""
    at = np.arange(len(i))
    for values in by:
        starts = np.flatnonzero(np.diff(i[at], prepend=-1))
        runs = np.diff(np.append(starts, len(at)))
        at = at[values[at] == np.repeat(np.minimum.reduceat(values[at], starts), runs)]
    return at[np.flatnonzero(np.diff(i[at], prepend=-1))]


def _by_neighbor(left: DataFrame, right: DataFrame, metres: float, left_xy, right_xy, how: str) -> DataFrame:
    made = cells(left, metres, *left_xy)
    a, b = made.home(left, *left_xy), made.touched(right.select(*right_xy), *right_xy)
    b = b.withColumnsRenamed({k: f"__r{k}" for k in KEY})
    near = geo.haversine(F.col(left_xy[0]), F.col(left_xy[1]), F.col(right_xy[0]), F.col(right_xy[1])) <= metres
    for k in KEY:
        near &= F.col(k) == F.col(f"__r{k}")
    return a.join(b, near, how).drop(*KEY)


def without_neighbor(left: DataFrame, right: DataFrame, metres: float, left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat")) -> DataFrame:
    """Rows of ``left`` with no point of ``right`` within ``metres``."""
    return _by_neighbor(left, right, metres, left_xy, right_xy, "left_anti")


def with_neighbor(left: DataFrame, right: DataFrame, metres: float, left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat")) -> DataFrame:
    """Rows of ``left`` with a point of ``right`` within ``metres``."""
    return _by_neighbor(left, right, metres, left_xy, right_xy, "left_semi")


def _all_found(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, metres: float, left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat")) -> DataFrame:
    """(key, nearest, distance_m) of the nearest point of ``right``, ties to the least right_key.

    The radius doubles for the rows that found nothing, until all have or the earth is seen; a row that found one is
    settled, as every point within the radius was seen. Where ``right`` is crowded the first radius is smaller, halved
    for each split of its most crowded cell, so that rows there meet few points. A round is written out, so none is
    computed again. Rows with null points are left out, and all rows where ``right`` has no point. Keys have to differ.
    """
    left = left.select(key, *left_xy).where(on_earth(*left_xy))
    right = settled(right.select(right_key, *right_xy).where(on_earth(*right_xy)))
    metres /= 2 ** max([0, *cells(right, metres, *right_xy).deep.values()])
    types = f"k {left.schema[key].dataType.simpleString()}, id {right.schema[right_key].dataType.simpleString()}, d double"

    def closest(a, b, i, j, d):
        at = first_rows(d, i=i)
        return {"k": a[key].take(i[at]).combine_chunks(), "id": b[right_key].take(j[at]).combine_chunks(), "d": d[at]}

    todo, rounds = settled(left), []
    while True:
        seen = folded(todo, right, metres, closest, types, (right_key,), left_xy, right_xy)
        best = seen.groupBy("k").agg(F.min(F.struct("d", "id")).alias("b")).select(F.col("k").alias(key), F.struct(F.col("b.d").alias("distance_m"), "b.id").alias("b"))
        rounds.append(settled(best.select(key, F.col("b.id").alias("nearest"), F.col("b.distance_m").alias("distance_m"))))
        todo = settled(todo.join(rounds[-1].select(key), key, "left_anti"))
        if metres >= FARTHEST_M or todo.isEmpty() or right.isEmpty():
            return _all_found(rounds)
        metres *= 2


def _boxed(polygons: DataFrame, rings: str, size: float, reach: float = 0.0, name: str = "__b") -> DataFrame:
    """Polygons with their boxes, wider by ``reach``, and the level of the grid (cells of size * 2 ** level) where a box touches four cells at most."""
    b = geo.bbox(F.col(rings))
    wide = F.struct(*((b[k] - reach).alias(k) for k in ("x0", "y0")), *((b[k] + reach).alias(k) for k in ("x1", "y1")))
    p = polygons.withColumn(name, wide).where(F.col(f"{name}.x0").isNotNull())
    extent = F.greatest(F.col(f"{name}.x1") - F.col(f"{name}.x0"), F.col(f"{name}.y1") - F.col(f"{name}.y0"))
    return p.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent / size, F.lit(1e-300))))).cast("int"))


def _touched(boxed: DataFrame, size: float, name: str = "__b") -> DataFrame:
    wide = size * F.pow(2.0, F.col("__level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"{name}.{lo}") / wide), F.floor(F.col(f"{name}.{hi}") / wide))
    return boxed.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))


def _levels(boxed: DataFrame) -> list[int]:
    """The levels that there are: no more than a number has binary orders."""
    return sorted(r[0] for r in boxed.select("__level").distinct().collect())


def polygons_at(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, size: float, reach: float = 0.0) -> DataFrame:
    """Pairs of a point and a polygon whose box, wider by ``reach``, holds it: the candidates for exact predicates.

    A polygon goes to the grid of its size, where its box touches four cells at most, and a point to one cell of each
    grid that there is, from cells of ``size`` up.
    """
    boxed = _boxed(polygons, rings, size, reach)
    levels = _levels(boxed)
    q = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    wide = size * F.pow(2.0, F.col("__level"))
    q = q.withColumns({"__cx": F.floor(F.col(x) / wide), "__cy": F.floor(F.col(y) / wide)})
    held = F.col(x).between(F.col("__b.x0"), F.col("__b.x1")) & F.col(y).between(F.col("__b.y0"), F.col("__b.y1"))
    return q.join(_touched(boxed, size), ["__level", "__cx", "__cy"]).where(held).drop("__level", "__cx", "__cy", "__b")


def polygon_pairs(left: DataFrame, right: DataFrame, rings: str, right_rings: str, size: float) -> DataFrame:
    """Pairs of polygons that share a point, once each.

    A polygon goes to the grid of its size; each side also goes to the coarser grids that the other side uses, so the
    smaller of two meets the larger on the larger's grid, in the cell of their boxes' common corner.
    """
    a, b = _boxed(left, rings, size, name="__a"), _boxed(right, right_rings, size, name="__b")
    levels = sorted({*_levels(a), *_levels(b)})
    at = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")

    def on_grids(boxed: DataFrame, name: str) -> DataFrame:
        up = boxed.withColumnRenamed("__level", f"{name}_own").withColumn("__level", F.explode(F.filter(at, lambda v: v >= F.col(f"{name}_own"))))
        return _touched(up, size, name)

    pairs = on_grids(a, "__a").join(on_grids(b, "__b"), ["__level", "__cx", "__cy"]).where(F.col("__level") == F.greatest("__a_own", "__b_own"))
    wide = size * F.pow(2.0, F.col("__level"))
    x, y = F.greatest("__a.x0", "__b.x0"), F.greatest("__a.y0", "__b.y0")
    one = (F.floor(x / wide) == F.col("__cx")) & (F.floor(y / wide) == F.col("__cy"))
    boxes = (x <= F.least("__a.x1", "__b.x1")) & (y <= F.least("__a.y1", "__b.y1"))
    return pairs.where(one & boxes).where(geo.intersects(F.col(rings), F.col(right_rings))).drop("__a", "__b", "__a_own", "__b_own", "__level", "__cx", "__cy")


def containing(points: DataFrame, polygons: DataFrame, key: str, x: str, y: str, rings: str, order: list[str], size: float) -> DataFrame:
    """The smallest polygon that covers each point; ties by ``order``. Points in none are left out."""
    found = polygons_at(points, polygons, x, y, rings, size).where(geo.covers(F.col(x), F.col(y), F.col(rings)))
    found = found.withColumn("__w", F.struct(geo.area(F.col(rings)).alias("area"), *order))
    return found.groupBy(key).agg(F.min("__w").alias("w")).select(key, "w.*")


def polygons_within(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, reach: float, distance: str = "distance_m") -> DataFrame:
    """Pairs of a point and a polygon no farther than ``reach`` from it; 0 inside."""
    found = polygons_at(points, polygons, x, y, rings, reach, reach)
    return found.withColumn(distance, geo.polygon_distance(F.col(x), F.col(y), F.col(rings))).where(F.col(distance) <= reach)


def nearest_polygon(points: DataFrame, polygons: DataFrame, key: str, polygon_key: str, x: str, y: str, rings: str, reach: float) -> DataFrame:
    """(key, nearest, distance_m) of the nearest polygon, ties to the least key; equal points are measured once.

    The reach doubles for the points that found nothing, until all have or it spans everything. A round is written out.
    Points that are null are left out, and all points where there is no polygon.
    """
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    box = geo.bbox(F.col(rings))
    p = polygons.where(F.size(rings) > 0).select(box.alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).first()
    q = spots.agg(F.min("__x"), F.min("__y"), F.max("__x"), F.max("__y")).first()
    if p[0] is None or q[0] is None:
        widest = 0.0
    else:
        widest = math.hypot(max(p[2], q[2]) - min(p[0], q[0]), max(p[3], q[3]) - min(p[1], q[1]))
    todo, rounds = spots, []
    while True:
        pairs = polygons_within(todo, polygons, "__x", "__y", rings, reach)
        best = pairs.groupBy("__x", "__y").agg(F.min(F.struct("distance_m", F.col(polygon_key).alias("id"))).alias("b"))
        rounds.append(settled(best))
        todo = settled(todo.join(rounds[-1].select("__x", "__y"), ["__x", "__y"], "left_anti"))
        if reach >= widest or todo.isEmpty():
            break
        reach *= 2
    out = _all_found(rounds)
    return points.join(out.withColumnsRenamed({"__x": x, "__y": y}), [x, y]).select(key, F.col("b.id").alias("nearest"), F.col("b.distance_m").alias("distance_m"))


def balance(listings: DataFrame, permits: DataFrame, size: float = 500.0, reach: float = 0.0) -> DataFrame:
    """Distinct listings and permits by cell (cx, cy), with those of cells no farther than ``reach``; empty cells go.

    listings: listing_id, cx, cy. permits: parcel, cx, cy; a parcel counts once, in its least cell.
    """
    a = listings.groupBy("listing_id").agg(F.min(F.struct("cx", "cy")).alias("c")).groupBy("c.cx", "c.cy").agg(F.count("*").alias("listings"), F.lit(0).cast("long").alias("permits"))
    b = permits.groupBy("parcel").agg(F.min(F.struct("cx", "cy")).alias("c")).groupBy("c.cx", "c.cy").agg(F.lit(0).cast("long").alias("listings"), F.count("*").alias("permits"))
    own = a.unionByName(b).groupBy("cx", "cy").agg(F.sum("listings").alias("listings"), F.sum("permits").alias("permits"))
    k = math.ceil(reach / size)
    steps = [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if math.hypot(dx * size, dy * size) <= reach]
    if len(steps) > 1:
        moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))
        own = own.withColumn("m", F.explode(moves)).select((F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy"), "listings", "permits")
        own = own.groupBy("cx", "cy").agg(F.sum("listings").alias("listings"), F.sum("permits").alias("permits"))
    return own.withColumn("difference", F.col("listings") - F.col("permits"))


def stacked(points: DataFrame, lon: str, lat: str, order: str) -> DataFrame:
    """``points`` with the size of each stack of equal points and the place in it, from 0."""
    same = Window.partitionBy(lon, lat)
    return points.withColumns({"stack": F.count("*").over(same), "place": F.row_number().over(same.orderBy(order)) - 1})
