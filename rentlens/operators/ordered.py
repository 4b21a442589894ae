"""Work that follows an order, over tasks: numbering, size-bounded chunks, checksums of blocks.

Rows are dealt by ranges of the order and written down, so that a range is the same rows whoever asks. What a range
has to know of those before it is a few numbers: how many rows they had, or what was left in a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import settled

#: Rows of a range, about; ranges are as many as that asks for, and at least as the session says.
RANGE_ROWS = 1_000_000


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with __range: consecutive ranges of the order, written out. Equal rows of the order are of one range."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    return settled(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


def numbered(df: DataFrame, order: str, per: list[str] | None = None, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in the order, from 0; within equal ``per`` columns, if given. Ties as they come.

    A row's place is its place in its range and the rows of the ranges before it; no task holds more than a range.
    """
    per = per or []
    keys = [f"`{p}`" for p in per]
    rows = ranged(df, *keys, order)
    inner = Window.partitionBy("__range", *keys).orderBy(order)
    rows = rows.withColumn("__at", F.row_number().over(inner) - 1)
    sizes = rows.groupBy("__range", *keys).agg(F.count("*").alias("__n"))
    # One row for each range and group: a group has as many as it spans ranges, all rows together as many as there are ranges.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col("a.__range") == F.col("b.__range")
    for p in keys:
        same &= F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))
    out = rows.alias("a").join(sizes.alias("b"), same)
    return out.select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("__at") + F.col("__before")).alias(name))


def parts(df: DataFrame, order: str, size: int, per: list[str] | None = None) -> DataFrame:
    """``df`` with part: rows in order, ``size`` to a part; numbered within equal ``per`` columns, if given."""
    out = numbered(df, order, per, "__place")
    return out.withColumn("part", F.floor(F.col("__place") / F.lit(size))).drop("__place")


def _breaks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums before each row; the row where a chunk that starts at each row ends; the first row from each that is not empty."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    filled = np.append(np.where(sizes > 0, np.arange(n), n), n)
    filled = np.minimum.accumulate(filled[::-1])[::-1][:n]
    over = np.searchsorted(sums[1:], sums[:-1] + most, "right")  # the first row that would pass the limit
    return sums, np.maximum(over, np.minimum(filled + 1, n)), filled


def _entry(sums: np.ndarray, filled: np.ndarray, most: int, carry: int) -> int:
    """The first row of the next chunk, for what is already in the chunk."""
    n = len(sums) - 1
    at = int(np.searchsorted(sums[1:], most - carry, "right"))
    return max(at, 0 if carry > 0 else min(int(filled[0]) + 1, n) if n else 0)


def transfer(sizes: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """What a run of rows does to a chunk: (least, chunks, kept, adds) by what the chunk already holds, from ``least`` up.

    chunks: how many new ones begin; then the last holds ``adds`` and, where ``kept`` is 1, what was there before.
    Runs of equal outcomes are one entry, so there are at most as many as rows fit into a chunk, and mostly few.
    """
    sums, following, filled = _breaks(sizes, most)
    n = len(sizes)
    depth, last = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            depth[i], last[i] = depth[following[i]] + 1, last[following[i]]
    starts = sorted({0, 1, *(int(max(most - s + 1, 0)) for s in sums[1:] if s <= most + 1)})
    out: list[tuple[int, int, int, int]] = []
    for carry in starts:
        at = _entry(sums, filled, most, carry)
        now = (0, 1, int(sums[-1])) if at >= n else (int(depth[at]) + 1, 0, int(sums[-1] - sums[last[at]]))
        if not out or out[-1][1:] != now:
            out.append((carry, *now))
    return out


def chunks_of(sizes: np.ndarray, most: int, chunk: int = 0, carry: int = 0) -> np.ndarray:
    """The chunk of each row, where ``carry`` is in ``chunk`` already."""
    sums, following, filled = _breaks(sizes, most)
    n = len(sizes)
    fresh = np.zeros(n, np.int64)
    at = _entry(sums, filled, most, carry)
    while at < n:
        fresh[at] = 1
        at = int(following[at])
    return chunk + np.cumsum(fresh)


def size_chunks(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """``df`` with chunk: rows of a group in order, a new chunk where the next row would pass ``most``.

    A larger row has a chunk of its own; sizes are whole numbers, not under 0, and a null counts as 0. A range folds
    for whatever its predecessors may have left in the chunk; the driver goes through these tables once, one range at a
    time, and each range then folds with what was really left. So a group may span any number of tasks.
    """
    rows = ranged(df, group, order)
    within = Window.partitionBy("__range")
    rows = settled(rows.withColumns({"__i": F.row_number().over(within.orderBy(group, order)), "__group": F.dense_rank().over(within.orderBy(group)), "__size": F.coalesce(F.col(size), F.lit(0)).cast("long")}))
    entry = "array<struct<least:long,chunks:long,kept:long,adds:long>>"

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        groups, sizes, names = pdf["__group"].to_numpy(), pdf["__size"].to_numpy(np.int64), pdf["__name"]
        told = lambda s: [dict(zip(("least", "chunks", "kept", "adds"), t, strict=True)) for t in transfer(s, most)]
        one = (int(pdf["__range"].iloc[0]), names.iloc[0], names.iloc[-1], int(groups[-1]), told(sizes[groups == 1]), told(sizes[groups == groups[-1]]))
        return pd.DataFrame([one], columns=["__range", "first", "last", "groups", "head", "tail"])

    def after(entries, chunk: int, carry: int) -> tuple[int, int]:
        one = [e for e in entries if e["least"] <= carry][-1]
        return chunk + one["chunks"], one["adds"] + (carry if one["kept"] else 0)

    slim = rows.select("__range", "__i", "__group", "__size", F.to_json(F.struct(F.col(group).alias("g"))).alias("__name"))
    told = settled(slim.groupBy("__range").applyInPandas(summed, f"__range int, first string, last string, groups long, head {entry}, tail {entry}"))
    begins, held = [], ("", 0, 0)  # the group that a range ends in, its chunk, and what that holds
    for r in told.orderBy("__range").toLocalIterator():
        start = held[1:] if held[0] == r["first"] else (0, 0)
        begins.append((r["__range"], *start))
        held = (r["last"], *(after(r["head"], *start) if r["groups"] == 1 else after(r["tail"], 0, 0)))
    known = df.sparkSession.createDataFrame(begins, "__range int, __chunk long, __carry long")  # a row a range
    schema = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, own in pdf.sort_values("__i").groupby("__group"):
            start = (int(own["__chunk"].iloc[0]), int(own["__carry"].iloc[0])) if number == 1 else (0, 0)
            out.append(own.assign(chunk=chunks_of(own["__size"].to_numpy(np.int64), most, *start)))
        return pd.concat(out)[[f.name for f in schema]]

    return rows.join(F.broadcast(known), "__range").groupBy("__range").applyInPandas(fold, schema)


def hash_tree(df: DataFrame, part: str, order: str, value: str, block: int = 1000, fan: int = 16, top: int | None = None) -> DataFrame:
    """(part, level, block, rows, sha256): checksums of each part's values in order, ``block`` rows at a time, and a tree above them.

    Level 0 hashes the values of a block, joined by line feeds; each higher one the checksums of ``fan`` blocks below,
    up to one root a part, or up to level ``top`` if given. A null value counts as empty. Ties of the order are in the order of their values. No task
    holds more than a range of rows, or ``fan`` checksums, of a part.
    """
    if block < 1 or fan < 2:
        raise ValueError("a block has a row, a node two children, at least")
    given = df.select(F.col(part).alias("part"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v")).alias("at"))
    placed = numbered(given, "at", ["part"])
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "at.v"))), lambda x: x.v), "\n")
    level = settled(placed.groupBy("part", F.floor(F.col("place") / block).alias("block")).agg(F.count("*").alias("rows"), F.sha2(inner, 256).alias("sha256")).withColumn("level", F.lit(0)))
    levels = [level]
    while (top is None or len(levels) <= top) and (level.agg(F.max("block")).first()[0] or 0) > 0:
        held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x.sha256), "\n")
        # A part that has its root already is not hashed again.
        wide = level.join(level.where("block > 0").select("part").distinct().withColumnRenamed("part", "__p"), F.col("part").eqNullSafe(F.col("__p")), "left_semi")
        level = settled(wide.groupBy("part", F.floor(F.col("block") / fan).alias("up")).agg(F.sum("rows").alias("rows"), F.sha2(held, 256).alias("sha256")).withColumnRenamed("up", "block").withColumn("level", F.lit(len(levels))))
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out.select(F.col("part").alias(part), "level", "block", "rows", "sha256")


def tampered(known: DataFrame, now: DataFrame, part: str) -> DataFrame:
    """(part, block) of the lowest blocks that differ between two hash trees, or that one of them lacks."""
    leaves = lambda t, c: t.where("level = 0").select(F.col(part).alias("part"), "block", F.col("sha256").alias(c))
    a, b = leaves(known, "a").alias("k"), leaves(now, "b").alias("n")
    both = a.join(b, F.col("k.part").eqNullSafe(F.col("n.part")) & (F.col("k.block") == F.col("n.block")), "full")
    gone = ~F.col("a").eqNullSafe(F.col("b"))
    return both.where(gone).select(F.coalesce("k.part", "n.part").alias(part), F.coalesce("k.block", "n.block").alias("block"))
