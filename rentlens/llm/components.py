"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store
from .textkernel import lean

#: Links that one task joins at once; more go through rounds until no more than that are left.
AT_ONCE = 1 << 18


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Link every node's larger (both) or other smaller neighbours, and itself, to its least neighbour."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.union(turned) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = store(seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    near = seen.join(least, "a")
    if both:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node that is not the least of its tree, with that one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = [x for x in up if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node reachable.

    AT_ONCE links or fewer, which rounds of stars may have left, are joined in one task by trees. Each round links nodes to the least neighbour (large star, then small star); a chain of n nodes takes about
    log n rounds. A hub is a key with many rows in a join that Spark may split, never a collected list. Null ends
    and self links are dropped; no edges give no rows.
    """
    now = store(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] <= AT_ONCE:
            now = now.coalesce(1).mapInArrow(lean(_joined), "a long, b long")
            break
        new = store(_stars(_stars(now, True), False))
        before, mark, now = mark, _mark(new), new
        if before == mark:
            break
    else:
        raise RuntimeError("the components did not settle")
    now = store(now)
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return pairs.union(pairs.select(F.col("label").alias("node"), "label").distinct())


def class_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, component_id, n_links) of every class of equal rows.

    classes: class, first (least id) and copies. links: tree edges a, b between classes, and rows with b null that
    add ``linked`` directly linked rows to class a. n_links counts the other rows of the class too. Written out, so
    that rows join it by class without a key that holds them together.
    """
    members = components(links.where("b is not null").select("a", "b"))
    members = store(members.join(classes, F.col("node") == F.col("class")).select("node", "label", "first"))
    least = store(members.groupBy("label").agg(F.min("first").alias("least")))
    named = members.join(least, "label").select(F.col("node").alias("class"), "least")
    degree = links.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("linked").alias("linked"))
    full = classes.join(named, "class", "left").join(degree, "class", "left")
    return store(full.select("class", F.coalesce("least", "first").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))


def forest(a, b):
    """The links of two arrays that join trees not yet joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            yield x, y
