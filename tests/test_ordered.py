"""Numbering, size-bounded chunks and checksums over tasks, against plain folds."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rentlens.operators import merge, ordered


def fold(sizes, most, chunk=0, total=0):
    out = []
    for n in sizes:
        if total and total + n > most:
            chunk, total = chunk + 1, 0
        total += n
        out.append(chunk)
    return out, chunk, total


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=30), st.integers(1, 20), st.integers(0, 25))
def test_transfer_and_chunks(sizes, most, carry):
    want, chunk, total = fold(sizes, most, 5, carry)
    assert ordered.chunks_of(np.array(sizes), most, 5, carry).tolist() == want
    one = [e for e in ordered.transfer(np.array(sizes), most) if e[0] <= carry][-1]
    assert (5 + one[1], one[3] + (carry if one[2] else 0)) == (chunk, total)


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_chunks_of_groups_over_ranges(spark, monkeypatch, groups):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 37)
    rng = random.Random(groups)
    rows = [(i, f"g{i % groups}" if i % 11 else None, rng.choice([0, 1, 5, 30, 99, 300]), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, n int, chunks string")
    assert ordered.ranged(df, "g", "i").select("__range").distinct().count() > 8
    got = {r.i: r.chunk for r in merge.size_chunks(df, "g", "i", "n", 100).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        want |= dict(zip((r[0] for r in own), fold([r[2] for r in own], 100)[0]))
    assert got == want


def test_numbering_has_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    df = spark.range(900).select(F.col("id"), F.xxhash64("id").alias("o"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), F.lit(1).alias("__x"))
    rows = df.collect()
    order = {r.id: i for i, r in enumerate(sorted(rows, key=lambda r: r.o))}
    assert {r.id: r.part for r in merge.parts(df, "o", 13).collect()} == {i: n // 13 for i, n in order.items()}
    by = {}
    for r in sorted(rows, key=lambda r: r.o):
        by.setdefault(r.g, []).append(r.id)
    assert {r.id: r.place for r in ordered.numbered(df, "o", ["g"]).collect()} == {i: n for ids in by.values() for n, i in enumerate(ids)}
    assert merge.parts(df.limit(0), "o", 5).count() == 0
    plan = merge.parts(df, "o", 13)._jdf.queryExecution().executedPlan().toString()
    ranges = [line for line in plan.split("\n") if "Window" in line and "row_number" in line]
    assert ranges and all("__range" in line for line in ranges)


def test_hash_tree_names_the_block(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    rows = [(i, None if i < 5 else "ab"[i % 2], f"v{i}" if i % 10 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p string, v string")
    tree = ordered.hash_tree(df, "p", "i", "v", 8, 3)
    digest = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    want = set()
    for p in (None, "a", "b"):
        values = [v or "" for _, q, v in rows if q == p]
        level = [(len(values[k : k + 8]), digest(values[k : k + 8])) for k in range(0, len(values), 8)]
        depth = 0
        while True:
            want |= {(p, depth, b, n, h) for b, (n, h) in enumerate(level)}
            if len(level) == 1:
                break
            level, depth = [(sum(n for n, _ in level[k : k + 3]), digest([h for _, h in level[k : k + 3]])) for k in range(0, len(level), 3)], depth + 1
    assert {tuple(r) for r in tree.collect()} == want
    bad = df.withColumn("v", F.when(F.col("i") == 201, "other").otherwise(F.col("v"))).where("i < 295")
    found = {tuple(r) for r in ordered.tampered(tree, ordered.hash_tree(bad, "p", "i", "v", 8, 3), "p").collect()}
    at = lambda i: (rows[i][1], [r[0] for r in rows if r[1] == rows[i][1]].index(i) // 8)
    assert found == {at(201), *(at(i) for i in range(295, 300))}


def test_hash_tree_ends_at_the_level_that_is_asked_for(spark):
    df = spark.range(300).selectExpr("id AS i", "'a' AS p", "string(id) AS v")
    whole, cut = (ordered.hash_tree(df, "p", "i", "v", 8, 3, top) for top in (None, 2))
    assert {r[0] for r in whole.select("level").distinct().collect()} == {0, 1, 2, 3, 4}
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in whole.where("level <= 2").collect()}


def test_block_checksums_of_large_nations_end_where_their_sql_does(spark, tmp_path):
    import duckdb

    from rentlens.plans import registry

    spark.range(2500).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "int(3) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["block_checksums"](spark, str(tmp_path)).select("c_nationkey", "level", "block", "rows", "sha256")
    db = duckdb.connect()
    db.execute(f"create view customer as from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(registry.ORACLES["block_checksums"]).fetchall())
