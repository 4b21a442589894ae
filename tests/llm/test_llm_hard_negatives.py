"""Hard negatives against brute force, SQL and edge rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.llm import hard_negatives, queries

SF1 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<double>"


def _mined(spark, rows, every=5, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", rank int, key string, score double")
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect()))


def _small(monkeypatch):
    for name, n in (("SAMPLED", 24), ("CELL", 8), ("CHUNK", 5), ("PROBES", 16), ("SLICE", 40)):
        monkeypatch.setattr(hard_negatives, name, n)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, monkeypatch, seed):
    _small(monkeypatch)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5)) * [1, 3, 0.2][seed - 1]
    x = centres[rng.integers(0, 6, 260)] + rng.normal(size=(260, 5)) * 0.2
    x[:70] = x[0]  # copies, with ties
    x = np.round(x * 8) / 8 if seed == 1 else x
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    want = sorted(hard_negatives.brute_force(rows, lambda i: i % 5 == 0))
    assert _mined(spark, rows) == want and len(want) > 50


def test_bounds_prune(spark, monkeypatch):
    """Rows far from a cell are not copied to it."""
    _small(monkeypatch)
    monkeypatch.setattr(hard_negatives, "SAMPLED", 200)
    monkeypatch.setattr(hard_negatives, "CELL", 3)
    rng = np.random.default_rng(0)
    centres = np.eye(8) * 4
    rows = [(i, int(i % 3), (centres[i % 8] + rng.normal(size=8) * 0.02).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    own = hard_negatives._whole(df, 256, "vec_id", "label", "embedding")
    asked = own.where("vec_id % 5 = 0")
    spaces = hard_negatives._spaces(own, asked)
    need = hard_negatives._asked(asked.withColumn("scores", F.lit(None).cast("array<long>")), spaces, 2, True, 50, 95).toPandas()
    x = hard_negatives._matrix([bytes(r) for r in own.toPandas().raw], [2] * 600, 8)
    d = spaces[8].apart(x, False)
    reached = sum(((d[:, r.cell] - r.apart <= r.far) & (d[:, r.cell] + r.apart >= r.near)).sum() for r in need.itertuples())
    assert reached < 0.5 * len(need) * len(rows)
    assert _mined(spark, rows, positives=2) == sorted(hard_negatives.brute_force(rows, lambda i: i % 5 == 0, positives=2))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.25, 0.5]), (1, 1, [0.9, 0.4]), (2, 2, [0.8, 0.4]), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 1, None),
        (5, 1, [None, 1.0]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [1e308, 1.0]), (10, 1, []), (11, 1, []), (12, 2, []), (15, 3, [1.0]), (16, 3, [0.7]), (17, 4, [0.6]),
        (20, 5, [-1.0, 0.0]), (21, 5, [1.0, 0.0]), (22, 6, [0.5, 0.0]), (25, 7, [0.0, 0.0]), (26, 7, [3.0, 0.0]), (30, 8, [1e12, 1e12, 3.0]), (31, 8, [1e12, 7.5, 1.0]), (32, 9, [9e11, 3.0, 2.0]),
        (35, 8, [1e100, 0.0, 1.0]), (36, 8, [1e99, 1.0, 1.0]), (37, 9, [1e98, 1.0, 1.0]), (40, -3, [0.31, -0.0]), (41, -3, [0.3, 0.1]), (42, 2, [0.28, 0.0]),
    ]
    want = sorted(hard_negatives.brute_force(rows, lambda i: i % 5 == 0))
    assert _mined(spark, rows) == want and len(want) == 10


def test_copies_beyond_what_is_asked_for_stay_out(spark, monkeypatch):
    _small(monkeypatch)
    rows = [(i, i % 2, [1.0, 0.0]) for i in range(400)] + [(400 + i, i % 2, [0.7, 0.1 * i]) for i in range(40)]
    assert _mined(spark, rows, every=50) == sorted(hard_negatives.brute_force(rows, lambda i: i % 50 == 0))


def test_empty(spark):
    assert _mined(spark, []) == [] and _mined(spark, [(0, 1, [1.0])]) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF1}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op13_hard_negatives"]).fetchall()
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, SF1).collect()))
    assert got == sorted(want) and len(got) > 100
