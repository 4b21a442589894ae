"""Exact dedup against brute force, SQL and edge rows."""

import duckdb
import pytest

from rentlens.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"
ROWS = [
    (5, "a b c"), (3, "abc"), (9, "a  b\tc\n"), (1, "ab c "), (None, "a  b  c"), (7, "x"), (7, "x"), (8, None), (6, ""), (4, " \n\x0b\x0c\r"), (2, "a b"), (11, "ab"),
    (12, "é 漢 字"), (10, "é漢  字"), (None, "alone"), (13, "X"), (14, "a\x1cb"), (15, "w " * 200_000), (16, "w" * 200_000), (17, "A b c"),
]


def _plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 16), (7, 2), (7, 16), (30, 3)])
def test_edge_rows(spark, parts, fan_in):
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in ROWS], "doc_id long, text string, run string, copies int, sha double").coalesce(1)
    df = df.repartitionByRange(parts, "doc_id") if parts > 1 else df
    order = [(r.doc_id, r.text) for r in df.collect()]
    assert _plain(exact_dedup.groups(df, fan_in=fan_in)) == sorted(exact_dedup.brute_force(order), key=repr)


def test_hot_group_over_many_runs(spark):
    rows = [(i, ["the same  text", "the same text", f"text {i % 90}"][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert _plain(exact_dedup.groups(df, fan_in=3)) == sorted(exact_dedup.brute_force(rows), key=repr)


def test_a_round_meets_few_rows_a_key(spark):
    """However many copies there are, a key of a round has at most as many rows as runs are merged."""
    df = spark.range(4000).selectExpr("id as doc_id", "'copy' as text").repartition(64)
    rows = exact_dedup.digests(df)
    runs = rows.groupBy("run", "sha", "size", "proof").agg({"doc_id": "min"})
    assert runs.count() == 64
    plan = exact_dedup._merged(spark.createDataFrame([], "run int, sha binary, size int, proof long, best struct<less: int>, copies long"), 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "Python" not in plan


def test_unlike_texts_of_one_digest_stay_apart(spark):
    """The proof decides where digests agree."""
    rows = spark.createDataFrame([(0, bytes(32), 3, 1, 1), (0, bytes(32), 3, 2, 2), (1, bytes(32), 3, 1, 3)], "run int, sha binary, size int, proof long, id int")
    entries = rows.selectExpr("run", "sha", "size", "proof", "struct(id as less) as best", "1L as copies")
    assert sorted((r.proof, r.best.less, r.copies) for r in exact_dedup._merged(entries, 16).collect()) == [(1, 1, 2), (2, 2, 1)]


def test_keep_one(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, row string, key int").repartition(3)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    want = {(b[0], b[4]) for b in exact_dedup.brute_force(ROWS) if b[3]}
    got = [tuple(r)[:2] for r in kept.collect()]
    assert len(got) == len(want) and {(i, exact_dedup.brute_force([(i, t)])[0][4]) for i, t in got} == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.keep_one(none).columns == none.columns


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op12_exact_dedup"]).fetchall()
    assert _plain(queries.op12_exact_dedup(spark, SF)) == sorted(want, key=repr)
