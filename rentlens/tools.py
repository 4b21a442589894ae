"""Command line of the names table: normalise it, or write it as SQL."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import nicknames
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rentlens.tools", description="Normalise a table of names, or write it as SQL.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("normalize", "lower case, trimmed, sorted, each line once"), ("sql", "CREATE and INSERT statements"), ("constant", "one JSON text of all triples")):
        c = sub.add_parser(name, help=text)
        c.add_argument("-i", "--input", required=True, help="CSV of name1, relationship, name2")
        c.add_argument("-o", "--output", required=True, help="folder to write")
        if name == "sql":
            c.add_argument("--type", choices=("wide", "long"), default="long", help="a row a name with all its nicknames, or a row a triple")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("rentlens").getOrCreate()
    if a.command == "normalize":
        good, bad = nicknames.check_triples(spark.read.text(a.input).toDF("line"))
        if wrong := [r[0] for r in bad.limit(20).collect()]:
            raise SystemExit("not three fields: " + "; ".join(wrong))
        good.coalesce(1).write.mode("overwrite").csv(a.output, header=True)
        return
    rows = tables.names(spark, a.input)
    if a.command == "constant":
        listed = rows.agg(F.to_json(F.array_sort(F.collect_list(F.array(*rows.columns)))).alias("value"))  # a packaged table of some thousand rows
        listed.write.mode("overwrite").text(a.output)
        return
    name = "name_relationships"
    if a.type == "wide":
        rows, name = rows.where(F.col("relationship") == nicknames.RELATION), "nicknames"
        most = rows.groupBy("name1").agg(F.count_distinct("name2").alias("n")).agg(F.max("n")).first()[0] or 0
        rows = nicknames.wide(rows, most)
    made = nicknames.insert_statements(rows, name).select(F.lit(1).alias("n"), F.col("statement").alias("value"))
    head = spark.createDataFrame([(0, nicknames.create_statement(rows, name))], "n int, value string")
    head.union(made).orderBy("n", "value").coalesce(1).select("value").write.mode("overwrite").text(a.output)


if __name__ == "__main__":
    main()
