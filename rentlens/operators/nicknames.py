"""Nicknames: an edge table (name1, relationship, name2), its lookups both ways, and its SQL forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELATION = "has_nickname"


def normal(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, each once; not transitive."""
    return edges.select("name1", "name2").union(edges.select("name2", "name1")).distinct()


def token_map(edges: DataFrame) -> dict[str, list[str]]:
    """Neighbours of each name, on the driver: for the packaged table of some thousand rows."""
    out: dict[str, list[str]] = {}
    for r in symmetric(edges).collect():
        out.setdefault(r[0], []).append(r[1])
    return {k: sorted(v) for k, v in out.items()}


class NickNamer:
    """Lookups over a table of edges; names ignore case and white space around them, and are not followed twice.

    A subclass may say otherwise what makes names alike: normal(), of a column.
    """

    normal = staticmethod(normal)

    def __init__(self, edges: DataFrame):
        known = edges.where(F.col("relationship") == RELATION)
        self.edges = known.select(self.normal(F.col("name1")).alias("name1"), self.normal(F.col("name2")).alias("name2")).distinct()

    @classmethod
    def from_triplets(cls, spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> NickNamer:
        return cls(spark.createDataFrame(list(rows), "name1 string, relationship string, name2 string"))

    @classmethod
    def from_lookup(cls, spark: SparkSession, *, nicknames: dict | None = None, canonicals: dict | None = None) -> NickNamer:
        """Of canonical: nicknames, or of nickname: canonicals; either gives both."""
        pairs = [(a, RELATION, b) for a, bs in (nicknames or {}).items() for b in bs]
        pairs += [(a, RELATION, b) for b, xs in (canonicals or {}).items() for a in xs]
        return cls.from_triplets(spark, pairs)

    def nicknames(self) -> DataFrame:
        """(name, names): the nicknames of every canonical name."""
        return self.edges.groupBy(F.col("name1").alias("name")).agg(F.array_sort(F.collect_set("name2")).alias("names"))

    def canonicals(self) -> DataFrame:
        return self.edges.groupBy(F.col("name2").alias("name")).agg(F.array_sort(F.collect_set("name1")).alias("names"))

    def _of(self, name: str, table: DataFrame) -> set[str]:
        if not isinstance(name, str):
            raise TypeError("a name has to be a string")
        row = table.where(F.col("name") == self.normal(F.lit(name))).first()
        return set(row["names"]) if row else set()

    def nicknames_of(self, name: str) -> set[str]:
        return self._of(name, self.nicknames())

    def canonicals_of(self, name: str) -> set[str]:
        return self._of(name, self.canonicals())


def check_triples(rows: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Lines of three fields as (name1, relationship, name2), each once and in order, and the lines of other arity."""
    fields = F.array_distinct(F.transform(F.split(F.col(line), ","), normal))
    parsed = rows.select(line, F.split(line, ",").alias("raw"), fields.alias("f"))
    good = parsed.where((F.size("raw") == 3) & (F.size("f") == 3)).select(F.col("f")[0].alias("name1"), F.col("f")[1].alias("relationship"), F.col("f")[2].alias("name2"))
    bad = parsed.where((F.size("raw") != 3) | (F.size("f") != 3)).select(line)
    return good.where("not (name1 = 'name1' and relationship = 'relationship')").distinct().orderBy("name1", "relationship", "name2"), bad


def wide(edges: DataFrame, columns: int = 15) -> DataFrame:
    """canonical_name, nickname_1 ... nickname_n in order of name; null beyond."""
    listed = edges.groupBy(F.col("name1").alias("canonical_name")).agg(F.array_sort(F.collect_set("name2")).alias("n"))
    return listed.select("canonical_name", *(F.get("n", F.lit(i)).alias(f"nickname_{i + 1}") for i in range(columns)))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """(statement): an INSERT for each row; quotes in values are doubled, null is NULL."""
    values = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c in df.columns]
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))


def create_statement(df: DataFrame, table: str) -> str:
    return f"CREATE TABLE {table} ({', '.join(f'{c} VARCHAR' for c in df.columns)});"


def sql_views(edges: DataFrame, table: str = "name_relationships", pairs: str = "nicknames") -> None:
    """Temporary views for ``spark.sql``: the triples, and (canonical_name, nickname) of them, lower case and trimmed."""
    edges.createOrReplaceTempView(table)
    NickNamer(edges).edges.select(F.col("name1").alias("canonical_name"), F.col("name2").alias("nickname")).createOrReplaceTempView(pairs)
