"""Merges by precedence, deduplication with a stated order, audits, evidence folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import blank
from .ordered import parts, size_chunks  # noqa: F401


def first_by(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first row of each key in the order, or the last."""
    order = [F.desc(c) if isinstance(c, str) else c.desc() for c in order] if last else order
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def value_by(value: str, order: str) -> Column:
    """The value of the highest order, as an aggregate."""
    return F.max_by(value, order)


def merge_sources(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Full outer merge of sources on a key; later sources win, but blanks never erase."""
    tagged = [s.select(key, F.lit(i).alias("__i"), *((blank(F.col(c).cast("string")) if c in s.columns else F.lit(None).cast("string")).alias(c) for c in columns)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__i"))).alias(c) for c in columns))


def repairs(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, before, after) of the fields that changed."""
    a, b = before.alias("a"), after.alias("b")
    changes = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after")) for c in columns))
    rows = a.join(b, key, "full").select(key, F.explode(F.filter(changes, lambda x: ~x.before.eqNullSafe(x.after))).alias("c"))
    return rows.select(key, "c.*")


def with_crosswalk(permits: DataFrame, crosswalk: DataFrame, key: str, source: str = "source_url") -> DataFrame:
    """Permits with the crosswalk's number where it has one with a source; the last row of a key in its order wins."""
    good = first_by(crosswalk.where(blank(F.col(source)).isNotNull()), [key], ["ordinal"], last=True)
    joined = permits.join(good.select(key, F.col("permit_number").alias("__number")), key, "left")
    return joined.withColumn("permit_number", F.coalesce("__number", "permit_number")).drop("__number")


def matched_permits(listings: DataFrame, permits: DataFrame) -> DataFrame:
    """(listing_id, permits) of the permits that a listing's numbers name, each once, by id."""
    pairs = listings.select("listing_id", F.explode(F.array_distinct("permit_numbers")).alias("permit_number")).join(permits, "permit_number")
    return pairs.groupBy("listing_id").agg(F.array_sort(F.collect_set(F.struct("id", "permit_number", "status"))).alias("permits"))


def parcel_status(permits: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The best status of each parcel; statuses outside the order do not count."""
    from ..functions.rules import rank_of

    best = permits.withColumn("__r", rank_of(F.col("status"), order)).where("__r is not null").groupBy("parcel").agg(F.min("__r").alias("r"))
    return best.select("parcel", F.array(*map(F.lit, order))[F.col("r")].alias("status"))


def latest_submission(submissions: DataFrame, key: str, kind: str, stamp: str, pinned: str) -> DataFrame:
    """The row of each key that counts: pins before other kinds, then the latest."""
    return first_by(submissions.withColumn("__p", (F.col(kind) == pinned).cast("int")), [key], [F.desc("__p"), F.desc(stamp)]).drop("__p")


def same_partition(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where ``keep`` holds or is unknown, and the others."""
    return df.where(F.coalesce(keep, F.lit(True))), df.where(~F.coalesce(keep, F.lit(True)))
