"""Screening statistics, facets and hosts."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, rules
from .merge import first_by


def funnel(rows: DataFrame, exclude_large: bool = True, exclude_multiple: bool = True) -> DataFrame:
    """One row of counts, each step without what earlier steps left out.

    rows: listing_id, ordinal, likely_hotel, bedrooms, licenses, over_capacity. The last row of an id counts. A
    listing is unknown if its over_capacity is, and over from one guest on.
    """
    r = first_by(rows, ["listing_id"], ["ordinal"], last=True)
    hotel = F.coalesce("likely_hotel", F.lit(False))
    large = ~hotel & F.lit(exclude_large) & F.coalesce(F.col("bedrooms") > rules.LARGE_BEDROOMS, F.lit(False))
    multiple = ~hotel & ~large & F.lit(exclude_multiple) & F.coalesce(F.col("licenses") > 1, F.lit(False))
    unknown = ~hotel & ~large & ~multiple & F.col("over_capacity").isNull()
    eligible = ~hotel & ~large & ~multiple & ~unknown
    out = r.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in (("hotels", hotel), ("large", large), ("multiple", multiple), ("unknown", unknown), ("eligible", eligible), ("over", eligible & (F.col("over_capacity") >= 1)))))
    return out.withColumn("percent_over", F.round(rules.percent(F.col("over"), F.col("eligible")), 6))


def shortfall(total: DataFrame, fee: int = rules.FEE) -> DataFrame:
    """total, hotels, current of a one-row table, with what is missing, its share of the total and its fees."""
    missing = F.greatest(F.lit(0), F.col("total") - F.col("hotels") - F.col("current"))
    return total.select("total", "hotels", "current", missing.alias("shortfall"), F.round(rules.percent(missing, F.col("total")), 6).alias("percent"), (missing * fee).alias("fees"))


def spatial_rate(rows: DataFrame) -> DataFrame:
    """One row: listings in scope that are no hotel, those whose overlap is known, likely unlicensed ones, their share.

    rows: likely_hotel, in_scope, overlap (true, false or unknown).
    """
    mine = rows.where(F.coalesce("in_scope", F.lit(False)) & ~F.coalesce("likely_hotel", F.lit(False)))
    out = mine.agg(F.count("*").alias("listings"), F.count("overlap").alias("known"), F.count_if(~F.col("overlap")).alias("likely"))
    return out.withColumn("unknown", F.col("listings") - F.col("known")).withColumn("percent", F.round(rules.percent(F.col("likely"), F.col("known")), 6))


def with_total(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts by a column and in total, in one pass; is_total marks the total."""
    return df.rollup(column).agg(F.count("*").alias(name), F.grouping(column).cast("int").alias("is_total"))


def count_map(df: DataFrame, column: str) -> Column | DataFrame:
    """One row: a map of each value to its count."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


@dataclass
class Facets:
    """Conditions on listings; None asks for nothing. Each is a filter of its own, so one can be skipped.

    overage: guests over capacity of the listings that count (rules.over_occupancy), else 0 or null. party=True also
    keeps those. near_m, outside: distance to the nearest licensed parcel, and no current permit within a radius.
    """

    text: str | None = None
    host: str | None = None
    status: str | None = None
    rental_type: str | None = None
    least_overage: float | None = None
    party: bool | None = None
    over_capacity: bool | None = None
    combo: str | None = None
    amenities_any: tuple[str, ...] | None = None
    amenities_all: tuple[str, ...] | None = None
    near_m: float | None = None
    likely_unlicensed: bool | None = None
    mapped_only: bool | None = None
    in_scope: bool | None = None
    rental_types: tuple[str, ...] | None = None
    community: tuple[str, ...] | None = None
    auto_status: tuple[str, ...] | None = None
    outside: bool | None = None

    @property
    def active(self) -> bool:
        """Whether anything is asked for."""
        return bool(self.conditions())

    def conditions(self) -> dict[str, Column]:
        made = {
            "text": lambda v: F.contains(F.col("search"), F.lit(v.lower())),
            "host": lambda v: F.col("host_key") == v,
            "status": lambda v: F.col("status") == v,
            "rental_type": lambda v: F.coalesce("rental_type", F.lit("")) == v,
            "least_overage": lambda v: F.col("overage") >= max(v, 1),
            "party": lambda v: (F.col("party") | F.coalesce(F.col("overage") >= 1, F.lit(False))) if v else ~F.col("party"),
            "over_capacity": lambda v: F.coalesce(F.col("overage") >= 1, F.lit(False)) == v,
            "combo": lambda v: F.col("combo") == v,
            "amenities_any": lambda v: F.arrays_overlap("amenities", F.array(*map(F.lit, v))),
            "amenities_all": lambda v: F.size(F.array_except(F.array(*map(F.lit, v)), "amenities")) == 0,
            "near_m": lambda v: F.col("distance_m") <= v,
            "likely_unlicensed": lambda v: F.col("likely_unlicensed") == v,
            "mapped_only": lambda v: F.col("lon").isNotNull() if v else F.lit(True),
            "in_scope": lambda v: F.col("in_scope") == v,
            "rental_types": lambda v: F.coalesce("rental_type", F.lit("")).isin(*v),
            "community": lambda v: labels.community_status(F.col("community_status")).isin(*v),
            "auto_status": lambda v: F.col("auto_status").isin(*v),
            "outside": lambda v: F.col("outside") == v,
        }
        return {f.name: made[f.name](getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None}

    def apply(self, df: DataFrame, skip: str | None = None) -> DataFrame:
        for name, c in self.conditions().items():
            if name != skip:
                df = df.where(c)
        return df

    def counts(self, df: DataFrame, facet: str, column: str) -> DataFrame:
        """Values of a facet among the rows that all other facets keep."""
        return self.apply(df, skip=facet).groupBy(F.coalesce(F.col(column), F.lit("")).alias(column)).agg(F.count("*").alias("n"))


    def all_counts(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """(facet, value, n): counts() of several facets, each by its own column, in one pass over the rows.

        A row that fails no condition counts for every facet; one that fails a single condition counts for the facet
        of that condition alone, as its counts skip it; others count nowhere. columns: facet to column.
        """
        tests = self.conditions()
        marks = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()] or [F.lit(None).cast("string")]
        cells = F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for f, c in columns.items()))
        rows = df.select(F.filter(F.array(*marks), lambda x: x.isNotNull()).alias("failed"), cells.alias("cells")).where(F.size("failed") <= 1)
        mine = F.filter("cells", lambda x: (F.size("failed") == 0) | (F.get("failed", F.lit(0)) == x.facet))
        return rows.select(F.explode(mine).alias("cell")).groupBy("cell.facet", "cell.value").agg(F.count("*").alias("n"))


def hosts(df: DataFrame, key: str = "host_key") -> DataFrame:
    """Counts of each host's listings."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return df.groupBy(key).agg(F.count("*").alias("total"), yes("likely").alias("likely"), yes("party").alias("party"), F.count_if(F.coalesce(F.col("overage") >= 1, F.lit(False))).alias("over"))


def sorted_hosts(table: DataFrame, metric: str, ascending: bool = False, name: str = "host_key") -> DataFrame:
    """By a metric, ties by name; the direction holds for both."""
    way = F.asc if ascending else F.desc
    return table.orderBy(way(metric), way(name))


def host_combos(df: DataFrame, key: str = "host_key", combo: str = "combo") -> DataFrame:
    """How often a host's party and over-capacity listings have each combination of amenities; empty ones go."""
    mine = df.where(F.coalesce("party", F.lit(False)) | F.coalesce(F.col("overage") >= 1, F.lit(False))).where(F.col(combo) != "")
    return mine.groupBy(key, combo).agg(F.count("*").alias("n"))


def first_rows(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in order, with more: whether there are others."""
    rows = df.orderBy(*order).limit(most + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # most + 1 rows
    return rows.withColumn("more", F.count("*").over(Window.partitionBy(F.lit(0))) > most).where(F.col("__n") <= most).drop("__n")


def page(df: DataFrame, order: list, number: int, size: int = 100) -> DataFrame:
    """The ``number``-th page, from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)
