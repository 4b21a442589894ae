"""Points that several queries share: the first components of the embeddings, around one town."""

from __future__ import annotations

from pyspark.sql import functions as F

POINTS = "p AS (SELECT vec_id, label, -86.78 + 0.05 * embedding[1]::DOUBLE AS lon, 36.16 + 0.05 * embedding[2]::DOUBLE AS lat FROM embeddings)"


def points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i, c, k: F.lit(c) + F.lit(0.05) * F.col("embedding")[i].cast("double")  # noqa: E731, ARG005
    return e.select("vec_id", "label", at(0, -86.78, 0).alias("lon"), at(1, 36.16, 0).alias("lat"))
