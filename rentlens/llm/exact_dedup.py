"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions alone.

1. Every row becomes a digest (SHA-256 of the normalised text) beside a proof (its length and a hash of unlike make).
   A map partition's rows are a run; the run and each row's place in it are written down, so no retry moves them.
2. A run holds each digest once, with its best identifier and how many rows it stands for. Spark keeps the runs
   sorted by digest: the minimum of a struct is aggregated over sorted rows, not in a hash table.
3. In each round FAN_IN neighbouring runs become one. A round's task holds a slice of the digests of some runs, never
   a whole run, and a digest brings at most FAN_IN rows to it, however many copies there are. The round verifies the
   proof, and keeps the best identifier and the sum of the rows. After log(runs) rounds one run is left, in slices.
4. What the last run knows of groups goes down the same tree: each run looks up the run that it was merged into, again
   at most FAN_IN rows a key, and rows look up their own run. Digests that occur once stay behind.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import as_row, store
from .textkernel import row_key

FAN_IN = 16
_DIGEST = ("sha", "size", "proof")


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, row, doc_id, n_chars, sha, size, proof) of every row, written out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("n_chars"), _normalised(text).alias("bare"))
    return store(
        rows.select(
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_chars",
            F.unhex(F.sha2("bare", 256)).alias("sha"),
            F.char_length("bare").alias("size"),
            F.xxhash64("bare").alias("proof"),
        )
    )


def _merged(entries: DataFrame, fan_in: int) -> DataFrame:
    """The next round's runs: ``fan_in`` neighbours in one, each digest once."""
    up = entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    return up.groupBy("run", *_DIGEST).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Texts are equal when they are once ``[\\x20\\x09-\\x0D]`` is deleted; null counts as empty, and empty texts are a
    group like any other. Of a group the row with the most code points stays, then the smallest id, a null id last;
    of rows that repeat an id too, the first in the table's order. Exactly one row of a group is kept, and keep_id is
    its id (null if that is null). Other columns are not used. No rows give no rows.
    """
    if fan_in < 2:
        raise ValueError("a round has to merge two runs at least")
    rows = digests(docs, id_col, text_col)
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    runs = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    levels = [store(rows.groupBy("run", *_DIGEST).agg(F.min(best).alias("best"), F.count("*").alias("copies")))]
    while runs > 1:
        levels.append(store(_merged(levels[-1], fan_in)))
        runs = -(-runs // fan_in)
    found = levels.pop().where("copies > 1").select("run", *_DIGEST, F.col("best").alias("top"), F.col("copies").alias("group_size"))
    while levels:
        inner = levels.pop().select(F.col("run").alias("own"), F.floor(F.col("run") / fan_in).cast("int").alias("run"), *_DIGEST)
        found = store(inner.join(found, ["run", *_DIGEST]).drop("run").withColumnRenamed("own", "run"))
    wide = rows.join(found, ["run", *_DIGEST], "left")
    alone = F.col("group_size").isNull()
    return wide.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, as groups() chooses it.

    All columns pass through, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(as_row(docs), *row_key(id_col, text_col), F.col(id_col).alias("doc_id"), text.alias("text"))
    stay = groups(own.select("doc_id", "text")).where("kept").select("keep_id", "text_sha256")
    sha = F.sha2(_normalised(F.col("text")), 256)
    found = own.withColumn("sha", sha).join(stay, (F.col("sha") == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    # Rows that share id and normalised text: the longest, then the first of equal ones.
    once = Window.partitionBy("sha", "doc_id").orderBy(F.char_length("text").desc(), "key", "mark")
    return found.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """groups() of (id, text) rows in the table's order, for tests."""
    bare = [(t or "").translate(dict.fromkeys([32, *range(9, 14)])) for _, t in rows]
    by: dict[str, list[int]] = {}
    for i, b in enumerate(bare):
        by.setdefault(b, []).append(i)
    out = [None] * len(rows)
    for b, own in by.items():
        top = min(own, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        for i in own:
            out[i] = (rows[i][0], rows[top][0], len(own), i == top, hashlib.sha256(b.encode()).hexdigest())
    return out
