"""Chat formatting after cumulative-snapshot collapse.

A log that writes a conversation after every turn holds all its beginnings too. Every turn gets a rolling hash of the
turns up to it: running sums of two 64-bit hashes of (place, role, text), in halves, so that equal sums stand for equal
beginnings. A conversation whose last hash is the hash of an inner turn of another is a snapshot of it; an anti-join
leaves the others, equal ones count once, and those are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

_LANES = ["h1", "h2", "h3", "h4", "place"]


def _turns(chats: DataFrame, conv_col: str) -> DataFrame:
    key = F.when(F.col(conv_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(conv_col).cast("string")))
    rows = chats.select(key.alias("key"), F.col(conv_col).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("turn"), "role", "text")
    return rows.withColumn("place", F.row_number().over(order))


def prefix_hashes(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(key, conv_id, place, n_turns, h1, h2, h3, h4) of every turn: the hash of the turns up to it."""
    turns = _turns(chats, conv_col)
    first, second = F.xxhash64("place", "role", "text"), F.xxhash64(F.lit("second"), "place", "role", "text")
    sums = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    halves = [first.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(first, 32), second.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(second, 32)]
    last = F.lead("place").over(Window.partitionBy("key").orderBy("place")).isNull()
    return turns.select("key", "conv_id", "place", last.alias("last"), *(F.sum(h).over(sums).alias(f"h{i + 1}") for i, h in enumerate(halves)))


def maximal(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(key, conv_id, n_turns, n_copies): conversations that begin no longer one; of equal ones, the least id."""
    hashes = store(prefix_hashes(chats, conv_col))
    whole = hashes.where("last").groupBy(*_LANES).agg(F.min(F.struct("conv_id", "key")).alias("one"), F.count("*").alias("n_copies"))
    inner = hashes.where("not last").select(*_LANES).distinct()
    return whole.join(inner, _LANES, "left_anti").select("one.key", "one.conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, n_copies, text): every maximal conversation once, as one text.

    A turn is ``<|role|>``, its text and ``<|end|>``, each on a new line; ``<|`` in a role or text becomes ``< |``.
    Turns go by turn (nulls last), then role and text. Null roles and texts are empty. The rows of a null
    conversation id are one conversation. n_copies counts equal conversations. No rows give no rows. Other columns
    are not used. A conversation has to fit into a row, as its text does.
    """
    kept = maximal(chats, conv_col)
    turns = _turns(chats, conv_col).join(store(kept.select("key", "n_turns", "n_copies")), "key")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    one = lambda t: F.concat(F.lit("<|"), safe(t.role), F.lit("|>\n"), safe(t.text), F.lit("\n<|end|>\n"))
    listed = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    grouped = turns.groupBy("key", "conv_id", "n_turns", "n_copies").agg(listed.alias("turns"))
    return grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", one), "").alias("text"))
