"""Homomorphic multiset fingerprints of texts, in DataFrame and SQL functions only.

A text is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector, and a text's fingerprint is
the sum of its paragraphs' vectors, modulo 2 ** 16 in the first LANES lanes and modulo 2 ** 32 in the last four. So
the order of paragraphs does not matter, and a paragraph is added or taken away by adding or subtracting its vector.

The last lanes are halves of two 64-bit hashes of the whole paragraph, the second with another seed: they decide equality. In the first lanes, each
pair of neighbouring words of the paragraph (the first word pairs with nothing) adds or subtracts one in one lane, so
that their inner products estimate how many word pairs two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

LANES = 64
#: Ids whose documents are next to each other, as a power of 2: a window never holds more distinct ids.
BUCKET_BITS = 8
#: Null ids have no order of their own: this many bits of a hash share them out.
NULL_BITS = 12
_NULL_BUCKET = -(1 << 62)


def _units(text: str) -> str:
    """SQL for a text's units as longs: odd ones are hashes of paragraphs, even ones of pairs of words."""
    pairs = (
        "transform(array(filter(split(p, '[ \\\\t\\\\x0B\\\\f\\\\r]+'), x -> x <> '')), ws -> "
        "transform(ws, (x, i) -> xxhash64(if(i = 0, '', ws[i - 1]), x) & ~1L))[0]"
    )
    return f"flatten(transform(split({text}, '\\n'), p -> concat(array((xxhash64(p) & ~3L) | 1L, xxhash64('second', p) | 3L), {pairs})))"


def _summed(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """``keys`` and lanes: map of 16 * (place in arrays) + group to the sums of eight lanes."""
    parts = F.array(*(F.struct(F.lit(i).alias("side"), F.col(a).alias("units")) for i, a in enumerate(arrays)))
    units = rows.select(*keys, F.explode(parts).alias("s")).select(*keys, "s.side", F.explode("s.units").alias("u"))
    pair = "(u & 1) = 0"
    units = units.selectExpr(
        *keys,
        f"cast(16 * side + if({pair}, (u >> 4) & 7, 8) AS int) AS g",
        f"cast(if({pair}, (u >> 1) & 7, u & 2) AS int) AS k",
        f"if({pair}, 1 - 2 * ((u >> 7) & 1), (u >>> 2) & 2147483647) AS lo",
        f"if({pair}, 0L, u >>> 33) AS hi",
    )
    sums = [F.expr(f"sum(if(k = {i}, lo, if(k = {i - 1} AND hi <> 0, hi, 0L)))").alias(f"c{i}") for i in range(8)]
    wide = units.groupBy(*keys, "g").agg(*sums)
    entry = F.struct("g", F.array(*(f"c{i}" for i in range(8))))
    return wide.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("lanes"))


def _sums(side: int) -> Column:
    """The lanes that estimate likeness, as they were summed."""
    zeros = "array(0L, 0L, 0L, 0L, 0L, 0L, 0L, 0L)"
    return F.expr(f"flatten(transform(sequence(0, {LANES // 8 - 1}), g -> coalesce(lanes[16 * {side} + g], {zeros})))")


def _vector(side: int) -> Column:
    """_sums() as signed numbers under 2 ** 15."""
    return F.transform(_sums(side), lambda x: F.pmod(x + 32768, F.lit(65536)) - 32768)


def _text_form(vector: str, side: int) -> Column:
    return F.expr(f"concat(array_join(transform({vector}, x -> lpad(lower(hex(pmod(x, 65536))), 4, '0')), ''), array_join(transform(slice(lanes[16 * {side} + 8], 1, 4), x -> lpad(lower(hex(pmod(x, 4294967296))), 8, '0')), ''))")


def _likeness(a: str, b: str) -> Column:
    """Twice the inner product over the sum of squares, within 0 and 1; two empty vectors are alike."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0L, (s, x) -> s + x)"
    both = f"({dot.format(a, a)} + {dot.format(b, b)})"
    return F.expr(f"if({both} = 0, 1D, least(1D, greatest(0D, 2D * {dot.format(a, b)} / {both})))")


def fingerprint(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, fingerprint, lanes) of every text; null is empty. Equal keys have to come with equal texts."""
    rows = docs.select(key, F.expr(_units(f"coalesce({text_col}, '')")).alias("units")).dropDuplicates([key])
    lanes = _summed(rows, [key], ["units"]).withColumn("v", _vector(0))
    return lanes.select(key, _text_form("v", 0).alias("fingerprint"), F.concat("v", F.expr("transform(slice(lanes[8], 1, 4), x -> pmod(x, 4294967296))")).alias("lanes"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of two multisets joined (sign 1), or of the first without the second (-1)."""
    return F.zip_with(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), b, lambda p, y: F.when(p.i < LANES, F.pmod(p.x + sign * y + 32768, F.lit(65536)) - 32768).otherwise(F.pmod(p.x + sign * y, F.lit(1 << 32))))


def _following(buckets: DataFrame) -> DataFrame:
    """(bucket, target): the bucket's first document follows the last of ``target``; the first bucket follows the last.

    Buckets are sorted in parts; their places come from the parts' sizes, of which there are as many as parts.
    """
    placed = store(buckets.sort(F.desc("bucket")).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.expr("id >> 33")))
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = store(placed.join(parts, "part").select("bucket", (F.expr("id & 8589934591") + F.col("before")).alias("place"), "total"))
    after = placed.select(F.col("bucket").alias("target"), F.expr("(place + 1) % total").alias("place"))
    return placed.select("bucket", "place").join(after, "place").select("bucket", "target")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text's last floor(n_chars / 2) code points are the first as many (or all) of the next document, in
    descending order of id; the first follows the last. Null texts are empty; null ids come last, in descending order
    of a hash of the text; rows of one id follow each other by text. Every row counts, repeated ones too. No rows give
    no rows. Other columns are not used.

    Texts are dealt once, by runs of ids, or of hashes; a run's last document looks up the first of the next run.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    named, nameless = F.expr(f"cast(doc_id AS long) >> {BUCKET_BITS}"), F.lit(_NULL_BUCKET) + F.shiftright(F.xxhash64("text"), 64 - NULL_BITS)
    listed = rows.where("doc_id is not null").select(named.alias("bucket")).union(rows.where("doc_id is null").select(nameless.alias("bucket"))).distinct()
    rows = rows.withColumn("bucket", F.coalesce(named, nameless)).repartition("bucket")
    run = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).desc(), "text")
    heads = rows.withColumn("place", F.row_number().over(run)).where("place = 1").select("bucket", F.col("text").alias("head"))
    follows = _following(listed)
    heads = heads.join(follows, "bucket").select(F.col("target").alias("bucket"), "head")
    rows = rows.withColumns({"place": F.row_number().over(run), "following": F.lead("text").over(run)})
    rows = rows.join(heads.withColumnRenamed("bucket", "target"), F.expr("bucket = target AND following IS NULL"), "left")
    rows = rows.selectExpr("bucket", "place", "doc_id", "text", "cast(char_length(text) AS long) AS n_chars", "coalesce(following, head, '') AS following", "following IS NULL AS last")
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 AS int)), substring(following, 1, cast(n_chars div 2 AS int)))"))
    rows = rows.select("bucket", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(_units("text")).alias("u0"), F.expr(_units("edited")).alias("u1"), F.expr(f"if(last, {_units('following')}, array())").alias("u2"))
    lanes = _summed(rows, ["bucket", "place", "doc_id", "n_chars", "edited_sha256"], ["u0", "u1", "u2"])
    lanes = lanes.withColumns({f"v{i}": _sums(i) for i in range(3)})
    near = Window.partitionBy("bucket").orderBy("place")
    lanes = lanes.withColumn("v2", F.coalesce(F.lead("v0").over(near), "v2"))
    return lanes.select("doc_id", "n_chars", "edited_sha256", _text_form("v0", 0).alias("fingerprint"), _text_form("v1", 1).alias("edited_fingerprint"), _likeness("v0", "v1").alias("near_edited"), _likeness("v0", "v2").alias("near_next"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (id, text) rows, for tests."""
    import hashlib
    import re

    import xxhash

    def spark_hash(*parts: str) -> int:
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return seed

    def lanes(text: str) -> list[int]:
        out = [0] * (LANES + 4)
        for p in text.split("\n"):
            for i, h in enumerate((spark_hash(p) & ~3 | 1, spark_hash("second", p) | 3)):
                out[LANES + 2 * i] += h >> 2 & 0x7FFFFFFF
                out[LANES + 2 * i + 1] += h >> 33
            words = [w for w in re.split("[ \t\x0b\x0c\r]+", p) if w]
            for before, w in zip(["", *words], words, strict=False):
                h = spark_hash(before, w)
                out[8 * (h >> 4 & 7) + (h >> 1 & 7)] += -1 if h >> 7 & 1 else 1
        return out

    def form(x: list[int]) -> str:
        return "".join(f"{v % 65536:04x}" for v in x[:LANES]) + "".join(f"{v % (1 << 32):08x}" for v in x[LANES:])

    def near(x: list[int], y: list[int]) -> float:
        dot = lambda a, b: sum(p * q for p, q in zip(a[:LANES], b[:LANES], strict=True))
        both = dot(x, x) + dot(y, y)
        return min(1.0, max(0.0, 2 * dot(x, y) / both)) if both else 1.0

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(spark_hash(r[1] or "")) if r[0] is None else 0, r[1] or ""))
    out = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        x, y, z = lanes(t), lanes(edited), lanes(u)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), form(x), form(y), near(x, y), near(x, z)))
    return out
