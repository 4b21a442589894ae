"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash. Its blocks are drawn in a permuted order, all of them once for every
full pass that its target asks for, then one after the other until the next is more than what is wanted: that one is drawn
in part, as are the next ones where blocks hold few documents. The counts of drawn blocks by source are split over the
output shards by a tree: each node deals half of its blocks, of a random composition (multivariate hypergeometric), to
either side, so every shard gets its share of every source, exact in sum. Shards then take disjoint runs of each
source's draws, and order their documents by a hash.

Only sums by (source, block) leave the executors; what a document does follows from its hash and its source's row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import as_row, partitions, store
from .textkernel import lean, word_counts

#: Weights of the sources in order of code points, repeating; most times a document is taken.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: Blocks of a source; finer parts of a block that is drawn in part; documents that the blocks drawn in part hold
#: together, at least. They say how close a target is met, whatever the size of a source.
BLOCKS, PARTS, EDGE = 256, 256, 64
#: Words of a shard, if their number is not given.
SHARD_WORDS = 16_000_000
SEED = 20


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """Words wanted of each source: shares of all words by weight, none over ``most`` times its size.

    What a source cannot give is shared again by weight among the others, until none is above.
    """
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, free = np.zeros(len(size)), np.ones(len(size), bool)
    while free.any():
        left = size.sum() - out[~free].sum()
        out[free] = left * w[free] / w[free].sum()
        over = free & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        free &= ~over
    return out.tolist()


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little"))


def permuted(source: str | None, seed: int = SEED) -> np.ndarray:
    """The order that a source's blocks are drawn in."""
    return _rng("blocks", seed, source).permutation(BLOCKS)


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Shards x sources: how many drawn blocks of each source a shard gets. Columns sum to quotas; rows are even."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64), int(quotas.sum()))]
    while stack:
        lo, hi, have, total = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        middle = (lo + hi) // 2
        take = total * (middle - lo) // (hi - lo)
        left = _rng("split", seed, lo, hi).multivariate_hypergeometric(have, take, method="marginals")
        stack += [(lo, middle, left, take), (middle, hi, have - left, total - take)]
    return out


def _key(source: Column | str) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _place(id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col, F.hash(F.coalesce(text_col, F.lit(""))), F.lit("mix")), F.lit(BLOCKS * PARTS)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, place, size): a narrow table, written out; size is the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(word_counts(batch.column(3)))], ["doc_id", "source", "place", "size"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _place(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    return store(rows.mapInArrow(lean(count), f"doc_id {docs.schema[id_col].dataType.simpleString()}, source string, place int, size long"))


def _edge_blocks(docs: np.ndarray) -> int:
    """How many of the blocks, given their documents, are drawn in part: as many as hold EDGE of them."""
    return min(len(docs), int(np.searchsorted(np.cumsum(docs), EDGE)) + 1)


def _fitting(sums: np.ndarray, left: float) -> np.ndarray:
    """Which of the parts, one after the other, fit into ``left``; and one more if more than half of it is wanted then."""
    taken = np.zeros(len(sums), bool)
    refused = -1
    for i, n in enumerate(sums.tolist()):
        if n <= left:
            taken[i] = True
            left -= n
        elif refused < 0 or n < sums[refused]:
            refused = i
    if refused >= 0 and sums[refused] < 2 * left:
        taken[refused] = True
    return taken


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """One row a source, and the split tree's counts (shards x sources, in order of code points, null last).

    A row has key, source_size, target, passes, rank of each block, cut_rank (the first that is drawn in part), edge
    (places drawn of it and the next, in order) and owner (the shard of each draw). ``rows`` as of sized(). The driver
    holds the sums of a source's blocks and of the parts of one or a few, nothing of a document.
    """
    spark = rows.sparkSession
    found: dict[str | None, np.ndarray] = {}
    held: dict[str | None, np.ndarray] = {}
    for r in rows.groupBy("source", F.expr(f"place div {PARTS}").alias("block")).agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect():
        found.setdefault(r["source"], np.zeros(BLOCKS, np.int64))[r["block"]] = r["n"]
        held.setdefault(r["source"], np.zeros(BLOCKS, np.int64))[r["block"]] = r["docs"]
    names = sorted(found, key=lambda s: (s is None, s or ""))
    size = [int(found[s].sum()) for s in names]
    shards = shards or max(64, partitions(spark, sum(size), SHARD_WORDS))
    wanted = targets(size, weights, most)
    orders, passes, cuts, rest = [], [], [], []
    for s, n, t in zip(names, size, wanted, strict=True):
        order = permuted(s, seed)
        full = min(most, int(t // n)) if n else 0
        left = t - full * n if n and full < most else 0
        upto = np.cumsum(found[s][order])
        cut = int(np.searchsorted(upto, left, "right")) if left else 0
        orders.append(order)
        passes.append(full)
        cuts.append(cut)
        rest.append(left - (int(upto[cut - 1]) if cut else 0))
    wide = [_edge_blocks(held[s][o[c:]]) for s, o, c in zip(names, orders, cuts, strict=True)]
    at = [(s, int(o[c + k]), k) for s, o, c, w, left in zip(names, orders, cuts, wide, rest, strict=True) if left for k in range(w)]
    inner = {s: np.zeros(w * PARTS, np.int64) for s, w in zip(names, wide, strict=True)}
    if at:
        edge = spark.createDataFrame(at, "source string, block int, k int").select(_key("source").alias("key"), "block", "k")
        cut_rows = rows.select("source", _key("source").alias("key"), F.expr(f"place div {PARTS}").cast("int").alias("block"), F.expr(f"place % {PARTS}").alias("part"), "size")
        for r in cut_rows.join(edge, ["key", "block"]).groupBy("source", "k", "part").agg(F.sum("size").alias("n")).collect():
            inner[r["source"]][r["k"] * PARTS + r["part"]] = r["n"]
    edges = [np.flatnonzero(_fitting(inner[s], left) & (inner[s] > 0)) for s, left in zip(names, rest, strict=True)]
    used = [int(e.max(initial=-1)) // PARTS + 1 for e in edges]
    drawn = np.array([BLOCKS * p + c + u for p, c, u in zip(passes, cuts, used, strict=True)], np.int64)
    dealt = split_tree(drawn, shards, seed) if len(names) else np.zeros((shards, 0), np.int64)
    out = []
    for i, s in enumerate(names):
        rank = np.empty(BLOCKS, np.int64)
        rank[orders[i]] = np.arange(BLOCKS)
        owner = np.repeat(np.arange(shards), dealt[:, i])  # of the source's draws, pass by pass in the permuted order
        out.append(("-" if s is None else "+" + s, size[i], float(wanted[i]), passes[i], rank.tolist(), cuts[i], edges[i].tolist(), owner.tolist()))
    return spark.createDataFrame(out, "key string, source_size long, target double, passes int, ranks array<int>, cut_rank int, edge array<int>, owner array<int>"), dealt


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (key, place, order_key and others) with source_size, target, copies, shards and places of the copies.

    A place is a number that a shard's documents are in order of.
    """
    # The plan has a row a source; Spark sends it to all tasks if it is small, and else joins by source, split where skewed.
    rank = F.col("ranks")[F.expr(f"cast(place div {PARTS} AS int)")]
    out = rows.join(plan, "key").withColumn("rank", rank)
    in_edge = F.array_contains("edge", F.expr(f"cast((rank - cut_rank) * {PARTS} + place % {PARTS} AS int)"))
    more = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") >= F.col("cut_rank")) & in_edge)
    out = out.withColumn("copies", F.col("passes") + more.cast("int"))
    each = F.slice(F.sequence(F.lit(0), F.col("passes")), F.lit(1), F.col("copies"))
    shards = F.transform(each, lambda p: F.get(F.col("owner"), p * F.lit(BLOCKS) + F.col("rank")))
    places = F.transform(each, lambda p: F.xxhash64(F.lit(seed), p, F.col("order_key")))
    return out.withColumns({"shards": shards, "places": places}).drop("rank", "passes", "ranks", "cut_rank", "edge", "owner")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards, places) of every document: what mix() takes of it, and where.

    shards has the output shard of each copy, as the splitting tree deals them, and places its place in the order of
    that shard. Null and empty texts have size 0. Null sources are one source, the last. No documents give no rows.
    Rows that repeat an id and a text have one hash and are taken alike.
    """
    rows = sized(docs)
    sources, _ = plan(rows, weights, most)
    out = with_copies(rows.withColumns({"key": _key("source"), "order_key": F.xxhash64("doc_id")}), sources)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "shards", "places")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the shard of each copy.

    A partition is a shard, in random order. Columns pass through, whatever their names; one named shard is replaced.
    Sources' sizes count words; see taken() for nulls, empty tables and repeated rows.
    """
    sources, dealt = plan(sized(docs, id_col, text_col, source_col), weights, most, shards, seed)
    rows = docs.select(as_row(docs, ("shard",)), _key(source_col).alias("key"), _place(id_col, text_col).alias("place"), F.xxhash64(id_col).alias("order_key"))
    rows = with_copies(rows, sources, seed)
    rows = rows.select("row", F.explode(F.arrays_zip("shards", "places")).alias("to")).select("row", F.col("to.shards").alias("shard"), F.col("to.places").alias("at"))
    return rows.repartitionById(len(dealt), "shard").sortWithinPartitions("at").select("row.*", "shard")


def brute_force(rows: list[tuple], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> dict:
    """How often each document is taken, of (id, source, place, size) rows, by drawing lists of blocks; for tests."""
    by: dict[str | None, dict[int, list]] = {}
    for d, s, place, n in rows:
        by.setdefault(s, {}).setdefault(place // PARTS, []).append((place % PARTS, d, n))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for b in by[s].values() for _, _, n in b) for s in names]
    out: dict = {d: 0 for d, *_ in rows}
    for s, size, t in zip(names, sizes, targets(sizes, weights, most), strict=True):
        left, times = t, 0
        while size and times < most and left >= size:
            for d in [d for b in by[s].values() for _, d, _ in b]:
                out[d] += 1
            left, times = left - size, times + 1
        blocks = [by[s].get(int(k), []) for k in permuted(s, seed)]
        if not size or times == most or not left:
            continue
        while blocks and (n := sum(n for _, _, n in blocks[0])) <= left:
            for _, d, _ in blocks.pop(0):
                out[d] += 1
            left -= n
        parts = [[x for x in b if x[0] == p] for b in blocks[: _edge_blocks(np.array([len(b) for b in blocks]))] for p in range(PARTS)]
        sums = np.array([sum(n for _, _, n in p) for p in parts], np.int64)
        for part, yes in zip(parts, _fitting(sums, left), strict=True):
            for _, d, n in part if yes else []:
                out[d] += n > 0 or sum(x[2] for x in part) > 0
    return out
