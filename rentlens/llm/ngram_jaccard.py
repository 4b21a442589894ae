"""Jaccard similarity join of word n-gram sets by prefix trees.

1. Every text becomes the set of hashes of its n-grams. Texts with one set form a class, named by a hash of the set.
2. All (n-gram, class) pairs are dealt by n-gram, as packed arrays. Where they meet, n-grams of a single class go:
   they can be in no intersection. The rest return to their class with their document frequency. The pairs of very
   common n-grams are dealt by class too: such an n-gram stays whatever its count, and comes last in the order. Very
   common are n-grams of a certain share of all, and all n-grams of heavy buckets, whose load is counted beforehand: as
   buckets keep their size while the corpus grows, an n-gram far below the share can fill one.
3. A class links only if its repeated n-grams reach ``share`` of its set; the others are done.
4. One order holds for all n-grams: by (frequency, hash), rarest first. Two sets that link share an n-gram of their
   prefixes (all but the last ``ceil(share * size) - 1`` n-grams), so components over shared prefix n-grams hold all
   links.
5. Within such a component, chunks of sets meet each other once. One chunk's sets form a prefix tree in that order,
   the commonest n-gram first; a node holds all n-grams up to where its sets differ. The other chunk's sets go down
   the tree together by the places where they hold an n-gram, share the overlap counted on common paths, and leave a
   subtree when what remains of path or set cannot reach the share.
6. Links that join trees of a forest go on to connected components; the rest are counted and dropped.

A 64-bit hash stands for an n-gram and for a set: of m sets, two collide with odds m * m / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import class_components, components, forest
from .scratch import as_row, partitions, store
from .textkernel import Block, U, blocks, lean, mix, packed, rolled, row_key, unpacked

N, SHARE = 5, 80  # words; per cent
#: Sets in a chunk that others are compared with, and about the n-grams of all of them; bytes of text whose sets are
#: packed together.
CHUNK, CHUNK_GRAMS, SENT_BYTES = 128, 1 << 20, 8 << 20
#: N-grams that make up over 1 / HOT_SHARE of all are very common, and count as of this frequency.
HOT_SHARE, HOT = 4096, (1 << 31) - 1
#: A bucket is heavy with this many times the mean of n-grams; bytes of text for each bucket.
HEAVY, BUCKET_BYTES = 4, 36 << 20


def _sets(b: Block, n: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text; of a text of fewer words, one for all of them."""
    grams = rolled(b.hashes, n)
    first = b.first.tolist()
    for i, j in zip(first, first[1:], strict=False):
        if j - i >= n:
            yield np.unique(grams[i : j - n + 1])
        elif j > i:
            yield mix(rolled(b.hashes[i:j], j - i, 9) + U(j - i))
        else:
            yield np.zeros(0, U)


def _name(grams: np.ndarray) -> int:
    """A class's name: a hash of its set."""
    return int(mix(np.array([mix(grams ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U) + U(len(grams)))[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Common:
    """Which n-grams are dealt by class: the very common ones, and those of heavy buckets."""

    def __init__(self, hot: np.ndarray, heavy: np.ndarray, dealt: int):
        self.hot, self.heavy, self.dealt = np.sort(hot), np.sort(heavy), dealt

    def has(self, grams: np.ndarray) -> np.ndarray:
        found = _among(self.hot, grams)
        return found | _among(self.heavy, grams % U(self.dealt)) if len(self.heavy) else found


def shingle_classes(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", dealt: int = 1) -> tuple[DataFrame, Common]:
    """(doc_id, key, mark, n_shingles, class) of every text, written out; and what is common among ``dealt`` buckets.

    class is null where there are no words. At most 2 * HOT_SHARE n-grams are very common, as each is that share, and
    at most 1 / HEAVY of the buckets heavy.
    """
    kind = "doc_id long, key long, mark long, n_shingles long, class long, gram long, times long, bucket int"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(dealt, np.int64)

        def sealed(columns: list, grams: np.ndarray, times: np.ndarray, buckets: pa.Array) -> pa.RecordBatch:
            rows, extra = len(columns[0]), len(grams)
            columns = [pa.concat_arrays([c.cast(pa.int64()), pa.nulls(extra, pa.int64())]) for c in columns]
            own = [pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(x.view(np.int64))]) for x in (grams, times)]
            return pa.RecordBatch.from_arrays([*columns, *own, pa.concat_arrays([pa.nulls(rows, pa.int32()), buckets])], [c.split()[0] for c in kind.split(", ")])

        for batch in batches:
            sizes, names, often = [], [], []
            for b in blocks(batch.column(3), lower=True):
                sets = list(_sets(b, n))
                sizes += [len(s) for s in sets]
                names += [_name(s) for s in sets]
                values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, U), return_counts=True)
                loads += np.bincount((values % U(dealt)).astype(np.int64), weights=counts, minlength=dealt).astype(np.int64)
                much = counts >= max(2, int(counts.sum()) // (2 * HOT_SHARE))
                often.append((values[much], counts[much]))
            none = np.array(sizes) == 0
            grams, times = (np.concatenate([np.zeros(0, np.int64), *(x[k].view(np.int64) for x in often)]) for k in (0, 1))
            own = [pa.array(sizes, pa.int64()), pa.array(np.array(names, U).view(np.int64), mask=none)]
            yield sealed([*(batch.column(i) for i in range(3)), *own], grams, times, pa.nulls(len(grams), pa.int32()))
        full = np.flatnonzero(loads)
        yield sealed([pa.nulls(0, pa.int64())] * 5, np.zeros(len(full), np.int64), loads[full], pa.array(full.astype(np.int32)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    made = store(rows.mapInArrow(lean(go), kind))
    found = made.where("key is not null").drop("gram", "times", "bucket")
    total = found.agg(F.sum("n_shingles")).first()[0] or 0
    some = made.where("key is null and bucket is null").groupBy("gram").agg(F.sum("times").alias("n")).where(F.col("n") >= max(64, total // (2 * HOT_SHARE)))
    hot = np.array([r[0] for r in some.select("gram").collect()], np.int64).view(U)
    load = made.where("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("n")).where(F.col("n") > HEAVY * total / dealt)
    heavy = np.array([r[0] for r in load.select("bucket").collect()], np.int64).view(U)
    return found, Common(hot, heavy, dealt)


def _among(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x if len(sorted_set) else np.zeros(len(x), bool)


def _ranges(order_key: np.ndarray, dealt: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(order_key, kind="stable")
    return order, np.searchsorted(order_key[order], np.arange(dealt + 1))


def shipped(docs: DataFrame, n: int, text_col: str, common: Common, dealt: int) -> DataFrame:
    """(bucket, blob) of class, size, run and n-grams: every n-gram of every class, as a map batch has them."""

    def seal(names: list, sets: list) -> pa.RecordBatch:
        name, one = np.unique(np.array(names, U), return_index=True)
        sets = [sets[i] for i in one.tolist()]
        sizes = np.array([len(s) for s in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        to = np.where(common.has(grams), mix(grams ^ name[owner]), grams) % U(dealt)
        order, cut = _ranges(to.astype(np.uint32 if dealt > 65535 else np.uint16), dealt)
        grams, owner = grams[order], owner[order]
        keys, blobs = [], []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own = owner[cut[k] : cut[k + 1]]
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            who = own[begins]
            keys.append(k)
            blobs.append(packed(name[who], sizes[who].astype(np.int32), np.diff(np.append(begins, len(own))).astype(np.int32), grams[cut[k] : cut[k + 1]]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets, size = [], [], 0
            for b in blocks(batch.column(0), lower=True):
                for s in _sets(b, n):
                    if len(s):
                        names.append(_name(s))
                        sets.append(s)
                if (size := size + len(b.data)) > SENT_BYTES and sets:
                    yield seal(names, sets)
                    names, sets, size = [], [], 0
            if sets:
                yield seal(names, sets)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(ship), "bucket int, blob binary")


def _repeated(docs: DataFrame, n: int, text_col: str, common: Common, dealt: int) -> DataFrame:
    """(bucket, blob) of class, size, run, n-grams and frequencies, for the n-grams of two classes or more, and common ones."""

    def meet(blobs: list[bytes]) -> pa.RecordBatch | None:
        parts = [unpacked(x, "<u8", "<i4", "<i4", "<u8") for x in blobs]
        name, size, run, grams = (np.concatenate([p[i] for p in parts]) for i in range(4))
        owner = np.repeat(np.arange(len(name), dtype=np.int32), run)
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        tied = np.zeros(len(g), bool)
        tied[1:] = g[1:] == g[:-1]
        tied[:-1] |= tied[1:]
        tied |= common.has(g)
        g, owner = g[tied], owner[order[tied]]
        order = np.lexsort((name[owner], g))
        g, owner = g[order], owner[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (name[owner[1:]] != name[owner[:-1]])
        g, owner = g[fresh], owner[fresh]
        if not len(g):
            return None
        group = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
        often = np.where(common.has(g), HOT, np.bincount(group)[group]).astype(np.int32)
        g, owner, often = g[often > 1], owner[often > 1], often[often > 1]
        if not len(g):
            return None
        who = name[owner]
        order = np.argsort(who, kind="stable")
        g, owner, often, who = g[order], owner[order], often[order], who[order]
        order, cut = _ranges((mix(who) % U(dealt)).astype(np.int64), dealt)
        keys, out = [], []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[k] : cut[k + 1]]
            begins = np.flatnonzero(np.append(True, who[at][1:] != who[at][:-1]))
            keys.append(k)
            out.append(packed(who[at][begins], size[owner[at][begins]], np.diff(np.append(begins, len(at))).astype(np.int32), g[at], often[at]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])

    sent = shipped(docs, n, text_col, common, dealt)
    sent = sent.repartitionById(dealt, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lean(_by_bucket(meet)), "bucket int, blob binary")


def _by_bucket(f):
    """Apply f to the blobs of each bucket of a partition sorted by bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    if (found := f(held)) is not None:
                        yield found
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held and (found := f(held)) is not None:
            yield found

    return go


def _candidates(repeated: DataFrame, share: int, dealt: int) -> DataFrame:
    """(class, size, grams, often, prefix) of the classes whose repeated n-grams reach the share; grams with their frequencies."""

    def gather(blobs: list[bytes]) -> pa.RecordBatch | None:
        parts = [unpacked(x, "<u8", "<i4", "<i4", "<u8", "<i4") for x in blobs]
        name, size, run, grams, often = (np.concatenate([p[i] for p in parts]) for i in range(5))
        who = np.repeat(np.arange(len(name)), run)
        order = np.lexsort((grams, often, name[who]))
        who, grams, often = who[order], grams[order], often[order]
        begins = np.flatnonzero(np.append(True, name[who[1:]] != name[who[:-1]]))
        ends = np.append(begins[1:], len(who))
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
            m = int(size[who[i]])
            if 100 * (j - i) < share * m:
                continue
            prefix = m - -(-share * m // 100) + 1 - (m - (j - i))
            out[0].append(int(name[who[i]].view(np.int64)))
            out[1].append(m)
            out[2].append(grams[i:j].tobytes())
            out[3].append(often[i:j].tobytes())
            out[4].append(grams[i : i + prefix].view(np.int64).tolist())
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["class", "size", "grams", "often", "prefix"])

    rows = repeated.repartitionById(dealt, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lean(_by_bucket(gather)), "class long, size int, grams binary, often binary, prefix array<long>")


def trie_links(built: list[np.ndarray], built_size: np.ndarray, probes: list[np.ndarray], probe_size: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in built, in probes) of the pairs of sets that reach the share.

    A set is the ascending places of its n-grams in one order; n-grams that no other set has may be left out, as the
    sizes are those of the whole sets. What is kept is in proportion to the sets.
    """
    order = sorted(range(len(built)), key=lambda i: built[i].astype(">u8").tobytes())
    rows, size = [built[i] for i in order], built_size[order].astype(np.int64)
    length = np.array([len(r) for r in rows])
    same = np.zeros(len(rows) + 1, np.int64)  # n-grams that a path begins with as the one before it
    for i in range(1, len(rows)):
        m = min(len(rows[i - 1]), len(rows[i]))
        differ = np.flatnonzero(rows[i - 1][:m] != rows[i][:m])
        same[i] = differ[0] if len(differ) else m
    flat = np.concatenate(probes).astype(np.int64) if probes else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
    ends = np.cumsum([len(p) for p in probes])
    span = int(max(flat.max(initial=0), max((int(r[-1]) for r in rows if len(r)), default=0))) + 2
    keyed = own * span + flat  # sorted, as every probe is
    by = np.argsort(flat, kind="stable")
    places, holders = flat[by], own[by]
    wide = probe_size.astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(rows), 0, np.zeros(len(probes), np.int64), np.arange(len(probes)))]
    while stack:
        lo, hi, depth, overlap, active = stack.pop()
        to = int(same[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        edge = rows[lo][depth:to]
        if len(edge):
            first, last = np.searchsorted(places, edge), np.searchsorted(places, edge, "right")
            n = last - first
            held = holders[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            overlap = overlap + np.bincount(held, minlength=len(probes))[active]
        past = int(rows[lo][to - 1]) if to else -1
        left = ends[active] - np.searchsorted(keyed, active * span + past, "right")
        rest = np.minimum(left, int(length[lo:hi].max()) - to)
        stay = (100 + share) * (overlap + rest) >= share * (wide[active] + int(size[lo:hi].min()))
        overlap, active = overlap[stay], active[stay]
        if not len(active):
            continue
        while lo < hi and length[lo] == to:  # paths that end here
            good = (100 + share) * overlap >= share * (wide[active] + size[lo])
            found.append((np.full(int(good.sum()), order[lo]), active[good]))
            lo += 1
        cuts = [lo, *(np.flatnonzero(same[lo + 1 : hi] == to) + lo + 1).tolist(), hi]
        stack += [(i, j, to, overlap, active) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _places(sets: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The ascending places of each set's n-grams that are known."""
    out = []
    for grams, _ in sets:
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out.append(np.sort(rank[at[known[at] == grams]]))
    return out


def _links(candidates: DataFrame, share: int, dealt: int) -> DataFrame:
    """(a, b, linked): tree edges between classes (linked null), and linked documents of a class (b null)."""
    posted = candidates.select("class", F.explode("prefix").alias("gram"))
    least = store(posted.groupBy("gram").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1").select("gram", "least"))
    cells = components(posted.join(least, "gram").select(F.col("class").alias("a"), F.col("least").alias("b")))
    sized = candidates.select(F.col("class").alias("node"), (F.length("grams") / 8).alias("grams"))
    large = cells.join(sized, "node").groupBy("label").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("grams") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    large = store(large.where("chunks > 1"))
    cells = cells.join(large, "label", "left").select(F.col("node").alias("class"), F.col("label").alias("cell"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
    rows = candidates.drop("prefix").join(cells, "class")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("cell", i.alias("i"), j.alias("j"), (F.col("own") != i).alias("probe"), "class", "size", "copies", "grams", "often", F.pmod(F.xxhash64("cell") + i * F.col("chunks") + j, F.lit(dealt)).cast("int").alias("to"))

    def join(built: list, probes: list) -> pa.RecordBatch | None:
        alone = not probes
        if alone:
            probes = built
        names, sizes, copies, sets = zip(*built, strict=True)
        names2, sizes2, copies2, sets2 = zip(*probes, strict=True)
        known, at = np.unique(np.concatenate([g for g, _ in sets]), return_index=True)
        often = np.concatenate([o for _, o in sets])[at]
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, often))[::-1]] = np.arange(len(known))  # the global order from its end
        mine = _places(sets, known, rank)
        x, y = trie_links(mine, np.array(sizes), mine if alone else _places(sets2, known, rank), np.array(sizes2), share)
        if alone:
            x, y = x[x < y], y[x < y]
        if not len(x):
            return None
        left, right = np.array(names)[x], np.array(names2)[y]
        who, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        linked = np.bincount(at, weights=np.concatenate([np.array(copies2)[y], np.array(copies)[x]])).astype(np.int64)
        tree = list(forest(left, right))
        a = pa.array([*(p for p, _ in tree), *who.tolist()], pa.int64())
        b = pa.array([*(q for _, q in tree), *[None] * len(who)], pa.int64())
        return pa.RecordBatch.from_arrays([a, b, pa.array([*[None] * len(tree), *linked.tolist()], pa.int64())], ["a", "b", "linked"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, built, probes = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["cell"], r["i"], r["j"])
                if key != now:
                    if built and (probes or now[1] == now[2]) and (found := join(built, probes)) is not None:
                        yield found
                    now, built, probes = key, [], []
                (probes if r["probe"] else built).append((r["class"], r["size"], r["copies"], (np.frombuffer(r["grams"], "<u8"), np.frombuffer(r["often"], "<i4"))))
        if built and (probes or now[1] == now[2]) and (found := join(built, probes)) is not None:
            yield found

    rows = rows.repartitionById(dealt, "to").sortWithinPartitions("cell", "i", "j")
    return rows.drop("to").mapInArrow(lean(meet), "a long, b long, linked long")


def similar_groups(docs: DataFrame, n: int = N, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, mark, n_shingles, component_id, n_links) of every row of ``docs``.

    Two texts link if 100 * intersection >= share * union of their sets of distinct ``n``-word shingles; a text of
    fewer words has one shingle, all of it. component_id is the least id that links reach, itself included; n_links
    counts directly linked rows, exact copies among them. Null and empty texts, and those of white space, have no
    shingles, link with nothing and are their own component. Rows that repeat an id with another text are texts of
    their own; a null id takes part, but names no component unless alone. key and mark are a 128-bit hash of id and
    text. Other columns are not used. No rows give no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    dealt = partitions(docs.sparkSession, size, BUCKET_BYTES)
    found, common = shingle_classes(docs, n, id_col, text_col, dealt)
    classes = store(found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    candidates = _candidates(_repeated(docs, n, text_col, common, dealt), share, dealt)
    candidates = store(candidates.join(classes.select("class", "copies"), "class"))
    links = store(_links(candidates, share, dealt))
    full = class_components(classes, links)
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.join(full, "class", "left").select("doc_id", "key", "mark", "n_shingles", own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, once: one document of each group of similar ones.

    All columns pass through, whatever their names. See similar_groups() for nulls, ties and empty tables; of rows that
    repeat whole one stays.
    """
    kept = similar_groups(docs, n, share, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("key", "mark").distinct()
    rows = docs.select(as_row(docs), *row_key(id_col, text_col)).join(kept, ["key", "mark"], "left_semi")
    once = Window.partitionBy("key", "mark").orderBy(F.lit(0))
    return rows.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")


def brute_force(texts: list[tuple], n: int = N, share: int = SHARE) -> list[tuple]:
    """(id, n_shingles, component_id, n_links) of (id, text) rows, for tests."""
    sets = []
    for _, t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label, links = list(range(len(texts))), [0] * len(texts)

    def top(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * (m := len(sets[i] & sets[j])) >= share * (len(sets[i]) + len(sets[j]) - m):
                links[i] += 1
                links[j] += 1
                label[max(top(i), top(j))] = min(top(i), top(j))
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least[top(i)], links[i]) for i, (d, _) in enumerate(texts)]
