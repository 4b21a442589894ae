"""Phrase collocations by generalised suffix automata.

1. A shard (some megabytes of texts) becomes the generalised suffix automaton of its pieces, cut at ``most`` words.
   Ordered by their words from the last to the first, the ends of all pieces' prefixes lie so that the phrases of k
   words are runs of the order, and a run of k words lies within the run of its last k - 1: the nesting is the tree of
   suffix links, and a run's length its count of end positions. Phrases of one chain with equal counts have the same
   end positions: they are one state, and the state is named by its longest phrase.
2. Each state is enumerated along its chain down to its suffix link. A shard ships each distinct phrase once, as bytes
   beside its count, to a bucket by a hash of language and phrase; so a phrase has at most one entry a shard there,
   however common it is. Buckets add up, by the phrases' bytes, and keep those that reach ``least``: the parts of a
   candidate are at least as common as itself, and nothing else is asked for.
3. A candidate's cuts look up their two parts in the counts. One that a longer one holds drops if enough of its
   occurrences lie there. It suffices to look one word further: what a phrase loses to one that is longer by two, it
   loses to those between as well. So the longer candidates go to their suffix link and to what is left without their
   last word, and the greatest count decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, store
from .textkernel import _SPACE, U, block_of, blocks, lean, mix, packed, unpacked

MOST, LEAST, SUBSUMED, TOP = 3, 10, 50, 2000  # words of a phrase; occurrences; per cent; phrases a language
#: Bytes of text of a shard; of the corpus for each bucket.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: Entries that a bucket holds before it merges them, at least.
MERGE_ROWS = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_PARTS = _SPACE | _BREAK


class Automaton:
    """The suffix automaton, cut at ``most`` words, of pieces of numbered words.

    word: numbers from 1, piece after piece; before: how many words of its piece stand before each. rows: the phrases
    (end, words, count) that are some state's longest, and ``least``, the words of the shortest phrase of that state.
    """

    def __init__(self, word: np.ndarray, before: np.ndarray, most: int):
        n, bits = len(word), max(1, int(word.max(initial=1)).bit_length())
        back = [np.where(before >= k, np.concatenate([np.zeros(min(k, n), word.dtype), word[: max(n - k, 0)]]), 0) for k in range(most)]
        if bits * most <= 64:
            key = np.zeros(n, U)
            for w in back:
                key = key << U(bits) | w.astype(U)
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort(back[::-1])
        fresh = np.zeros(n, bool)  # where a run of this many words begins
        if n:
            fresh[0] = True
        levels = []
        for k, w in enumerate(back):
            w = w[order]
            fresh[1:] |= w[1:] != w[:-1]
            at = np.flatnonzero(fresh)
            levels.append((at, np.diff(np.append(at, n)), w[at] > 0 if k else np.ones(len(at), bool)))
        found = []
        low = None  # of each run of the level below: the least words of its state
        for k, (at, count, real) in enumerate(levels, 1):
            own = np.full(len(at), k)
            if low is not None:
                shorter = np.searchsorted(levels[k - 2][0], at, "right") - 1  # the suffix link
                same = real & (count == levels[k - 2][1][shorter])
                own = np.where(same, low[shorter], k)
                longest[shorter[same]] = False
                found[-1] = (levels[k - 2][0], levels[k - 2][1], low, longest & levels[k - 2][2])
            low, longest = own, np.ones(len(at), bool)
            found.append((at, count, low, longest & real))
        end, words, times, least = [], [], [], []
        for k, (at, count, lows, keep) in enumerate(found, 1):
            end.append(order[at[keep]])
            words.append(np.full(int(keep.sum()), k))
            times.append(count[keep])
            least.append(lows[keep])
        self.end, self.words, self.count, self.least = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (end, words, times, least))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, words, count) of every distinct phrase: each state's chain from its longest down."""
        each = self.words - self.least + 1
        state = np.repeat(np.arange(len(each)), each)
        shorter = np.arange(len(state)) - np.repeat(np.cumsum(each) - each, each)
        return self.end[state], self.words[state] - shorter, self.count[state]


def _pieces(texts: pa.Array, langs: list[str], number: Callable[[str], int]) -> Iterator[tuple]:
    """(size, bytes of the words each followed by a space, their lengths with it, hashes, words before in the piece, language) of blocks."""
    for b in blocks(texts, lower=True, space=_PARTS):
        if not len(b.start):
            continue
        doc = b.doc_of_word()
        breaks = np.cumsum(_BREAK[b.data])[b.start]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
        at = np.flatnonzero(fresh)
        before = np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))
        size = b.end - b.start + 1
        total = int(size.sum())
        ends = np.cumsum(size)
        source = np.repeat(b.start - (ends - size), size) + np.arange(total)
        data = b.folded[np.minimum(source, len(b.data) - 1)]
        data[ends - 1] = 32
        own = np.array([number(x) for x in langs[b.rows : b.rows + b.texts]], np.int64)
        yield len(b.data), data, size.astype(np.int32), b.hashes, before.astype(np.int32), own[doc].astype(np.int32)


def _name_hashes(names: list[str]) -> np.ndarray:
    raw = [f"lang {x}".encode() for x in names]
    at = np.cumsum([0, *map(len, raw)])
    return block_of(np.frombuffer(b"".join(raw), np.uint8), at).span_hash(at[:-1], at[1:])


def _shard(held: list[tuple], most: int, names: list[str]) -> tuple[np.ndarray, ...]:
    """Bytes, lengths, counts, languages and deal hashes of a shard's distinct phrases; a language's words count as the phrase ''."""
    data, size, hashes, before, lang = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
    held.clear()
    own = mix(hashes ^ mix(lang.astype(U) + U(1)))  # a word of another language is another word
    _, word = np.unique(own, return_inverse=True)
    end, words, count = Automaton((word + 1).astype(np.int32), before, most).phrases()
    ends = np.cumsum(size, dtype=np.int64)
    stop = ends[end] - 1  # without the space behind
    start = (ends - size)[end - words + 1]
    length = stop - start
    deal = np.zeros(len(end), U)
    for k in range(most):
        inner = words > k
        deal[inner] = mix(deal[inner] ^ hashes[end[inner] - k])
    said = _name_hashes(names)
    deal = mix(deal ^ said[lang[end]])
    total = np.bincount(lang, minlength=len(names))
    spoken = np.flatnonzero(total)
    return data, np.append(start, np.zeros(len(spoken), np.int64)), np.append(length, np.zeros(len(spoken), np.int64)), np.append(count, total[spoken]), np.append(lang[end], spoken), np.append(deal, mix(said[spoken]))


def counts(docs: DataFrame, most: int = MOST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, f) of every phrase of up to ``most`` words that occurs ``least`` times; phrase '' has all words of a language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = partitions(docs.sparkSession, size, BUCKET_BYTES)

    def sealed(held: list[tuple], names: list[str]) -> pa.RecordBatch:
        zip_ = zstandard.ZstdCompressor(3)
        data, start, length, count, lang, deal = _shard(held, most, names)
        bucket = (deal % U(dealt)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(dealt + 1))
        raw = [x.encode() for x in names]
        keys, blobs = [], []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[k] : cut[k + 1]]
            n = length[own]
            ends = np.cumsum(n)
            text = data[np.repeat(start[own] - (ends - n), n) + np.arange(ends[-1])]
            spoken, said = np.unique(lang[own], return_inverse=True)
            listed = [raw[i] for i in spoken.tolist()]
            keys.append(k)
            blobs.append(zip_.compress(packed(np.frombuffer(b"".join(listed), np.uint8), np.array([*map(len, listed)], np.int32), text, n.astype(np.int32), count[own].astype(np.int32), said.astype(np.int32))))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, taken = [], {}, 0
        for batch in batches:
            for piece in _pieces(batch.column(1), batch.column(0).to_pylist(), lambda x: numbers.setdefault(x, len(numbers))):
                held.append(piece)
                if (taken := taken + piece[0]) >= SHARD_BYTES:
                    yield sealed(held, list(numbers))
                    taken, numbers = 0, {}
        if held:
            yield sealed(held, list(numbers))

    def add_up(blobs: list[bytes]) -> pa.RecordBatch:
        open_, numbers, tables, waiting, had = zstandard.ZstdDecompressor(), {}, [], 0, 0
        for x in blobs:
            names, size, text, n, count, lang = unpacked(open_.decompress(x), "u1", "<i4", "u1", "<i4", "<i4", "<i4")
            at, raw = np.cumsum([0, *size.tolist()]).tolist(), names.tobytes()
            own = np.array([numbers.setdefault(raw[i:j].decode(), len(numbers)) for i, j in zip(at, at[1:], strict=False)], np.int32)
            offsets = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=offsets[1:])
            phrase = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
            tables.append(pa.table({"lang": own[lang], "phrase": phrase, "f": count.astype(np.int64)}))
            waiting += len(n)
            if waiting > max(had, MERGE_ROWS):  # what is held grows with the distinct phrases, and each is merged a few times
                tables, waiting = [merged(tables)], 0
                had = len(tables[0])
        found = merged(tables)
        found = found.filter(pa.compute.or_(pa.compute.greater_equal(found["f"], least), pa.compute.equal(found["phrase"], "")))
        names = pa.array(list(numbers), pa.string()).take(found["lang"].combine_chunks())
        return pa.RecordBatch.from_arrays([names, found["phrase"].combine_chunks().cast(pa.string()), found["f"].combine_chunks()], ["lang", "phrase", "f"])

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return sums.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield add_up(held)
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield add_up(held)

    sent = rows.mapInArrow(lean(ship), "bucket int, blob binary")
    sent = sent.repartitionById(dealt, "bucket").sortWithinPartitions("bucket")
    return store(sent.mapInArrow(lean(reduce), "lang string, phrase string, f long"))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def candidates(counted: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one subsumes, from counts().

    Counts have to lie under 10 ** 16.
    """
    words = F.split("phrase", " ")
    said = counted.where("phrase <> ''")
    long = said.withColumn("words", words).where("size(words) > 1").withColumnRenamed("f", "a")
    part = lambda i, j: F.array_join(F.slice("words", i, j), " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    left, right = (said.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = long.where("size(words) > 2")
    inner = F.array(part(F.lit(2), F.size("words") - 1), part(F.lit(1), F.size("words") - 1))  # the suffix link, the rest
    over = longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    total = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    kept = best.join(over, ["lang", "phrase"], "left").where(F.expr(f"over is null or 100 * over < {int(subsumed)} * a"))
    return kept.join(total, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to ``most`` words of each language.

    A-Z are folded; ``[.,;:!?\\x0A-\\x0D]`` end a piece, ``[\\x20\\x09]`` a word; phrases lie within pieces and may
    overlap. A phrase that occurs a >= ``least`` times is cut where floor(1000000 a a / (l r)) is least, ties at the
    fewest words; one within a longer candidate of ``subsumed`` per cent of its occurrences or more drops. Ranks go by
    score, then a, descending, then by the phrase's bytes. A null language is 'und'; null and empty texts have no
    words; rows that repeat count as often. Ids and other columns are not used. No rows, and no phrase that is common
    enough, give no rows.
    """
    if most < 2 or least < 1:
        raise ValueError("phrases have two words and occur once, at least")
    found = candidates(counts(docs, most, least, lang_col, text_col), subsumed)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def brute_force(rows: list[tuple], most: int = MOST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> list[tuple]:
    """collocations() of (lang, text) rows, for tests."""
    import re
    from collections import Counter

    by: dict[str, list[list[bytes]]] = {}
    for lang, text in rows:
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
        by.setdefault("und" if lang is None else lang, []).extend(re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0A-\x0D]", folded))
    out = []
    for lang, pieces in by.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, most + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found, over = [], Counter()
        for q, b in cands.items():
            for p in {q[i : i + k] for k in range(2, len(q)) for i in range(len(q) - k + 1)}:
                over[p] = max(over[p], b)
        for p, a in cands.items():
            if p in over and 100 * over[p] >= subsumed * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, b" ".join(p), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return out
