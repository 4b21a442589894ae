"""Toxicity by weak supervision.

Many voters look at a text: lexicons of words and of word beginnings, found on labelled rows; fixed lexicons; and
patterns of both. A generative model of their votes, of a few latent classes, estimates each voter's rates, and so how
far voters repeat each other, by expectation maximisation without labels. It is fitted to the votes for every document:
what it needs of them is how often each pattern of votes occurs, copies counted once, which Spark counts. Labels say
which of its classes are the toxic ones, and nothing else there. A linear classifier on words, beginnings and votes
then learns the model's posterior labels on the sampled labelled rows, and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import chosen_labels, first_of_copies, fit_logistic, held_out, sampled_shares, sigmoid
from .scratch import as_row, store
from .textkernel import Block, U, block_of, blocks, lean, mix, packed, rolled, unpacked

#: Labelled rows to learn from at most, clean and toxic; patterns of votes that the driver takes, where more stay apart.
SAMPLE, PATTERNS_HERE = (6000, 3000), 1 << 18
#: Bytes of a word's beginning that count as a feature; 0 is the whole word. Each is a kind of lexicon, in BANDS by
#: how much its entries say.
STEMS = (0, 4, 5, 6)
BANDS = 3
#: Latent classes of the label model.
CLASSES = 16
#: Fixed lexicons, lower case.
INSULTS = ("idiot", "moron", "loser", "scum", "clown", "trash", "imbecile", "jerk", "fool", "vermin")
CONTEMPT = ("stupid", "worthless", "pathetic", "disgusting", "dumb", "ugly", "filthy", "useless", "vile", "despicable")
CURSES = ("damn", "crap", "bastard", "bitch", "asshole", "bullshit", "fuck", "fucking", "shit", "piss")
THREATS = ("kill", "murder", "hurt", "strangle", "destroy", "burn", "beat", "punish", "suffer", "drown")
HATE = ("hate", "loathe", "despise", "detest", "disgust", "subhuman", "inferior", "parasites", "savages", "filth")
SECOND_PERSON = ("you", "your", "you're", "yourself")
LEXICONS = (INSULTS, CONTEMPT, CURSES, THREATS, HATE)
#: The voters that are not learned, in order: the lexicons, then patterns over them.
PATTERNS = ("insults", "contempt", "curses", "threats", "hate", "addressed insult", "shouted insult", "insult with contempt", "repeated insults", "several lexicons", "threat to the reader", "exclaimed insult")
_MASK = (1 << 20) - 1


def _lexicon(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    b = block_of(data, np.array([0, len(data)]), lower=True)
    return np.sort(b.span_hash(b.start, b.end))


def _letters(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the words without marks around them: ASCII that is neither letter nor digit."""
    mark = np.ones(256, bool)
    mark[48:58] = mark[65:91] = mark[97:123] = mark[128:] = False
    inner = np.flatnonzero(~mark[b.data])  # the bytes that a word may begin and end with
    if not len(inner):
        return b.start, b.start + 1
    first = np.searchsorted(inner, b.start)
    start = np.minimum(inner[np.minimum(first, len(inner) - 1)], b.end - 1)
    start = np.where(first < len(inner), start, b.end - 1)
    end = inner[np.maximum(np.searchsorted(inner, b.end) - 1, 0)] + 1
    return start, np.maximum(end, start + 1)


def features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and feature (its kind and half a hash), for each word itself, then each beginning of longer words; words' hashes."""
    start, end = _letters(b)
    doc = b.doc_of_word()
    words = b.span_hash(start, end)
    docs, found = [doc], [words >> U(34)]
    for kind, k in enumerate(STEMS[1:], 1):
        longer = end - start > k
        docs.append(doc[longer])
        found.append(mix(b.span_hash(start[longer], start[longer] + k) + U(k)) >> U(34) | U(kind << 30))
    return np.concatenate(docs), np.concatenate(found), words


def _is_in(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _pattern_votes(b: Block, words: np.ndarray) -> np.ndarray:
    """Texts x PATTERNS."""
    doc = b.doc_of_word()
    held = [_is_in(_lexicon(x), words) for x in LEXICONS]
    insult, contempt, curse, threat, hate = held
    second = _is_in(_lexicon(SECOND_PERSON), words)
    bad = insult | contempt | curse
    near, after = np.zeros(len(words), bool), np.zeros(len(words), bool)
    for k in (1, 2, 3):
        near[k:] |= second[:-k] & (doc[k:] == doc[:-k])
        after[:-k] |= second[k:] & (doc[k:] == doc[:-k])
    upper = (b.data >= 65) & (b.data <= 90)
    loud, shout = np.zeros(len(words), bool), np.zeros(len(words), bool)
    if len(words):
        total = np.concatenate([[0], np.cumsum(upper)])
        loud = 2 * (total[b.end] - total[b.start]) > b.end - b.start
        shout = b.data[b.end - 1] == 33
    times = lambda x: np.bincount(doc[x], minlength=b.texts)
    hits = [times(x) for x in held]
    more = [times(bad & near) > 0, times(bad & loud) > 0, (hits[0] > 0) & (hits[1] > 0), hits[0] > 2, sum((h > 0).astype(int) for h in hits) > 2, times(threat & (near | after)) > 0, times(bad & shout) > 0]
    return np.stack([*(h > 0 for h in hits), *more], axis=1)


@dataclass
class Model:
    """known: sorted features; band: lexicon of each; weight, bias: the linear classifier's; lexicons: how many.

    labels: the label model of the votes; toxic: which of its classes are.
    """

    known: np.ndarray
    band: np.ndarray
    weight: np.ndarray
    bias: float
    lexicons: int
    labels: LabelModel | None = None
    toxic: np.ndarray | None = None

    def estimates(self) -> list[tuple[str, float, float, float]]:
        """Of each voter: name, how often it votes for clean and for toxic texts, greatest correlation with another among toxic ones."""
        if self.labels is None:
            return []
        rates, correlations = self.labels.voters(self.toxic)
        kinds = [f"words from {k} bytes" if k else "words" for k in STEMS]
        names = [*(f"{k}, band {i}" for k in kinds for i in range(BANDS)), *(f"{k}, often" for k in kinds), *PATTERNS]
        most = (correlations[1] - np.eye(len(names))).max(1)
        return [(x, float(a), float(b), float(c)) for x, a, b, c in zip(names, *rates, most, strict=True)]

    @property
    def voters(self) -> int:
        """Each lexicon votes for a text with one of its entries; each kind of them for one with three; then patterns."""
        return self.lexicons + self.lexicons // BANDS + len(PATTERNS)

    def found(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and known feature, each pair once, and pattern votes."""
        doc, seen, words = features(b)
        table = np.zeros(_MASK + 1, bool)
        table[(self.known & U(_MASK)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(seen & U(_MASK)).astype(np.int64)])
        maybe = maybe[_is_in(self.known, seen[maybe])]
        pairs = np.unique(doc[maybe] * (len(self.known) + 1) + np.searchsorted(self.known, seen[maybe]))
        return pairs // (len(self.known) + 1), pairs % (len(self.known) + 1), _pattern_votes(b, words)

    def votes(self, texts: int, doc: np.ndarray, feature: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """Texts x voters, 1 or 0."""
        n = self.lexicons
        hits = np.bincount(doc * max(n, 1) + self.band[feature], minlength=texts * max(n, 1)).reshape(texts, -1)[:, :n] if len(doc) else np.zeros((texts, n), int)
        often = hits.reshape(texts, -1, BANDS).sum(2) > 1 if n else hits > 1
        return np.concatenate([hits > 0, often, patterns], axis=1)

    def score(self, b: Block) -> np.ndarray:
        doc, feature, patterns = self.found(b)
        n = len(self.known)
        votes = self.votes(b.texts, doc, feature, patterns)
        return sigmoid(self.bias + np.bincount(doc, weights=self.weight[:n][feature], minlength=b.texts) + votes @ self.weight[n:])


@dataclass
class LabelModel:
    """share: of each latent class; rate: classes x voters, how often a voter votes for a text of the class."""

    share: np.ndarray
    rate: np.ndarray

    def members(self, votes: np.ndarray) -> np.ndarray:
        """Texts x classes: the posterior of each class."""
        v = votes.astype(float)
        log = np.log(self.share) + v @ np.log(self.rate).T + (1 - v) @ np.log(1 - self.rate).T
        q = np.exp(log - log.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)

    def named(self, members: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which classes are toxic: most of their labelled texts are, or, without any, they have more votes than most."""
        known = y >= 0
        size, ones = members[known].sum(0), members[known & (y == 1)].sum(0)
        return np.where(size >= 1, 2 * ones > size, self.rate.mean(1) > self.share @ self.rate.mean(1))

    def voters(self, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the two groups of classes: rates (2 x voters), and correlations (2 x voters x voters) within each.

        Voters that repeat one another vote together in some classes of a group and not in others.
        """
        rates, correlations = [], []
        for ours in (~toxic, toxic):
            w = self.share[ours] / max(self.share[ours].sum(), 1e-12)
            mean = w @ self.rate[ours]
            rest = self.rate[ours] - mean
            both = (rest * w[:, None]).T @ rest + np.diag(w @ (self.rate[ours] * (1 - self.rate[ours])))
            spread = np.sqrt(np.diag(both) + 1e-12)
            rates.append(mean)
            correlations.append(both / np.outer(spread, spread))
        return np.array(rates), np.array(correlations)


def label_model(votes: np.ndarray, classes: int = CLASSES, rounds: int = 100) -> LabelModel:
    """The generative model of the votes, by expectation maximisation; no label goes in.

    votes: texts x voters, 1 or 0. Within a latent class voters err apart from each other; that voters repeat each
    other, and that toxic texts differ in what they have, shows in there being several classes of a label. It begins
    with votes that are frequent and far from each other, the most frequent first.
    """
    seen, times = np.unique(votes, axis=0, return_counts=True)
    return fitted(_Here(seen, times.astype(float)), classes, rounds)


class _Here:
    """Patterns of votes and how often each occurs, in memory."""

    def __init__(self, seen: np.ndarray, times: np.ndarray):
        self.seen, self.times = seen.astype(float), times

    def sums(self, model: LabelModel) -> tuple[np.ndarray, np.ndarray]:
        """Expected texts of each class, and their votes."""
        w = model.members(self.seen) * self.times[:, None]
        return w.sum(0), w.T @ self.seen

    def next_begin(self, begun: list[np.ndarray]) -> np.ndarray | None:
        """The most frequent pattern; then the one that is far from all of those and frequent."""
        if not begun:
            return self.seen[int(np.argmax(self.times))]
        far = np.min([np.abs(self.seen - x).sum(1) for x in begun], axis=0)
        at = int(np.argmax(far * np.sqrt(self.times)))
        return self.seen[at] if far[at] > 0 else None


class _Apart:
    """The same over a table (pattern, n) of more patterns than the driver takes: a job a round, some numbers a task."""

    def __init__(self, table: DataFrame, voters: int):
        self.table, self.voters = table, voters

    def _folded(self, one, schema: str) -> list:
        voters = self.voters

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield one(_Here(_bits(batch.column(0).to_numpy(), voters), batch.column(1).to_numpy().astype(float)), batch.column(0).to_numpy())

        return self.table.mapInArrow(lean(go), schema).collect()

    def sums(self, model: LabelModel) -> tuple[np.ndarray, np.ndarray]:
        def one(here: _Here, _: np.ndarray) -> pa.RecordBatch:
            size, ones = here.sums(model)
            return pa.RecordBatch.from_arrays([pa.array([size.tolist()]), pa.array([ones.ravel().tolist()])], ["size", "ones"])

        got = self._folded(one, "size array<double>, ones array<double>")
        return sum(np.array(r["size"]) for r in got), sum(np.array(r["ones"]) for r in got).reshape(-1, self.voters)

    def next_begin(self, begun: list[np.ndarray]) -> np.ndarray | None:
        def one(here: _Here, pattern: np.ndarray) -> pa.RecordBatch:
            far = np.min([np.abs(here.seen - x).sum(1) for x in begun], axis=0) if begun else np.ones(len(here.seen))
            score = far * np.sqrt(here.times)
            at = np.lexsort((pattern, -score))[:1]
            return pa.RecordBatch.from_arrays([pa.array(score[at]), pa.array(pattern[at])], ["score", "pattern"])

        got = sorted(((-r["score"], r["pattern"]) for r in self._folded(one, "score double, pattern long")))
        return _bits(np.array([got[0][1]]), self.voters)[0].astype(float) if got and got[0][0] < 0 else None


def _bits(pattern: np.ndarray, voters: int) -> np.ndarray:
    """Votes of patterns: the first voter is the highest bit, so that numbers are ordered as votes are."""
    return (pattern[:, None] >> np.arange(voters - 1, -1, -1)) & 1 == 1


def fitted(given: _Here | _Apart, classes: int = CLASSES, rounds: int = 100) -> LabelModel:
    """label_model() of patterns and their numbers."""
    begun: list[np.ndarray] = []
    while len(begun) < classes and (x := given.next_begin(begun)) is not None:
        begun.append(x)
    model = LabelModel(np.full(len(begun), 1 / len(begun)), 0.1 + 0.8 * np.array(begun))
    for _ in range(rounds):
        size, ones = given.sums(model)
        before, model = model, LabelModel((size + 1) / (size.sum() + len(begun)), np.clip((ones + 0.5) / (size[:, None] + 1), 1e-4, 1 - 1e-4))
        if np.abs(before.rate - model.rate).max() < 1e-6:
            break
    return model


def _lexicons(parts: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features whose share of toxic texts is beyond chance, over as many features as there are, and the lexicon of each.

    Only labelled rows are looked at. parts: each row's distinct features.
    """
    labelled = np.flatnonzero(y >= 0)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    cells = np.zeros(1 << 22, np.int32)  # toxic rows by a part of the feature: what few of them have is not looked at
    seen = np.zeros(1 << 22, bool)
    for i in labelled.tolist():
        seen[parts[i] & 0x3FFFFF] = True
        if y[i] == 1:
            cells[parts[i] & 0x3FFFFF] += 1
    kept = [parts[i][cells[parts[i] & 0x3FFFFF] >= 4] for i in labelled.tolist()]
    known, at = np.unique(np.concatenate(kept), return_inverse=True)
    own = np.repeat(labelled, [len(p) for p in kept])
    df, df1 = np.bincount(at, minlength=len(known)), np.bincount(at, weights=y[own], minlength=len(known))
    p = n1 / (n1 + n0)
    rate = np.clip(df1 / df, 1e-9, 1 - 1e-9)
    surprise = df * (rate * np.log(rate / p) + (1 - rate) * np.log((1 - rate) / (1 - p)))
    chosen = (rate > p) & (surprise > np.log(max(int(seen.sum()), 1000))) & (df1 / n1 > 5 * (df - df1) / n0)
    gain = np.log((df1[chosen] + 0.5) / n1) - np.log((df[chosen] - df1[chosen] + 0.5) / n0)
    known = known[chosen]
    kind = (known >> 30).astype(np.int64)
    lexicon = np.zeros(len(known), np.int64)
    for k in range(len(STEMS)):
        ours = np.flatnonzero(kind == k)
        rank = np.argsort(np.argsort(-gain[ours], kind="stable"), kind="stable")
        lexicon[ours] = k * BANDS + rank * BANDS // max(1, len(ours))
    return known.astype(U), lexicon


def _marks(b: Block) -> list[int]:
    """A hash that copies, and most near copies, of a text share."""
    grams, out = rolled(b.hashes, 5), []
    for i, j in zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True):
        own = grams[i : max(j - 4, i)]
        out.append(int((own.min() if len(own) else b.hashes[i:j].sum(dtype=U)).view(np.int64)))
    return out


def _sampled(docs: DataFrame, labels: DataFrame, label: str, sample: tuple[int, int], id_col: str, text_col: str) -> tuple[np.ndarray, list, np.ndarray]:
    """Labels, distinct features and pattern votes of the sampled labelled rows; copies count once."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, marks = [], []
            for b in blocks(batch.column(2), lower=True):
                doc, seen, words = features(b)
                votes = _pattern_votes(b, words)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(b.texts + 1))
                blobs += [packed(np.unique(seen[order[cut[i] : cut[i + 1]]]).astype(np.uint32), votes[i]) for i in range(b.texts)]
                marks += _marks(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(marks, pa.int64())], ["id", "y", "blob", "mark"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ours = chosen_labels(labels, label, sample, id_col).select(F.col("id").cast("string").alias("id"), "y")
    rows = rows.join(F.broadcast(ours), "id").select("id", "y", "text")  # no more labels than the sample's bound
    made = rows.mapInArrow(lean(shrink), "id string, y int, blob binary, mark long")  # of rows that repeat, a few leave each task
    got = made.groupBy("id", "y").agg(F.min(F.struct("mark", "blob")).alias("one")).select("y", "one.mark", "one.blob").toArrow()
    y, marks = np.array(got.column("y").to_pylist(), np.int64), np.array(got.column("mark").to_pylist(), np.int64)
    keep = first_of_copies(marks, y)
    blobs = got.column("blob")
    parts = [unpacked(blobs[i].as_py(), "<u4", "?") for i in keep.tolist()]
    return y[keep], [p[0] for p in parts], np.array([p[1] for p in parts], bool).reshape(len(parts), len(PATTERNS))


def vote_patterns(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(pattern, n): how often each pattern of votes occurs among all texts, copies counted once; the voters are its bits."""
    power = 1 << np.arange(model.voters - 1, -1, -1, dtype=np.int64)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0), lower=True):
                votes = model.votes(b.texts, *model.found(b))
                yield pa.RecordBatch.from_arrays([pa.array(votes @ power), pa.array(_marks(b), pa.int64())], ["pattern", "mark"])

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(go), "pattern long, mark long")
    return store(found.groupBy("mark").agg(F.max("pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: tuple[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model: lexicons and classifier from a sample of labelled rows, see SAMPLE, the label model from all rows' votes."""
    y, parts, patterns = _sampled(docs, labels, label, sample, id_col, text_col)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:  # nothing to learn from: the fixed lexicons decide
        return Model(np.zeros(0, U), np.zeros(0, np.int64), np.full(len(PATTERNS), 4.0), -3.0, 0)
    known, lexicon = _lexicons(parts, y)
    model = Model(known, lexicon, np.zeros(0), 0.0, len(STEMS) * BANDS)
    seen = vote_patterns(docs, model, text_col)
    few = seen.limit(PATTERNS_HERE + 1).toArrow()
    if few.num_rows <= PATTERNS_HERE:
        order = np.argsort(few.column("pattern").to_numpy())
        given = _Here(_bits(few.column("pattern").to_numpy()[order], model.voters), few.column("n").to_numpy()[order].astype(float))
    else:
        given = _Apart(seen, model.voters)
    model.labels = fitted(given)
    hits = [np.searchsorted(known, p[_is_in(known, p.astype(U))]) for p in parts]
    doc, feature = np.repeat(np.arange(len(parts)), [len(h) for h in hits]), np.concatenate(hits).astype(np.int64)
    votes = model.votes(len(parts), doc, feature, patterns)
    members = model.labels.members(votes)
    model.toxic = model.labels.named(members, y)  # labels name the classes
    n = len(known)
    rows = [np.append(h, np.flatnonzero(v) + n) for h, v in zip(hits, votes, strict=True)]
    model.weight, bias = fit_logistic(rows, n + votes.shape[1], members @ model.toxic)
    # The classes of the labelled rows are sampled apart.
    shares = sampled_shares(labels, label, sample, id_col)
    model.bias = bias + float(np.log(shares[0] / shares[1]))
    return model


def scored(docs: DataFrame, model: Model, cut: float = 0.5, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1, higher for toxic) and predicted (score >= cut).

    Whole texts are scored; null and empty ones like a text without words. Nothing but the text counts. Other columns
    pass through; a column named as one that is added is replaced.
    """
    rows = docs.select(as_row(docs, names))
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([model.score(b) for b in blocks(batch.column(0).field(text_col), lower=True)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["row", *names])

    return rows.mapInArrow(lean(go), schema).select("row.*", *(F.col(f"`{n}`") for n in names))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from labels that are not held out.

    Null labels and ids without a document teach nothing. Without labels of both classes only fixed lexicons and
    patterns count. No documents give no rows.
    """
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return scored(rows, fit(docs, labels, label, sample)).select("doc_id", "held_out", "score", "predicted")
