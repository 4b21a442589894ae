"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.llm import chat_format, fingerprints, licenses, metric_join, mixing, ngram_jaccard, packing, substring_dedup, subword_quality, toxicity
from rentlens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class string, n_words int, shard string, component_id string, bucket string"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
ROWS = [
    (1, "a b c d e f g h", "en", "s1"),
    (1, "a b c d e f g h", "en", "s1"),  # repeated row
    (2, "A B  c\td\ne f g h", None, None),  # the same words
    (2, "another text under one id", "en", "s2"),
    (3, None, "en", "s2"),
    (4, "", "en", "s1"),
    (5, " \n\t ", "en", "s1"),
    (6, LONG, "en", "s3"),
    (7, LONG + " tail", "en", "s3"),
    (None, "a row without an id", "en", None),
    (8, "one", None, "s2"),
    (9, "é ü ñ ß 漢字   nbsp <|endoftext|>", "de", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 0.5, "x", 1, "y", "z", "b") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (99, 1, 1), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


def test_substring_dedup(docs, empty):
    texts = [(-1 if r[0] is None else r[0], r[1]) for r in ROWS]
    got = substring_dedup.dedup(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_words"), "n_words", "n_removed", "kept_text"]
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect())
    assert rows == sorted(substring_dedup.brute_force(texts))
    assert any(r[2] for r in rows)
    assert substring_dedup.dedup(empty).count() == 0


def test_ngram_jaccard(docs, empty):
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.similar_groups(docs).collect() if r.doc_id is not None)
    known = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    assert got == sorted(ngram_jaccard.brute_force(known))
    assert ngram_jaccard.similar_groups(empty).count() == 0
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(1, ROWS[0][1]), (2, ROWS[3][1]), (3, ""), (4, ""), (5, ROWS[6][1]), (6, LONG), (-1, ROWS[9][1]), (8, "one"), (9, ROWS[11][1])])


def test_fingerprints(docs, empty):
    got = fingerprints.edited_pairs(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for r, following in zip(order, order[1:] + order[:1]):
        t, f = r[1] or "", following[1] or ""
        h = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - h] + f[:h]).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[3] == prints[4] != prints[5]
    assert fingerprints.edited_pairs(empty).count() == 0
    assert fingerprints.edited_pairs(docs.where("doc_id = 8")).first().n_chars == 3


def test_mixing(docs, empty):
    got = mixing.taken(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 3 * r.size and r.size == len((t or "").encode().split()) for r, t in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.size)), [x[1] for x in sorted(ROWS, key=lambda x: (x[0] or -1, len((x[1] or "").encode().split())))]))
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == [*(c for c in docs.columns if c != "shard"), "shard"]


@pytest.mark.parametrize("long", [False, True])
def test_fingerprints_match_brute_force(spark, long):
    rows = [(i * 100 + (i > 5), t) for i, t in enumerate(["a b c\nd e", "d e\na b c", "", None, " \t\n\n x", "é 漢字 \u2028 ß", "a b c d\r\ne f g", "one", "one two three four five six", "a  b"])]
    rows += [(None, "null id"), (None, "another null id"), (None, None), (None, "third"), (700, "the same id"), (700, "a text of the same id")]
    rows += [(5000 + i, " ".join(f"w{j % (i + 2)}" for j in range(60_000 if long else 30))) for i in range(3)]
    got = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(map(tuple, got), key=key), sorted(fingerprints.brute_force(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(x - y) < 1e-12 for g, w in zip(got, want) for x, y in zip(g[5:], w[5:]))


def test_packing(docs, empty):
    got = packing.pack(packing.pieces(docs)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    _packed_right(got)
    assert packing.pack(packing.pieces(empty)).count() == 0


def _packed_right(rows, length=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length


def test_classifiers(docs, empty, labels):
    for f in (toxicity.toxicity, subword_quality.quality):
        got = f(docs, labels).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in got if r.doc_id == 3} == {r.score for r in got if r.doc_id == 4}
        assert f(docs, labels.limit(0)).count() == len(ROWS)
        assert f(empty, labels).count() == 0
    scored = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"]


def test_licenses(docs, empty):
    model = licenses.train(["some words of a text", "the rest of it"])
    assert licenses.license_paragraphs(docs, model).count() == 0
    assert licenses.scan(empty).count() == 0


def test_licence_lines_beside_edge_rows(spark, docs):
    """A licence line in a repeated row, without an id, within a very long text, and beside nulls and empty texts."""
    notice = "Released under the MIT License."
    long = f"{LONG}\n{notice}\n{LONG}"
    more = [(20, notice), (20, notice), (None, f"x\n{notice}"), (21, long), (22, None), (23, ""), (24, f"{notice} {'tail ' * 9000}")]
    rows = spark.createDataFrame(more, "doc_id long, text string").withColumn("family", F.lit("clash"))
    both = rows.unionByName(docs.select("doc_id", "text", F.lit("clash").alias("family")))
    model = licenses.fit(both)
    got = sorted((r.doc_id or -1, r.paragraph, r.family) for r in licenses.license_paragraphs(both, model).collect())
    assert [g for g in got if g[0] != 24] == [(-1, 1, "MIT"), (20, 0, "MIT"), (20, 0, "MIT"), (21, 1, "MIT")]


def test_licence_sample_is_bounded(spark):
    import rentlens.llm.licenses as m

    seen = []
    rows = spark.createDataFrame([(i, "one text of many copies" if i % 2 else f"text {i} that speaks of a license to dream") for i in range(4000)], "doc_id long, text string")
    held, m.train = m.train, lambda corpus, seed=5: seen.extend(corpus)
    try:
        m.fit(rows, sample=200)
    finally:
        m.train = held
    assert 20 < len(seen) <= 400 and len(set(seen)) == len(seen) and any("license" in x for x in seen)


CLASHES = ["target", "copies", "ranks", "place", "key", "y", "__n", "__key", "row", "spans", "bucket", "number", "n", "Doc.x", "id", "hash", "a`b", "order_key", "edge", "mark", "shards", "blob"]


def test_columns_that_clash(spark, labels):
    """Operators and stages pass on columns whatever their names, as they are."""
    import corpus_pipeline as cp

    shared = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{shared} own {i}" if i < 4 else f"text {i} of some words", "en", f"s{i % 2}", 10, *(100 * k + i for k in range(len(CLASHES)))) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASHES])
    held = lambda out: {(r["doc_id"], *(r[c] for c in CLASHES)) for r in out.collect()}
    full = held(df)
    assert held(substring_dedup.dedup(df)) == full
    assert held(toxicity.scored(df, toxicity.fit(df, labels))) == full
    assert held(subword_quality.scored(df, subword_quality.fit(df, labels))) == full
    assert mixing.taken(df).count() == fingerprints.edited_pairs(df).count() == 12 and licenses.scan(df, licenses.train(["some words"])).count() == 0
    cut = packing.pieces(df).join(df.drop("text", "lang", "source", "n_chars"), "doc_id")
    assert held(packing.pack(cut)) == full
    docs = df
    for stage in (cp.one_of_similar, cp.drop_repeats, cp.mix_sources):
        docs = cp.store(stage(spark, docs, ""))
        assert docs.columns == df.columns and 0 < docs.count() and held(docs) <= full


def test_stages_and_run_on_edge_rows(spark, tmp_path, docs, labels):
    """Nulls, empty and very long texts, ties, repeated rows and an empty table, through every stage."""
    import corpus_pipeline as cp

    wide = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, rows in (("edge", wide), ("empty", wide.limit(0))):
        folder = f"file://{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        counts = [now.count()]
        for _, stage in cp.STAGES:
            now = cp.store(stage(spark, now, folder))
            counts.append(now.count())
        assert cp.run(spark, folder).count() == counts[-1]
        if name == "empty":
            assert counts == [0] * 6
        else:
            assert now.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0 and counts[5] >= counts[4] > 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, text2 string, place string, key string"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, None, None), (None, 0, "user", "no id"), (5, None, "user", "x" * 100_000), (6, 0, "user", "tie b"), (6, 0, "user", "tie a")]
    got = chat_format.render(spark.createDataFrame([(*t, "a", "b", "c") for t in turns], schema)).collect()
    assert sorted((r.conv_id or -1, r.n_turns, r.n_copies) for r in got) == [(-1, 1, 1), (1, 2, 2), (4, 1, 1), (5, 1, 1), (6, 2, 1)]
    assert next(r.text for r in got if r.conv_id == 6) == "<|user|>\ntie a\n<|end|>\n<|user|>\ntie b\n<|end|>\n"
    assert chat_format.render(spark.createDataFrame([], schema)).count() == 0


def test_embeddings_of_many_lengths_and_parallel_pivots(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CHUNK", 8)
    monkeypatch.setattr(metric_join, "PROBES", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=2 + i % 5) * (1 if i % 3 else 1000)).tolist()) for i in range(150)]
    rows += [(200 + i, [float(i + 1), 2.0 * (i + 1), -1.0 * (i + 1)]) for i in range(60)]  # parallel, of one place
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, metric_join.near_duplicates(df).collect())) == sorted(metric_join.brute_force(rows))


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, class int")
    assert sorted(map(tuple, metric_join.near_duplicates(df).collect())) == sorted(metric_join.brute_force(rows))
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [0, 1 << 18])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr("rentlens.llm.components.AT_ONCE", at_once)
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_keeps_the_odds_of_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit_logistic", lambda rows, n, q: (np.zeros(n), 0.0))
    rows = [(i, f"text {i} of words", int(i % 10 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    assert toxicity.fit(docs, labels).bias == 0
    clean = labels.where(~toxicity.held_out("doc_id") & F.expr("toxic = 0")).count()
    assert abs(toxicity.fit(docs, labels, sample=(100, 3000)).bias - np.log(100 / clean)) < 1e-4


def test_texts_of_one_id_whose_short_hashes_collide(spark):
    passage = " ".join(f"p{i}" for i in range(36))
    made = spark.range(400_000).select(F.expr(f"if(id % 2 = 0, concat('{passage} t', id), concat('t', id, ' {passage}'))").alias("text"))
    alike = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").collect()
    a, b = next((x, y) for r in alike for x in r.texts for y in r.texts if x.startswith("t") and y.startswith("p"))
    rows = [(None, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in substring_dedup.digest(substring_dedup.dedup(df)).collect())
    assert got == sorted(r[1:] for r in substring_dedup.brute_force(rows))
    assert {r.text for r in ngram_jaccard.keep_one(df, share=100).collect()} == {a, b}


def test_likeness_of_a_pair_repeated_often(spark):
    df = spark.createDataFrame([(2, "a b " * 40_000), (1, "a b " * 20_000)], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in fingerprints.edited_pairs(df).collect()}
    assert abs(near[2] - 0.8) < 0.01 and abs(near[1] - 0.8) < 0.01
