"""Common runs and n-grams below the share that is hot: their buckets are dealt anew, and results stay whole."""

import random

import numpy as np
import zstandard

from rentlens.llm import ngram_jaccard, substring_dedup
from rentlens.llm.textkernel import row_key, unpacked


def _texts(n, seed=1):
    """Half of the texts hold one run of words, each among words of its own; some repeat passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    common, passage = [f"c{i}" for i in range(7)], [word() for _ in range(45)]
    out = []
    for i in range(n):
        w = [word() for _ in range(90)]
        if i % 2:
            w[40:40] = common
        if i % 9 == 0:
            w[70:70] = passage
        out.append((i, " ".join(w)))
    return out + [(n + i, out[i][1] if i % 2 else out[i][1] + " x y z") for i in range(30)]


def test_results_are_whole_where_all_buckets_are_heavy(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 0)
    monkeypatch.setattr(ngram_jaccard, "HEAVY", 0)
    rows = _texts(250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(df)).collect())) == sorted(substring_dedup.brute_force(rows))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.similar_groups(df).collect())
    assert got == sorted(ngram_jaccard.brute_force(rows)) and any(r[3] for r in got)


def _even(loads):
    return max(loads.values()) / (sum(loads.values()) / 64)


def test_a_run_of_half_the_texts_does_not_fill_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1)  # nothing is hot by share
    df = spark.createDataFrame(_texts(1500), "doc_id long, text string").repartition(4)
    df = df.select(*row_key("doc_id", "text"), "text")
    even = {}
    for heavy in (10**9, 4):
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
        loads = {}
        for r in substring_dedup.shipped(df, 35, 6, 64).where("not spans").collect():
            sizes = unpacked(zstandard.ZstdDecompressor().decompress(r.blob), "u1", "<i4", "<i4", "?", "<i8", "<i8", "<i4")
            loads[r.bucket] = loads.get(r.bucket, 0) + int(sizes[1].sum())
        even[heavy] = _even(loads)
    assert even[10**9] > 5 and even[4] < 3, even


def test_an_ngram_of_half_the_texts_does_not_fill_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT_SHARE", 1)
    rng = random.Random(2)
    texts = [(i, " ".join(["a", "b", "c", "d", "e", *(f"w{rng.randrange(10**6)}" for _ in range(3))][: 8 if i % 2 else 5 + i % 3])) for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    even = {}
    for heavy in (10**9, 4):
        monkeypatch.setattr(ngram_jaccard, "HEAVY", heavy)
        _, common = ngram_jaccard.shingle_classes(df, dealt=64)
        assert not len(common.hot)
        loads = {}
        for r in ngram_jaccard.shipped(df, 5, "text", common, 64).collect():
            loads[r.bucket] = loads.get(r.bucket, 0) + len(unpacked(r.blob, "<u8", "<i4", "<i4", "<u8")[3])
        even[heavy] = _even(loads)
    assert even[10**9] > 8 and even[4] < 2
    assert np.isin([int(x) for x in common.heavy], range(64)).all()
