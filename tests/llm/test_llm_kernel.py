"""Word hashes: regular long words whose polynomial hashes agree have to stay apart, in the kernel and behind it."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rentlens.llm import licenses, ngram_jaccard, substring_dedup, subword_quality, toxicity
from rentlens.llm.textkernel import LONG, blocks

SIZES = [64, 256, 1024, 2048, 4096]


def regular(n: int, turned: bool = False) -> str:
    """The Thue-Morse word of n letters, or its complement."""
    return "".join("ab"[(i.bit_count() + turned) % 2] for i in range(n))


def _block(*words: str):
    (b,) = blocks(pa.array([" ".join(words)]))
    return b


@pytest.mark.parametrize("n", SIZES)
def test_regular_words_stay_apart(n):
    b = _block(regular(n), regular(n, True), regular(n))
    for h in (b.hashes, b.second, b.span_hash(b.start, b.end)):
        assert h[0] == h[2] != h[1]
    for features in (toxicity.features(b)[1], licenses._ngrams(b)[1], subword_quality._word_features(b)[2]):
        assert len(set(features[:2].tolist())) == 2


@pytest.mark.parametrize("n", SIZES)
def test_joins_tell_regular_words_apart(spark, n):
    near = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([*near, regular(n, bool(i)), *(f"v{j}" for j in range(20))])) for i in (0, 1)]
    rows += [(2, f"x {regular(n)} y {regular(n, True)} z"), (3, f"x {regular(n, True)} y {regular(n)} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(df)).collect())) == sorted(substring_dedup.brute_force(rows))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.similar_groups(df).collect())
    assert got == sorted(ngram_jaccard.brute_force(rows)) and not any(r[3] for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ0", min_size=1, max_size=30), min_size=1, max_size=60))
def test_hashes_agree_with_bytes(words):
    words += [words[0] * 40, words[0] * 40 + "a", "a" * LONG, "a" * (LONG + 1), "A" * (LONG + 1)]
    for lower in (False, True):
        (b,) = blocks(pa.array([" ".join(words)]), lower=lower)
        plain = [w.lower() if lower else w for w in words]
        for h in (b.hashes, b.second, b.span_hash(b.start, b.end)):
            assert len(set(h.tolist())) == len(set(plain))
            assert all((h[i] == h[0]) == (plain[i] == plain[0]) for i in range(len(plain)))


def test_no_two_of_many_words_agree():
    words = [f"{i:x}" for i in range(200_000)] + [hashlib.md5(str(i).encode()).hexdigest() for i in range(100_000)]
    b = _block(*words)
    assert len(np.unique(b.hashes)) == len(np.unique(b.second)) == len(words)


def test_stored_tables_are_cleared(spark, tmp_path, monkeypatch):
    from rentlens.llm import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(scratch, "_written", [])
    assert scratch.store(spark.range(3)).count() == 3
    assert scratch.clear(spark) == 1 and not list(tmp_path.iterdir())
