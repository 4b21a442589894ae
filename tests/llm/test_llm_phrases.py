"""Collocations against brute force, SQL and edge rows; the automaton against plain counting."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rentlens.llm import phrases, queries

SF1 = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), max_size=8), st.integers(1, 5))
def test_automaton(pieces, most):
    word = np.array([w for p in pieces for w in p], np.int64)
    before = np.array([i for p in pieces for i in range(len(p))], np.int64)
    made = phrases.Automaton(word, before, most)
    want = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, most + 1) for i in range(len(p) - k + 1))
    spelled = lambda e, k: tuple(word[e - k + 1 : e + 1].tolist())
    end, words, count = made.phrases()
    got = [(spelled(e, k), c) for e, k, c in zip(end.tolist(), words.tolist(), count.tolist())]
    assert len(got) == len(want) and dict(got) == want
    # A state's phrases, and no others, share their end positions.
    ends = {}
    at = 0
    for p in pieces:
        for i in range(len(p)):
            for k in range(1, min(most, i + 1) + 1):
                ends.setdefault(tuple(p[i - k + 1 : i + 1]), set()).add(at + i)
        at += len(p)
    states = [frozenset(ends[spelled(e, k)]) for e, k in zip(made.end.tolist(), made.words.tolist())]
    assert len(set(states)) == len(states) == len({frozenset(x) for x in ends.values()})


def test_automaton_of_many_words_and_depths():
    rng = np.random.default_rng(1)
    word = rng.integers(1, 1 << 40, 300)
    word[150:] = word[:150]
    made = phrases.Automaton(word, np.arange(300) % 50, 4)  # 160 bits: beyond one number
    assert made.phrases()[2].sum() == sum(300 - 6 * k for k in range(4))


def _texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abAcé", k=rng.randint(1, 2)))
    return [(rng.choice(["en", "de", None, "und", "a b"]), rng.choice(["", " ", ".", "x\ty  ", "\n"]).join([word() + rng.choice([" ", " ", "  ", ", ", "\t", ".", "\x0b"]) for _ in range(rng.randint(0, 60))])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "shard"), [(1, 8 << 20), (2, 2000), (3, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(phrases, "MERGE_ROWS", 50)
    rows = _texts(seed, 400) + [("en", None), (None, ""), ("de", "solo " * 3000), ("en", "x" * 5000 + " y z")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "lang string, text string, f int, phrase string").repartition(6)
    got = sorted(map(tuple, phrases.collocations(df, top=300).collect()))
    assert got == sorted(phrases.brute_force(rows, top=300))
    deep = sorted(map(tuple, phrases.collocations(df, most=5, least=4, subsumed=70, top=50).collect()))
    assert deep == sorted(phrases.brute_force(rows, 5, 4, 70, 50)) and deep


def test_exact_beyond_64_bits(spark):
    counted = spark.createDataFrame([("x", "", 9 * 10**15), ("x", "a", 3 * 10**15 + 1), ("x", "b", 3 * 10**15 + 7), ("x", "a b", 3 * 10**15)], "lang string, phrase string, f long")
    got = phrases.candidates(counted).first()
    a, l, r = 3 * 10**15, 3 * 10**15 + 1, 3 * 10**15 + 7
    assert (got.a, got.l, got.r, got.score) == (a, l, r, 10**6 * a * a // (l * r))


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF1}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_phrase_collocation"]).fetchall()
    got = sorted(map(tuple, queries.op11_phrase_collocation(spark, SF1).collect()))
    assert got == sorted(want) and len(got) > 100
