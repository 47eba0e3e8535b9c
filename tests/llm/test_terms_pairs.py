import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.llm import pairs as pairs_module
from darkslide.llm.nullmodel import ConfigurationNull, log_tail
from darkslide.llm.pairs import surprising_pairs
from darkslide.llm.suffixes import intervals, suffix_array
from darkslide.llm.terms import count_terms, mark_terms, term_of
from darkslide.operators.packed import split_text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=8))
def test_intervals_equal_counting(records):
    tokens = np.array([t for r in records for t in r])
    owner = np.array([i for i, r in enumerate(records) for _ in r])
    ends = np.searchsorted(owner, owner, side="right")
    order, common = suffix_array(tokens, ends)
    texts = [tuple(tokens[i : ends[i]]) for i in order]
    assert texts == sorted(texts)
    for k in range(len(texts) - 1):
        n = 0
        while n < min(len(texts[k]), len(texts[k + 1])) and texts[k][n] == texts[k + 1][n]:
            n += 1
        assert common[k] == n
    found = {tuple(tokens[p : p + n]): (int(o), int(r)) for n, at, occ, rec in intervals(tokens, owner, 4) for p, o, r in zip(at, occ, rec)}
    occurrences, holders = Counter(), Counter()
    for r in records:
        grams = [tuple(r[i : i + n]) for n in range(1, 5) for i in range(len(r) - n + 1)]
        occurrences.update(grams)
        holders.update(set(grams))
    assert found == {g: (c, holders[g]) for g, c in occurrences.items()}


def test_terms(spark):
    assert term_of("  KÉk  7 x ") == term_of("kék 7 x") == "kék 7 x"
    rows = [(1, "a, A; b", "x"), (1, "a, A; b", "y"), (2, "a", "x"), (3, None, None), (4, " ; ", None), (None, "c", None), (5, "b,a,b,a", None)]
    df = spark.createDataFrame(rows, "id bigint, k string, gram string")
    found = {"|".join(r.gram): (r.occurrences, r.records) for r in count_terms(df, "id", ["k"], 2).collect()}
    assert found == {"": (8 + 0, 4), "a": (5, 3), "b": (3, 2), "c": (1, 1), "a|a": (1, 1), "a|b": (2, 2), "b|a": (2, 1)} | {"": found[""]}
    assert found[""][1] == 4
    marks = {r.gram[0]: r.mark for r in mark_terms(df, "id", ["k"]).collect()}
    assert marks == {"a": "common", "b": "rare", "c": "rare"}
    assert mark_terms(df.limit(0), "id", ["k"]).count() == 0


def records(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    out = []
    for i in range(n):
        base = rng.randrange(10) * 5
        own = rng.sample(words[base : base + 5], 3) + rng.sample(words, 2) + ["everywhere"] * (rng.random() < 0.6)
        out.append((i, ", ".join(own), rng.choice([None, "", "W1; extra"])))
    return out


def expected_pairs(rows):
    single, both, n = Counter(), Counter(), 0
    for _, a, b in {r[0]: r for r in rows}.values():
        terms = {term_of(x) for t in (a, b) if t for x in split_text(t)}
        n += bool(terms)
        single.update(terms)
        both.update(itertools.combinations(sorted(terms), 2))
    return {k: c for k, c in both.items() if c >= 10 and c * n >= 3 * single[k[0]] * single[k[1]]}


@pytest.mark.parametrize("small", [True, False])
def test_pairs(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(pairs_module, "small_enough", lambda n: False)
    rows = records(2)
    df = spark.createDataFrame([*rows, *rows[:50], (5_000, None, None)], "id bigint, k string, s string")
    found = {(r.term_a, r.term_b): r for r in surprising_pairs(df, "id", ["k", "s"]).collect()}
    expected = expected_pairs(rows)
    assert {k: r.together for k, r in found.items()} == expected and expected
    assert all(r.q_value <= 1 and r.log10_p <= 0 and r.expected < r.together for r in found.values())


def test_every_pair_and_q_over_all(spark):
    rows = records(2)
    df = spark.createDataFrame(rows, "id bigint, k string, s string")
    single, both = Counter(), Counter()
    for _, a, b in rows:
        terms = {term_of(x) for t in (a, b) if t for x in split_text(t)}
        single.update(terms)
        both.update(itertools.combinations(sorted(terms), 2))
    found = {(r.term_a, r.term_b): r for r in surprising_pairs(df, "id", ["k", "s"], 1, 0).collect()}
    assert {k: r.together for k, r in found.items()} == both
    tests, ranked = len(single) * (len(single) - 1) // 2, sorted(found.values(), key=lambda r: r.log10_p)
    least, q = 1.0, {}
    for rank in range(len(ranked), 0, -1):
        r = ranked[rank - 1]
        least = min(least, 10**r.log10_p * tests / rank)
        q[r.term_a, r.term_b] = least
    assert all(q[k] * 0.999 <= r.q_value <= q[k] * 1.01 for k, r in found.items())
    limited = {(r.term_a, r.term_b): r for r in surprising_pairs(df, "id", ["k", "s"]).collect()}
    assert limited == {k: r for k, r in found.items() if k in expected_pairs(rows)}


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, None, None)], "id bigint, k string, s string")
    assert surprising_pairs(df, "id", ["k", "s"]).count() == surprising_pairs(df.limit(0), "id", ["k", "s"]).count() == 0


def test_large_basket_in_chunks(monkeypatch):
    monkeypatch.setattr(pairs_module, "CHUNK", 100)
    codes, starts = np.arange(53), np.array([0, 50, 53])
    found = {(int(a), int(b)) for x, y in pairs_module._pairs_in_chunks(codes, starts) for a, b in zip(x, y)}
    assert found == {*itertools.combinations(range(50), 2), *itertools.combinations(range(50, 53), 2)}


def test_huge_basket_in_slices(spark, monkeypatch):
    monkeypatch.setattr(pairs_module, "SPLIT", 50)
    rows = [(1, ",".join(f"w{i}" for i in range(40)), None), (2, "w1,w2", "w3")]
    found = {(r.term_a, r.term_b): r.together for r in surprising_pairs(spark.createDataFrame(rows, "id bigint, k string, s string"), "id", ["k", "s"], 1, 0).collect()}
    assert len(found) == 780 and found["w1", "w2"] == found["w2", "w3"] == 2 and found["w1", "w4"] == 1


def test_null_at_any_frequency():
    sizes = {3: 40_000, 9: 5_000}
    degrees = {d: 1 for d in range(1, 6_000)}
    null = ConfigurationNull(sizes, degrees)
    at = np.array([1, 499, 501, 777, 5_999], float)
    assert np.allclose((null.size_counts[:, None] * null.probability(at)).sum(0), at, rtol=1e-6)


def test_null_meets_sizes_and_frequencies():
    sizes, degrees = {2: 300, 4: 200, 7: 50}, {5: 30, 20: 40, 40: 20}
    null = ConfigurationNull(sizes, degrees)
    p = null.probability(np.array(sorted(degrees), float))
    by_item = (np.array([sizes[k] for k in sorted(sizes)])[:, None] * p).sum(0)
    assert np.allclose(by_item, sorted(degrees), rtol=0.03)


def test_tail_against_exact():
    m, q = np.array([40.0, 25.0]), np.array([[0.05], [0.2]])
    exact = np.zeros(66)
    exact[0] = 1
    for count, chance in ((40, 0.05), (25, 0.2)):
        for _ in range(count):
            exact = exact * (1 - chance) + np.concatenate([[0], exact[:-1]]) * chance
    for t in (9, 12, 16, 25):
        found = log_tail(q, m, np.array([t]))[0]
        assert abs(found - math.log(exact[t:].sum())) < 0.02 * max(1, abs(math.log(exact[t:].sum())))


def test_tail_of_one_and_below_the_mean():
    m, q = np.array([30.0]), np.array([[0.2]])
    for t in range(1, 8):
        exact = sum(math.comb(30, i) * 0.2**i * 0.8 ** (30 - i) for i in range(t, 31))
        assert abs(math.exp(log_tail(q, m, np.array([t]))[0]) - exact) < 0.005
    assert abs(log_tail(np.array([[1e-5]]), m, np.array([1]))[0] - math.log(3e-4)) < 1e-3
