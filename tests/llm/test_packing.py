import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.llm.grouping import cross, evolve, first, mutate
from darkslide.llm.packing import fill_containers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=1, max_size=60), st.integers(0, 99))
def test_every_child_is_a_packing(sizes, seed):
    sizes, rng = np.array(sizes), np.random.default_rng(seed)
    a, b = first(sizes, 100, rng, 0.0), first(sizes, 100, rng, 0.5)
    for p in (a, b, cross(a, b, sizes, 100, rng), mutate(a, sizes, 100, rng), evolve(sizes, 100, seed, [a.bin_of])):
        assert len(p.bin_of) == len(sizes) and (p.loads <= 100).all() and p.loads.sum() == sizes.sum()
        assert set(p.bin_of.tolist()) == set(range(len(p.loads)))


def test_better_than_best_fit_where_it_is_hard():
    rng = random.Random(4)
    sizes = []
    for _ in range(60):  # triplets that fill 1,000 exactly
        a, b = rng.randrange(380, 490), rng.randrange(251, 300)
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    plain = first(sizes, 1000, np.random.default_rng(0), 0.0)
    found = evolve(sizes, 1000, 1, [], population=10, generations=120)
    assert len(found.loads) < len(plain.loads)


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, 30, 99, 100, 101, 250, None])) for i in range(500)] + [(7, 30)] * 200 + [(None, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint")
    found = fill_containers(df, "doc_id", "size", capacity=100, block=150).collect()
    load, number = Counter(), Counter()
    for r in found:
        load[r.container] += r["size"]
        number[r.doc_id] += r["size"]
    assert max(load.values()) <= 100
    expected = Counter()
    for i, s in rows:
        expected[i] += s or 0
    assert number == expected
    assert len(found) == sum(max(1, -(-(s or 0) // 100)) for _, s in rows)
    assert all(r["size"] == 100 or r.piece == max(0, -(-(s or 0) // 100) - 1) for r in found if r.doc_id not in (7, None) for s in [rows[r.doc_id][1]])
    assert len(load) <= 1.05 * sum(s or 0 for _, s in rows) / 100 + 2
    assert fill_containers(df.limit(0), "doc_id", "size").count() == 0
