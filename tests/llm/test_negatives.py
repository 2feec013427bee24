"""Hard negatives against brute force, with ties, repeats, gaps and hot vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives

ROWS = "id long, label long, vector array<long>"


def brute(rows, anchors, k=5, n=3):
    one = {}
    for i, label, v in rows:
        if None not in (i, label, v):
            one[i] = min(one.get(i, (str(label), v)), (str(label), v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in filter(anchors, one):
        label, v = one[a]
        order = sorted((-dot(v, w), i, other) for i, (other, w) in one.items() if i != a)
        for s, p, _ in [x for x in order if x[2] == label][:k]:
            fit = [(-t, i) for t, i, other in order if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fit[:n])]
    return sorted(out)


def made(seed, n=400, width=6):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [rng.randrange(-3, 4) for _ in range(width)]) for i in range(n)]
    rows += [(1000 + i, 1, [3, 2, 1, 0, 1, 2]) for i in range(150)]  # a hot vector
    rows += [(2000 + i, 2, [3, 2, 1, 0, 1, 1]) for i in range(40)]
    rows += [rows[7], rows[10], (10, 3, [1] * width), (20, 0, [2, 2]), (30, 0, [2] * (width + 3)), (40, 1, []), (50, 1, [0] * width)]
    rows += [(None, 1, [1] * width), (5001, None, [1] * width), (5002, 1, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [8, 10_000])
def test_equals_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    rows = made(seed)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, most=most)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_walk_ends_early_and_changes_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 40
    vectors = np.floor(centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 16)) * 4)
    ids, labels = np.arange(6000), np.zeros(6000, np.int64)
    anchors = hard_negatives.Anchors(ids[::20], ["0"] * 300, vectors[::20], members=10)
    best = hard_negatives.Best(300, 5)
    steps = hard_negatives.walk(anchors, ids, labels, vectors, lambda rows: best.scores[rows, -1], lambda rows, s, part: best.add(rows, s, part))
    assert steps < 0.6 * 300 * 6000
    exact = anchors.vectors @ vectors.T
    for row in range(300):
        want = sorted(zip((-exact[row]).tolist(), range(6000)))[:5]
        assert [(-s, i) for s, i in zip(best.scores[row].tolist(), best.ids[row].tolist())] == want


def test_numbers_and_empty_tables(spark):
    vectors = [([0.1, -0.1], [25, -26]), ([float("nan"), 0.0], None), ([float("inf")], None), ([None, 1.0], None), (None, None), ([], [])]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(vectors)], "id long, embedding array<float>")
    got = {r["id"]: r["v"] for r in df.select("id", hard_negatives.whole_numbers(F.col("embedding")).alias("v")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(vectors)}
    none = hard_negatives.hard_negatives(spark.createDataFrame([], ROWS), F.col("id") % 10 == 0)
    assert none.count() == 0 and none.columns[0] == "anchor_id"
    extra = spark.createDataFrame(made(1, 50), ROWS).withColumns({c: F.lit("x") for c in ("anchor", "score", "rank", "slot", "count")})
    assert hard_negatives.hard_negatives(extra, F.col("id") % 10 == 0).count() == len(brute(made(1, 50), lambda i: i % 10 == 0))
