"""Exact top-k search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recospark.llm import topk


def brute(rows, k, scale):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            best.setdefault(i, []).append([math.floor(scale * x) for x in v])
    out = {}
    for q in (i for i in best if i % 5 == 0):
        scores = [(-max(min(sum(a * b for a, b in zip(min(best[q]), v)), 2**63 - 1), -(2**63)), i) for i, own in best.items() for v in own if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse", "large", "ties"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "QUERY_GROUP", 6)
    monkeypatch.setattr(topk, "CANDIDATE_GROUP", 30)
    rng = random.Random(kind)
    value = {"dense": lambda: rng.gauss(0, 1), "sparse": lambda: rng.choice([0.0] * 9 + [1.5]), "large": lambda: rng.gauss(0, 1e9), "ties": lambda: float(rng.randint(0, 1))}[kind]
    rows = [(i, [value() for _ in range(rng.choice([8, 8, 5, 0]))]) for i in range(70)]
    rows += [(70, None), (75, [1.0, None]), (80, [float("nan")]), (85, [float("inf"), 1.0]), (None, [1.0] * 8), (5, [value() for _ in range(8)]), (71, [-2.0] * 8)]
    frame = spark.createDataFrame([(*r, 0, "s") for r in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(3)
    got = {}
    for r in topk.search(frame, "vec_id", "embedding", 6, F.col("vec_id") % 5 == 0, scale=64.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, 6, 64.0)


def test_empty_and_fewer_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame, "vec_id", "embedding", 20, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2)]
    assert topk.search(frame.limit(0), "vec_id", "embedding", 20, F.col("vec_id") == 0).count() == 0


def test_invalid_copies_of_a_query(spark):
    bad = [None, [None, 1.0], [-math.inf, 1.0], [float("nan"), 1.0], [0.0, None]]
    rows = [(20 * i, v) for i, b in enumerate(bad) for v in (b, [1.0, 2.0])] + [(1, [1.0, 1.0]), (2, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in topk.search(frame, "vec_id", "embedding", 3, F.col("vec_id") % 20 == 0, scale=64.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, 3, 64.0)
    assert set(got) == {0, 20, 40, 60, 80}
