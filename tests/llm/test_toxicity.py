"""Toxicity: held-out accuracy, and the defined results of odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from recospark.llm import toxicity

BAD = ["stupid", "worthless", "trash"]


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        own = ["".join(rng.choices("aeioustrnl", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        if toxic := int(rng.random() < 0.3):
            own.insert(rng.randrange(len(own)), rng.choice(BAD))
        rows.append((i, " ".join(own), "s"))
        labels.append((i, toxic, None))
    docs = spark.createDataFrame([*rows, (None, "stupid", None), (999, None, None), (998, "", None), (998, "", None), (997, "x" * 300000 + " worthless trash", None)], "doc_id long, text string, score string")
    table = spark.createDataFrame([*labels, (None, 1, None), (5, None, None), (6, 7, None), (123456, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(toxicity.drawn(docs, table, F.col("doc_id") % 4 != 0))
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model, ["doc_id"]).collect()]
    assert len(got) == docs.count() and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    held = [(i, y) for i, y, _ in labels if i % 4 == 0]
    assert sum((by[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert by[997] > 0.5 and by[998] == by[999] < 0.5


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "def")], "doc_id long, text string")
    table = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.drawn(docs, table, F.lit(True)))
    assert abs(toxicity.score(docs, model, ["doc_id"]).first().score - 0.5 / 3) < 1e-9
    model = toxicity.fit(toxicity.drawn(docs, table.limit(0), F.lit(True)))
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def plain_bucket(gram):
    """An n-gram's bucket, one character after the other."""
    m = [int(v) for v in toxicity._MIX]
    h = ord(gram[0]) * m[0] % 2**64
    for c in gram[1:]:
        h = ((h ^ h >> 29) * m[1] + ord(c) * m[2]) % 2**64
    return ((h ^ h >> 31) * m[0] % 2**64) >> (64 - toxicity.BITS)


def plain_buckets(text):
    framed = f" {(text or '').lower()} "
    return {plain_bucket(framed[a : a + n]) for n in toxicity.N_GRAMS for a in range(len(framed) - n + 1)}


def test_against_brute_force(spark, monkeypatch):
    """Counts, ratios, chosen features and scores against plain Python, with repeated rows and texts longer than a stretch."""
    monkeypatch.setattr(toxicity, "STRETCH", 37)
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcdÉ", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    labels = [(i, i % 3 == 0 and 1 or 0) for i in range(50)]
    docs = spark.createDataFrame([*rows, (3, "zzzz another text of one id"), (3, rows[3][1]), (4, rows[4][1]), (77, None)], "doc_id long, text string").repartition(3)
    model = toxicity.fit(toxicity.drawn(docs, spark.createDataFrame([*labels, (4, 0)], "doc_id long, toxic int"), F.lit(True)))
    counts, seen = {0: {}, 1: {}}, [0, 0]
    for i, y in labels:
        seen[y] += 1
        for g in plain_buckets(min([rows[i][1]] + ["zzzz another text of one id"] * (i == 3))):
            counts[y][g] = counts[y].get(g, 0) + 1
    ratio = {g: np.log(((counts[1].get(g, 0) + 1) / (seen[1] + 2)) / ((counts[0].get(g, 0) + 1) / (seen[0] + 2))) for g in {*counts[0], *counts[1]}}
    gain = {g: abs((counts[1].get(g, 0) + 1) / (seen[1] + 2) - (counts[0].get(g, 0) + 1) / (seen[0] + 2)) * abs(r) for g, r in ratio.items()}
    chosen = set(np.flatnonzero(model.feature >= 0).tolist())
    assert len(chosen) == toxicity.FEATURES
    assert min(gain.get(g, 0) for g in chosen) >= max(v for g, v in gain.items() if g not in chosen) - 1e-12
    for r in toxicity.score(docs, model, ["doc_id", "text"]).collect():
        logit = model.bias + sum(model.weight[model.feature[g]] for g in plain_buckets(r.text) & chosen)
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9


def test_long_text():
    rng = random.Random(9)
    text = "".join(rng.choices("abcde ", k=toxicity.STRETCH + 5000))
    got = toxicity.buckets(text)
    assert set(got.tolist()) >= plain_buckets(text[-6000:])
    assert plain_bucket(text[toxicity.STRETCH - 4 : toxicity.STRETCH + 4]) in set(got.tolist())
