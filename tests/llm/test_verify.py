"""Verified near-duplicates against brute force."""

import random

import pytest

import corpus_pipeline as cp
from recospark.llm import verify


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """Ids that aren't the least of their group by exact similarity."""
    group, own = {i: i for i, _ in rows}, {i: sets(t) for i, t in rows}
    for _ in rows:
        for a in own:
            for b in own:
                if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                    group[b] = group[a] = min(group[a], group[b])
    return {i for i, g in group.items() if i != g}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return words


def texts():
    rng = random.Random(8)
    out = []
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        out += [" ".join(edited(words, rng.choice([0, 0, 1, 2, 4, 6]), rng)) for _ in range(12)]
        shuffled = words[:]
        rng.shuffle(shuffled)
        out += [" ".join(shuffled), " ".join(words)]
    return list(enumerate(out))


@pytest.mark.parametrize("part_bytes", [verify.PART_BYTES, 4000])
def test_against_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(verify, "PART_BYTES", part_bytes)
    monkeypatch.setattr(verify, "LEAST_BYTES", 1)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    candidates = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, component_id long")
    got, want = {r.doc_id for r in verify.duplicates(docs, candidates).collect()}, brute(rows)
    # Dealt over parts, a group may stay split, but nothing else is dropped.
    assert got == want if part_bytes > 4000 else got <= want and len(got) >= 0.9 * len(want)


def test_same_words_in_other_order_stay(spark):
    """One word-level fingerprint, but no five-word shingle in common."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(4):
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(9, rows[0][1]), (8, " ".join(edited(rows[0][1].split(), 1, rng)))]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("part_bytes", [1000, 3000, 20_000])
def test_no_pair_of_a_large_group_is_missed(spark, monkeypatch, part_bytes):
    """Pairs just at the threshold, in one candidate group whose texts all share a passage, so also least hashes."""
    rng, rows = random.Random(5), []
    for i in range(150):
        words = [*(f"c{k}" for k in range(30)), *(f"a{i}x{k}" for k in range(19))]  # with word 40 changed 40 shingles of 50 are shared
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:40], f"b{rng.random()}", *words[41:]]))]
    monkeypatch.setattr(verify, "PART_BYTES", part_bytes)
    monkeypatch.setattr(verify, "LEAST_BYTES", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    candidates = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, component_id long")
    assert {r.doc_id for r in verify.duplicates(docs, candidates).collect()} == {2 * i + 1 for i in range(150)}
