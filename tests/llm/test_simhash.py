"""SimHash groups against brute force over all pairs."""

import random
from math import comb

import numpy as np
import xxhash

from recospark.llm import simhash


def brute_fp(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return fp - (1 << 64) if fp >> 63 else fp


def brute_groups(fps, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 150))) for _ in range(60)]
    rows = list(base)
    for t in base:
        for _ in range(3):
            w = t.split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "Edited"
            rows.append(" ".join(w))
    rows += [None, "", "one", "one two", " x y\x1cz w v", "rep " * 20000]
    docs = spark.createDataFrame([(i * 3, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, u int, fp int").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fp(t, 4) for t in rows]
    assert [got[i * 3].fp for i in range(len(rows))] == fps
    assert [got[i * 3].component_id for i in range(len(rows))] == [3 * g for g in brute_groups(fps, 4)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_several_views(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [" ".join(rng.choices(words, k=rng.randint(5, 90))) for _ in range(40)]
    for t in rows[:40]:
        w = t.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=1, views=3, distinct=True).collect()}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for seed in (42, 43, 44):
        fps = [simhash.fingerprint(t.encode(), 1, seed, True) for t in rows]
        for i, g in enumerate(brute_groups(fps, 4)):
            a, b = find(i), find(g)
            parent[max(a, b)] = min(a, b)
    assert [got[i] for i in range(len(rows))] == [find(i) for i in range(len(rows))]


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    kept = simhash.CROWDED
    try:
        for crowded in (kept, 6):
            simhash.CROWDED = crowded
            links = simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
            at = {x: i for i, x in enumerate(fps)}
            parent = list(range(len(fps)))

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for u, v in links:
                a, b = find(at[u]), find(at[v])
                parent[max(a, b)] = min(a, b)
            assert [find(i) for i in range(len(fps))] == brute_groups(fps, 4)
    finally:
        simhash.CROWDED = kept


def test_masks():
    """A table for each choice of blocks that pairs within the distance must share; a crowded bucket is dealt anew alike."""
    tables = comb(simhash.BLOCKS, 4)
    assert len(simhash.masks(0, 4)) == tables
    for m in simhash.masks(0, 4):
        assert len(simhash.masks(m, 4)) == tables
    # Two blocks of 10 or 11 bits each.
    assert np.all([(m & 2**64 - 1).bit_count() in (20, 21, 22) for m in simhash.masks(0, 4)])
