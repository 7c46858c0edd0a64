"""Similarity, sampling, readers and sinks against small plain-Python versions."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from recospark import schemas
from recospark.config import ItemSimilarityConfig, ProfileConfig, UserSimilarityConfig, overlaid
from recospark.operators import sampling, similarity, sinks
from recospark.sources import files

RATINGS = "userId long, movieId long, rating double, timestamp long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(rng.randint(1, 25), rng.randint(1, 15), rng.choice([2.0, 3.5, 4.0, 4.5, 5.0]), rng.randint(0, 500)) for _ in range(500)]
    return out + out[:10]


def rank(item, user):
    x = (item * 1000003) ^ (user * 9176)
    x ^= x >> 16
    x *= 0x7FEB352D
    x ^= x >> 15
    x *= 0x846CA68B
    return (x ^ (x >> 16)) & 0xFFFFFFFF


def test_stable_rank(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    pairs = [(rng.randint(1, 10**9), rng.randint(1, 10**9)) for _ in range(300)] + [(1, 1), (0, 0)]
    got = spark.createDataFrame(pairs, "i long, u long").select("i", "u", sampling.stable_rank(F.col("i"), F.col("u")).alias("r")).collect()
    assert all(r.r == rank(r.i, r.u) for r in got)


def test_item_similarity(spark, rows):
    config = ItemSimilarityConfig(use_rating_weight=True, min_rating=3.5, max_user_items=6, top_k=4)
    positive = [(u, i, r - 3.0, t) for u, i, r, t in rows if r >= 3.5]
    n, norm, best = Counter(), defaultdict(float), defaultdict(dict)
    for u, i, w, t in positive:
        n[i] += 1
        norm[i] += w * w
    for u, i, w, t in positive:
        if n[i] >= 5:
            best[u][i] = max(best[u].get(i, (0, 0)), (w, t))
    weight, together = defaultdict(float), Counter()
    for own in best.values():
        kept = sorted(sorted(own.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:6])
        for (a, (x, _)), (b, (y, _)) in combinations(kept, 2):
            weight[a, b] += x * y
            together[a, b] += 1
    want = defaultdict(list)
    for (a, b), c in together.items():
        if c >= 3:
            s = round(weight[a, b] / math.sqrt(norm[a] * norm[b]), 8)
            want[a].append((-s, -c, b))
            want[b].append((-s, -c, a))
    got = defaultdict(list)
    for r in similarity.item_similarity(spark.createDataFrame(rows, RATINGS), config).orderBy("src", "position").collect():
        got[r.src].append((-r.score, -r.cooccurrence, r.dst))
    assert got == {k: sorted(v)[:4] for k, v in want.items()}


def test_stratified_sample(spark, rows):
    config = UserSimilarityConfig(use_rating_weight=True, min_rating=3.5, max_item_users=7)
    from recospark.operators.ratings import positives

    valid = positives(spark.createDataFrame(rows, RATINGS), config)
    got = defaultdict(set)
    for r in sampling.participants(valid, valid, config)[0].collect():
        got[r.movieId].add(r.userId)
    best = defaultdict(dict)
    for u, i, r, t in rows:
        if r >= 3.5:
            best[i][u] = max(best[i].get(u, (0, 0)), (r - 3, t))
    for i, own in best.items():
        buckets = defaultdict(list)
        for u, (w, t) in own.items():
            buckets[w].append((rank(i, u), -t, u))
        order, k = [], 0
        while len(order) < len(own):
            order += [sorted(buckets[w])[k][2] for w in sorted(buckets, reverse=True) if k < len(buckets[w])]
            k += 1
        assert got[i] == set(order[:7])


def test_user_similarity_coverage_adds_links(spark, rows):
    frame = spark.createDataFrame(rows, RATINGS)
    base = UserSimilarityConfig(max_item_users=4)
    few, more = (similarity.user_similarity(frame, c).count() for c in (base, overlaid(base, coverage_anchor_items_per_user=2, coverage_pair_sample_size=8)))
    assert more > few
    assert similarity.user_similarity(frame.limit(0), base).count() == 0


def test_configs():
    for bad in ({"negative_max_rating": 3.5}, {"recency_floor": 2.0}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            overlaid(ProfileConfig(), **bad)


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp,more\n1,2,3.5,4,x\n 5 ,6,1,7,y\n")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/r.csv", "ratings").collect()] == [(1, 2, 3.5, 4), (5, 6, 1.0, 7)]
    (tmp_path / "bad.csv").write_text("userId,rating\n1,2\n")
    with pytest.raises(ValueError, match="movieId, timestamp"):
        files.read_csv(spark, f"{tmp_path}/bad.csv", "ratings")
    assert files.read_csv(spark, f"{tmp_path}/none.csv", "tags", optional=True).count() == 0
    (tmp_path / "s.jsonl").write_text('{"item_id":"7","neighbors":[{"item_id":8,"score":"0.5"}]}\n\n{"item_id":7,"neighbors":[{"item_id":9,"score":0.25,"x":1}]}\n')
    assert [tuple(r) for r in files.read_similarity(spark, f"{tmp_path}/s.jsonl", "item_id").collect()] == [(7, 9, 0.25, 0, 1)]
    (tmp_path / "a.json").write_text(' [{"item_id": 1, "title": "old"}, {"item_id": 1, "title": "new"}]')
    assert [r.title for r in files.read_store(spark, f"{tmp_path}/a.json", schemas.ITEM_INDEX, "item_id").collect()] == ["new"]
    (tmp_path / "zero.json").write_text('{"item_id": 0}\n')
    with pytest.raises(Exception, match="item_id must be positive"):
        files.read_store(spark, f"{tmp_path}/zero.json", schemas.ITEM_INDEX, "item_id").collect()
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, f"{tmp_path}/none.json", schemas.ITEM_INDEX)


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(7, [(8, 0.5, 3), (10, 0.5, 2), (9, 0.25, 1)]), (6, [])], schemas.similarity("item_id"))
    records = sinks.zset_records(docs, "item-similarity", "p::")
    assert {r.key: r["values"] for r in records.collect()} == {"p:7": {"8": 0.5, "10": 0.5, "9": 0.25}, "p:6": {}}
    assert [r.member for r in sinks.zset_top(records, 2).orderBy("position").collect()] == ["8", "10"]
    assert tuple(sinks.dry_run(records).first()) == (2, 3)
    commands = [r.command for r in sinks.zset_commands(records, expire_seconds=9).orderBy("key", "step").collect()]
    assert commands[0] == "DEL p:6" and commands[1:] == ["DEL p:7", commands[2], "EXPIRE p:7 9"] and commands[2].startswith("ZADD p:7 0.5 8")
    action = sinks.bulk_actions(docs, "items", "item_id").filter("_id = '6'").first()
    assert action._source == '{"item_id":6,"neighbors":[]}'
    given = spark.createDataFrame([("k", "zset", [("a", 1.0)])], "key string, type string, members array<struct<member:string,score:double>>")
    assert sinks.passthrough(given).first()["values"] == {"a": 1.0}
    assert sinks.send_in_batches(docs, lambda: len, size=1) == 2
    sinks.write_json(docs, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    with pytest.raises(ValueError):
        sinks.zset_records(docs, "none")
    with pytest.raises(ValueError):
        sinks.write_table(docs, "none_such", create=False)
