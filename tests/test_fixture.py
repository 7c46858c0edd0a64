"""Fixture extraction, store validation and sinks."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recospark import schemas
from recospark.config import FixtureConfig, ItemSimilarityConfig, UserSimilarityConfig
from recospark.operators import fixture, item_index, profiles, recommend, retrieval, similarity, sinks
from recospark.sources import files


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, score double, position int")


def test_cleaned_edges(spark):
    rows = [(1, 2, 0.5, 1), (1, 1, 0.9, 2), (1, 0, 0.9, 3), (1, 3, 0.0, 4), (1, 2, 0.4, 5), (1, 4, 0.3, 6), (2, -1, 1.0, 1)]
    assert sorted(tuple(r) for r in fixture.cleaned(edges(spark, rows)).select("src", "dst", "score", "position").collect()) == [(1, 2, 0.5, 1), (1, 4, 0.3, 2)]


def test_pool(spark):
    rows = [(u, 100 + k, 0.1 * (u % 7 + 1), k) for u in range(1, 201) for k in range(1, 4)]
    config = FixtureConfig(target_users=1, pool_size=20, max_neighbors=2)
    got = {r.user_id for r in fixture.pool(edges(spark, rows), config).collect()}
    rank = lambda u: int.from_bytes(hashlib.blake2b(str(u).encode(), digest_size=8).digest(), "big")
    best = sorted(range(1, 201), key=lambda u: (-(u % 7), -u))[:50]
    assert got == set(best) | set(sorted(range(1, 201), key=rank)[:25])


def plain_choice(rows, config):
    """The quotas' rule row by row."""
    chosen = {}
    f = {
        "dual": lambda r: min(r.n_item_cf, r.n_user_cf) * 10 + r.union + r.hits,
        "item_strong": lambda r: r.n_item_cf * 10 - r.n_user_cf * 2 + r.item_filtered + r.user_filtered,
        "user_strong": lambda r: r.n_user_cf * 10 - r.n_item_cf * 2 + r.hits * 2,
        "sparse": lambda r: 100 / max(r.behaviors, 1) + r.union,
        "overlap_filter": lambda r: r.overlap * 8 + (r.item_filtered + r.user_filtered) * 3 + r.union,
        "content": lambda r: r.union * 5 + r.seeds + r.hits,
    }
    usable = [r for r in rows if r.union]
    for kind, quota in fixture.QUOTAS.items():
        for r in sorted(usable, key=lambda r: (-f[kind](r), r.user_id)):
            if quota and len(chosen) < config.target_users and r.user_id not in chosen:
                chosen[r.user_id] = kind
                quota -= 1
    for r in sorted(usable, key=lambda r: (-r.union, -r.hits, r.user_id)):
        if len(chosen) < config.target_users:
            chosen.setdefault(r.user_id, fixture.FALLBACK)
    return chosen


@pytest.mark.parametrize("target", [4, 14])
def test_choice(spark, target):
    import random

    rng = random.Random(target)
    names = ["behaviors", "seeds", "hits", "n_item_cf", "n_user_cf", "overlap", "union", "item_filtered", "user_filtered"]
    rows = spark.createDataFrame([(u, *(rng.randint(0, 6) for _ in names)) for u in range(1, 60)], "user_id long, " + ", ".join(f"`{n}` long" for n in names))
    config = FixtureConfig(target_users=target)
    assert {r.user_id: r.kind for r in fixture.select_users(rows, config).collect()} == plain_choice(rows.collect(), config)


def test_extract_and_write(spark, tmp_path):
    ratings = spark.createDataFrame([(u, i, 5.0 if (u * i) % 3 else 1.0, 100 * u + i) for u in range(1, 13) for i in range(10, 22) if (7 * u + 3 * i) % 5 > 1], "userId long, movieId long, rating double, timestamp long")
    movies = spark.createDataFrame([(i, f"T{i} (1990)", "A|B") for i in range(10, 21)], "movieId long, title string, genres string")
    tags = spark.createDataFrame([("1", 10, "x")], "userId string, movieId long, tag string")
    items = item_index.build(movies, tags, spark.createDataFrame([], schemas.LINKS), ratings)
    docs = profiles.build(ratings, movies, tags).filter("user_id <> 12")
    item_edges = similarity.item_similarity(ratings, ItemSimilarityConfig(min_item_users=1, min_cooccurrence=1))
    user_edges = similarity.user_similarity(ratings, UserSimilarityConfig(min_user_items=1, min_cooccurrence=1))
    config = FixtureConfig(target_users=3)
    found = fixture.extract(docs, items, item_edges, user_edges, config)
    counts = found.counts()
    assert 0 < counts["gateway_users"] <= 3 and counts["user_similarity_rows"] == counts["gateway_users"]
    fixture.write(found, str(tmp_path / "out"), config)
    said = json.loads("".join(p.read_text() for p in (tmp_path / "out/manifest").glob("*.json")))
    assert said["counts"] == counts and len(said["users"]) == counts["gateway_users"]
    assert said["selected_user_ids"] == sorted(said["selected_user_ids"])
    kept = files.read_profiles(spark, str(tmp_path / "out/profiles"))
    assert kept.count() == counts["profiles"] and set(said["selected_user_ids"]) <= {r.user_id for r in kept.collect()}
    back = files.read_similarity(spark, str(tmp_path / "out/user_similarity"), "user_id")
    assert back.groupBy("src").count().agg(F.max("count")).first()[0] <= config.max_neighbors
    related = {r.item_id for r in found.related.collect()}
    present = {r.item_id for r in items.collect()}
    assert counts["missing_item_index_rows"] == len(related - present) and counts["item_index_rows"] == len(related & present)


def test_user_diagnostics(spark):
    requests = spark.createDataFrame([(1, 1, 5)], "request_id long, user_id long, max_candidates int")
    behaviors = spark.createDataFrame([(2, 0, 1, 50, 1.0), (2, 1, 1, 51, 1.0), (3, 0, 1, 52, 1.0)], "user_id long, channel int, position int, item_id long, weight double")
    seen = spark.createDataFrame([(1, 50)], "user_id long, item_id long")
    got = retrieval.user_diagnostics(requests, behaviors, edges(spark, [(1, 2, 0.9, 1), (1, 4, 0.8, 2)]), seen, spark.createDataFrame([(1,), (2,), (3,)], "user_id long")).first()
    assert (got.neighbors, got.missing, got.user_fetched, got.user_filtered) == (2, 1, 2, 1)


def test_failing_retriever(spark):
    requests = spark.createDataFrame([(1, 1, 5)], "request_id long, user_id long, max_candidates int")
    found = spark.createDataFrame([(1, 7, 0.5, 9, 0.5, 1)], "request_id long, item_id long, retrieve_score double, trigger_id long, reason_score double, position int")

    def fails(asked, config):
        raise RuntimeError("no store")

    with pytest.warns(UserWarning, match="no store"):
        assert [r.item_id for r in retrieval.orchestrate(requests, {"a": fails, "b": lambda asked, config: found}).collect()] == [7]
    with pytest.raises(RuntimeError), pytest.warns(UserWarning):
        retrieval.orchestrate(requests, {"a": fails})


def written(path, text):
    path.write_text(text)
    return str(path)


def test_validation(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.validate_input(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="empty"):
        files.validate_input(spark, written(tmp_path / "empty", ""))
    with pytest.raises(ValueError, match="no document"):
        files.validate_input(spark, written(tmp_path / "blank", " \n\n"))
    with pytest.raises(ValueError, match="no JSON array"):
        files.validate_input(spark, written(tmp_path / "lines", '{"a":1}\n'), "json")
    files.validate_input(spark, written(tmp_path / "array", '[{"a":1}]'), "json")
    for bad in ('{"item_id":0,"neighbors":[]}', '{"item_id":1,"neighbors":[{"item_id":"x","score":1}]}', '{"item_id":1,"neighbors":[{"item_id":2,"score":"NaN"}]}', '{"item_id":1.5,"neighbors":[]}'):
        with pytest.raises(PySparkException, match="must be"):
            files.read_similarity(spark, written(tmp_path / "bad", '{"item_id":9,"neighbors":[{"item_id":1,"score":1}]}\n' + bad), "item_id").collect()
    good = files.read_similarity(spark, written(tmp_path / "good", '{"item_id":"7","neighbors":[{"item_id":"8","score":"0.5"},{"item_id":9,"score":1}]}'), "item_id")
    assert [tuple(r) for r in good.orderBy("position").collect()] == [(7, 8, 0.5, 0, 1), (7, 9, 1.0, 0, 2)]
    with pytest.raises(PySparkException, match="in range"):
        files.read_profiles(spark, written(tmp_path / "p", '{"user_id":4294967296}')).collect()


def test_lines_of(spark, tmp_path):
    path = written(tmp_path / "l", '{"item_id": 1, "title": "a"}\n\n{"item_id":2,"title":"b"}\nnot json\n{"item_id":-3}\n')
    ids = spark.createDataFrame([(2,), (-3,), (7,)], "item_id long")
    schema = StructType.fromDDL("item_id long, title string")
    assert sorted((r.item_id, r.title) for r in files.lines_of(spark, path, "item_id", ids, schema).collect()) == [(-3, None), (2, "b")]


def test_array_sink_and_senders(spark, tmp_path):
    docs = spark.range(5).select(F.col("id").alias("item_id"), F.lit("\u00fc").alias("t")).orderBy("item_id")
    sinks.write_json_array(docs, str(tmp_path / "a"))
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("*.txt"))
    assert json.loads(text) == [{"item_id": i, "t": "\u00fc"} for i in range(5)] and "\u00fc" in text
    sinks.write_json_array(docs.limit(0), str(tmp_path / "b"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "b").glob("*.txt"))) == []
    log = str(tmp_path / "log")

    def connect():
        def execute(commands):
            with open(log, "a") as f:
                f.writelines(json.dumps(c) + "\n" for c in commands)

        return execute

    records = spark.createDataFrame([("k1", "zset", {"1": 0.5}), ("k2", "zset", {})], "key string, data_type string, values map<string,double>").coalesce(1)
    assert sinks.send_zsets(records, connect, expire_seconds=9) == 2
    assert [json.loads(x) for x in open(log)] == [["DEL", "k1"], ["ZADD", "k1", {"1": 0.5}], ["EXPIRE", "k1", 9], ["DEL", "k2"]]
    refused = sinks.send_bulk(docs, "items", "item_id", lambda: lambda batch: {i: "no" for i, r in enumerate(batch) if r["_id"] == "3"}, size=2)
    assert [tuple(r) for r in refused.collect()] == [("3", "no")]


def test_status_messages(spark):
    asked = spark.createDataFrame([(1, 9, 5), (2, 8, 5), (3, 9, 0)], "request_id long, user_id long, max_candidates int")
    stores = recommend.Stores(spark.createDataFrame([(9,)], "user_id long"), None, None, None, None, None)
    got = {r.request_id: r.msg for r in recommend.statuses(asked, stores, spark.createDataFrame([(1, 5)], "request_id long, item_id long")).collect()}
    assert got[1] == "" and "8" in got[2] and "positive" in got[3]


def test_settings():
    for bad in ({"min_item_users": 0}, {"min_user_items": 0}, {"coverage_anchor_items_per_user": -1}, {"coverage_pair_sample_size": -1}):
        with pytest.raises(ValueError):
            UserSimilarityConfig(**bad)
    with pytest.raises(ValueError):
        ItemSimilarityConfig(min_item_users=0)
