"""Retrieval, merging and ranking on hand-computed vectors."""

import pytest
from pyspark.sql import functions as F

from recospark.config import ServingConfig
from recospark.operators import ranking, recommend, retrieval

BEHAVIORS = "user_id long, channel int, position int, item_id long, weight double"
EDGES = "src long, dst long, score double, position int"


def edges(spark, lists):
    return spark.createDataFrame([(s, d, v, i + 1) for s, own in lists.items() for i, (d, v) in enumerate(own)], EDGES)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, user_id long, max_candidates int")


def test_item_cf(spark):
    behaviors = spark.createDataFrame([(1, 0, 1, 100, 2.0), (1, 1, 1, 200, 1.0)], BEHAVIORS)
    graph = edges(spark, {100: [(101, 0.9), (300, 0.8), (102, 0.4)], 200: [(101, 0.8), (201, 0.7), (400, 0.6)]})
    seen = spark.createDataFrame([(1, i) for i in (100, 200, 300, 400)], "user_id long, item_id long")
    got = retrieval.item_cf(requests(spark, (7, 1, 3)), behaviors, graph, seen).orderBy("position").collect()
    assert [(r.item_id, round(r.retrieve_score, 9)) for r in got] == [(101, 2.2), (102, 0.8), (201, 0.35)]
    assert got[0].trigger_id == 100 and round(got[0].reason_score, 9) == 1.8


def test_item_seeds_keep_their_order_up_to_the_cap(spark):
    behaviors = spark.createDataFrame([(1, 0, i + 1, 100 + i, 1.0) for i in range(30)] + [(2, 0, 1, 5, 0.0), (2, 0, 2, 0, 1.0), (2, 1, 1, 5, 1.0), (2, 2, 1, 6, 1.0)], BEHAVIORS)
    got = retrieval.item_seeds(requests(spark, (1, 1, 5), (2, 2, 5)), behaviors).orderBy("request_id", "seed_order").collect()
    assert [r.item_id for r in got if r.request_id == 1] == list(range(100, 124))
    assert [(r.item_id, r.score) for r in got if r.request_id == 2] == [(5, 1.0), (6, 0.3)]


def test_user_cf(spark):
    behaviors = spark.createDataFrame([(10, 0, 1, 101, 2.0), (10, 0, 2, 300, 1.0), (10, 1, 1, 102, 1.0), (20, 0, 1, 101, 1.0), (20, 1, 1, 201, 2.0), (42, 0, 1, 500, 1.0)], BEHAVIORS)
    graph = edges(spark, {42: [(10, 0.9), (20, 0.5), (99, 0.4), (42, 0.3)]})
    seen = spark.createDataFrame([(42, i) for i in (500, 300, 400)], "user_id long, item_id long")
    got = retrieval.user_cf(requests(spark, (1, 42, 3)), behaviors, graph, seen).orderBy("position").collect()
    assert [(r.item_id, round(r.retrieve_score, 9)) for r in got] == [(101, 2.3), (201, 0.7), (102, 0.63)]
    assert got[0].trigger_id == 10 and round(got[0].reason_score, 9) == 1.8


def test_interleaving_merges_after_the_list_is_full(spark):
    schema = "request_id long, item_id long, retrieve_score double, trigger_id long, reason_score double, position int"
    item = spark.createDataFrame([(1, 10, 1.0, 5, 1.0, 1), (1, 20, 0.8, 5, 0.8, 2)], schema)
    user = spark.createDataFrame([(1, 40, 0.7, 6, 0.7, 1), (1, 10, 0.5, 6, 0.5, 2)], schema)
    got = retrieval.interleaved(requests(spark, (1, 9, 2)), [("item_cf", item), ("user_cf", user)]).orderBy("position").collect()
    assert [(r.item_id, r.retrieve_score, r.retriever) for r in got] == [(10, 1.5, "item_cf,user_cf"), (40, 0.7, "user_cf")]
    said = {r.description for r in retrieval.described(spark.createDataFrame(got)).collect()}
    assert "Retrieved from item_cf using trigger item 5." in said and "Retrieved from user_cf using similar user 6." in said


def features(spark):
    names = spark.createDataFrame([(1, "genre", "Adventure"), (1, "genre", "Comedy"), (2, "genre", "Drama")], "item_id long, kind string, name string")
    quality = spark.createDataFrame([(1, 4.0, 100), (2, 5.0, 100)], "item_id long, avg double, count long")
    interests = spark.createDataFrame([(9, "genre", "Adventure", 1.0, False), (9, "genre", "Drama", 2.0, True)], "user_id long, kind string, name string, weight double, negative boolean")
    return ranking.Features(names, quality, interests, spark.createDataFrame([], "user_id long, item_id long, weight double"))


def test_ranker(spark):
    candidates = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.0), (1, 1, 0.2), (1, 0, 9.0), (1, 3, 0.1)], "request_id long, item_id long, retrieve_score double")
    got = ranking.rank(candidates, requests(spark, (1, 9, 10)), features(spark)).orderBy("rank_position").collect()
    assert [r.item_id for r in got] == [1, 3, 2] and round(got[0].retrieve_score, 9) == 0.7
    factors = ranking.score_factors(spark.createDataFrame(got)).collect()
    assert len([f for f in factors if f.item_id == 1]) == 4 and {f.name for f in factors if f.item_id == 3} == {"retrieval", "negative_feedback"}
    assert ranking.rank(candidates.filter("item_id = 0"), requests(spark, (1, 9, 10)), features(spark)).count() == 0
    with pytest.raises(ValueError):
        ranking.rank(candidates, requests(spark, (1, 9, 10)), features(spark), ranker="none")
    with pytest.raises(ValueError):
        ranking.register("heuristic_v1", ranking.heuristic)


def test_statuses_and_expansion(spark):
    asked = requests(spark, (1, 9, 10), (2, 8, 10), (3, 9, 0), (4, 9, 5))
    stores = recommend.Stores(spark.createDataFrame([(9,)], "user_id long"), None, None, None, None, None)
    found = spark.createDataFrame([(1, 5)], "request_id long, item_id long")
    assert {r.request_id: r.status for r in recommend.statuses(asked, stores, found).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    grown = retrieval.expanded(asked, ServingConfig(recall_ratio=1.5))
    assert {r.request_id: r.max_candidates for r in grown.collect()} == {1: 15, 2: 15, 3: 0, 4: 8}


def test_documents_feed_the_stores(spark):
    from recospark.operators import item_index, profiles

    ratings = spark.createDataFrame([(1, 10, 5.0, 100), (1, 11, 3.5, 200), (1, 12, 1.0, 300), (1, 10, 4.0, 50)], "userId long, movieId long, rating double, timestamp long")
    movies = spark.createDataFrame([(10, "Thing, The (1982)", "Horror|Horror"), (11, "X", ""), (12, None, None)], "movieId long, title string, genres string")
    tags = spark.createDataFrame([("1", 10, " Good  Tag "), ("", 10, "blank"), ("2", 99, "none")], "userId string, movieId long, tag string")
    links = spark.createDataFrame([(10, "12", "x"), (11, "", "5"), (12, "tt9", None)], "movieId long, imdbId string, tmdbId string")
    items = item_index.build(movies, tags, links, ratings)
    docs = profiles.build(ratings, movies, tags)
    by = {r.item_id: r for r in items.collect()}
    assert by[10].title == "The Thing" and by[10].year == 1982 and by[10].ext.imdb_id == "tt0000012" and by[10].ext.tmdb_id is None
    assert by[10].tags.tag_count == 2 and by[10].tags.unique_tag_count == 1 and by[10].search.all_text == "the thing horror horror good tag"
    assert by[11].genres == [] and by[11].ext.imdb_id is None and by[11].ext.tmdb_id == 5
    p = docs.first()
    assert [x.item_id for x in p.behaviors.liked_items] == [10] and p.behaviors.rated_items == [12, 11, 10] and p.stats.rating_count == 3
    assert [g.genre for g in p.interests.genres] == ["Horror"] and p.demographics.username == "user_1" and p.embedding_sets == []
    stores = recommend.stores_of(docs, items, edges(spark, {10: [(20, 0.5)]}), edges(spark, {}), precision="double")
    got = recommend.recommend(requests(spark, (1, 1, 5)), stores).collect()
    assert [(r.item_id, r.rank_position) for r in got] == [(20, 1)]
    assert {r.item_id for r in stores.seen.collect()} == {10, 11, 12}
    found = recommend.batch_profiles(spark.createDataFrame([(1, [1, 5, 0, 2**40])], "request_id long, user_ids array<long>"), docs)
    assert [r.status for r in found.orderBy("position").collect()] == ["SUCCESS", "NOT_FOUND", "INVALID", "INVALID"]
    assert found.filter(F.col("behaviors").isNotNull()).count() == 1
