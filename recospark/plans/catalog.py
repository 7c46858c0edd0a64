"""Registered queries over the driver's tables; recospark.plans.oracles has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recospark.config import PRODUCTION_ITEMS, PRODUCTION_USERS, ItemSimilarityConfig, ProfileConfig, ServingConfig, TagConfig, UserSimilarityConfig
from recospark.functions import text
from recospark.operators import fixture, item_index, profiles, ranking, ratings, recommend, retrieval, rounds, sampling, similarity, sinks
from recospark.operators import tags as T
from recospark.plans.oracles import ORACLES
from recospark.sources import adapters as A

__all__ = ["ORACLES", "QUERIES"]

PROFILE, TAGS, ITEMS, USERS = ProfileConfig(), TagConfig(), ItemSimilarityConfig(), UserSimilarityConfig()
SERVING = ServingConfig(recall_ratio=2.0)
RESULTS = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# Inputs that several queries share.


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return T.evidence(A.tags(s, d), A.movies(s, d), ascii_only=True)


def _rated(s: SparkSession, d: str) -> DataFrame:
    return ratings.weighted(A.ratings(s, d), PROFILE)


def _scores(s: SparkSession, d: str, kind: str, band: str, rated: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    rated = _rated(s, d) if rated is None else rated
    if kind == "genre":
        return profiles.genre_scores(rated, A.movies(s, d), band)
    return profiles.tag_scores(rated, T.top_tags(_evidence(s, d), TAGS, normalized=True) if best is None else best, band)


def _positives(s: SparkSession, d: str, config) -> DataFrame:
    return ratings.positives(A.ratings(s, d), config)


def _valid_users(s: SparkSession, d: str, config) -> tuple[DataFrame, DataFrame]:
    rows = _positives(s, d, config)
    norm = similarity.norms(rows, "userId").filter(F.col("n") >= config.min_user_items)
    return rows.join(norm.select("userId"), "userId", "left_semi"), rows


# Items.


@query
def rating_stats(s, d):
    return ratings.rating_stats(A.ratings(s, d, "l_partkey")).withColumnRenamed("movieId", "item_id")


@query
def tag_evidence(s, d):
    return _evidence(s, d).withColumnRenamed("movieId", "item_id")


@query
def tag_df(s, d):
    return T.document_frequency(_evidence(s, d))


@query
def top_tags(s, d):
    return T.top_tags(_evidence(s, d), TAGS).withColumnRenamed("movieId", "item_id")


@query
def item_titles(s, d):
    t = F.col("title")
    return A.movies(s, d).select(F.col("movieId").alias("item_id"), text.title_of(t).alias("title"), t.alias("title_raw"), text.year_of(t).alias("year"))


@query
def item_genres(s, d):
    rows = A.movies(s, d).select(F.col("movieId").alias("item_id"), F.posexplode(text.parse_genres(F.col("genres"))).alias("p", "genre"))
    return rows.select("item_id", "genre", (F.col("p") + 1).alias("position"))


@query
def item_links(s, d):
    return A.links(s, d).select(F.col("movieId").alias("item_id"), text.format_imdb_id(F.col("imdbId")).alias("imdb_id"), text.format_tmdb_id(F.col("tmdbId")).alias("tmdb_id"))


def _index(s, d, item: str = "l_partkey") -> DataFrame:
    return item_index.build(A.movies(s, d), A.tags(s, d), A.links(s, d), A.ratings(s, d, item), TAGS, ascii_only=True)


@query
def item_search(s, d):
    return _index(s, d).select("item_id", "title_norm", "search.tag_text", "search.all_text")


@query
def item_index_flat(s, d):
    return _index(s, d).select(
        "item_id", "title", "year", F.array_join("genres", "|").alias("genres"), "tags.tag_count", "tags.unique_tag_count", "rating.avg", F.col("rating.count").alias("rating_count"), "search.tag_text"
    )


@query
def item_index_nested(s, d):
    return item_index.build(A.movies(s, d), A.tags(s, d, dealt=False), A.links(s, d), A.ratings(s, d, "l_partkey"), TAGS)


# Users.


@query
def rating_dedupe(s, d):
    rows = ratings.deduplicated(A.ratings(s, d), "timestamp", "rating")
    return rows.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating", F.col("timestamp").alias("event_time"))


@query
def rating_bands(s, d):
    return _rated(s, d).select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "band", _r("weight"))


@query
def user_stats(s, d):
    return profiles.user_stats(_rated(s, d), PROFILE).withColumnRenamed("userId", "user_id")


def _behavior_query(name: str) -> None:
    QUERIES[name] = lambda s, d: profiles.behavior_list(_rated(s, d), name, PROFILE).withColumnRenamed("userId", "user_id")


for _name in profiles.LISTS:
    _behavior_query(_name)


@query
def rated_items(s, d):
    return profiles.rated_items(_rated(s, d), PROFILE).withColumnRenamed("userId", "user_id")


def _interest_query(name: str, kind: str, band: str, limit: int) -> None:
    QUERIES[name] = lambda s, d: profiles.interests(_scores(s, d, kind, band), limit, PROFILE).withColumnRenamed("userId", "user_id")


for _name, _kind, _band, _limit in (
    ("genre_interests", "genre", "positive", PROFILE.top_genres),
    ("tag_interests", "tag", "positive", PROFILE.top_tags),
    ("negative_genre_interests", "genre", "negative", PROFILE.top_negative_genres),
    ("negative_tag_interests", "tag", "negative", PROFILE.top_negative_tags),
):
    _interest_query(_name, _kind, _band, _limit)


@query
def interest_entropy(s, d):
    return profiles.entropy(_scores(s, d, "genre", "positive")).withColumnRenamed("userId", "user_id")


@query
def profiles_nested(s, d):
    return profiles.build(A.ratings(s, d), A.movies(s, d), A.tags(s, d, dealt=False), PROFILE, items=A.items(s, d))


# Similarity.


@query
def item_norms(s, d):
    return similarity.norms(_positives(s, d, PRODUCTION_ITEMS), "movieId").withColumnRenamed("movieId", "item_id")


@query
def user_norms(s, d):
    return similarity.norms(_positives(s, d, PRODUCTION_ITEMS), "userId").withColumnRenamed("userId", "user_id")


@query
def item_pairs(s, d):
    rows = _positives(s, d, PRODUCTION_ITEMS)
    norm = similarity.norms(rows, "movieId").filter(F.col("n") >= PRODUCTION_ITEMS.min_item_users)
    capped = similarity.capped_items(rows.join(norm.select("movieId"), "movieId", "left_semi"), PRODUCTION_ITEMS)
    return similarity.reduced(similarity.pairs(capped, capped, "userId", "movieId"))


def _edges(found: DataFrame) -> DataFrame:
    return found.select("src", "dst", "score", "cooccurrence")


@query
def item_similarity(s, d):
    return _edges(similarity.item_similarity(A.ratings(s, d), ITEMS))


@query
def item_similarity_weighted(s, d):
    return _edges(similarity.item_similarity(A.ratings(s, d), PRODUCTION_ITEMS))


@query
def stable_rank(s, d):
    rows = A.ratings(s, d).select("userId", "movieId").distinct()
    return rows.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), sampling.stable_rank(F.col("movieId"), F.col("userId")).alias("sample_rank"))


@query
def stratified_sample(s, d):
    sampled, _, _ = sampling.participants(*_valid_users(s, d, USERS), USERS)
    return sampled.select(F.col("movieId").alias("item_id"), F.col("userId").alias("user_id"), "weight")


@query
def coverage_anchors(s, d):
    valid, raw = _valid_users(s, d, PRODUCTION_USERS)
    found = sampling.anchors(valid, raw, PRODUCTION_USERS.coverage_anchor_items_per_user)
    return found.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"))


@query
def user_similarity(s, d):
    return _edges(similarity.user_similarity(A.ratings(s, d), USERS))


@query
def user_similarity_coverage(s, d):
    return _edges(similarity.user_similarity(A.ratings(s, d), PRODUCTION_USERS))


# Serving.


def _requests(s, d) -> DataFrame:
    """A request for RESULTS items of each user with a profile."""
    return A.ratings(s, d).select(F.col("userId").alias("user_id")).distinct().select(F.col("user_id").alias("request_id"), "user_id", F.lit(RESULTS).alias("max_candidates"))


def _stores(s, d, written: bool = False) -> recommend.Stores:
    """The stores of serving from the builders' rows, without the detour over documents.

    What several stores are made from is persisted: it is computed once, and again from its lineage if it is lost.
    written: all stores are files instead, which many rounds read, and ratings are not kept.
    """
    keep = rounds.materialise if written else DataFrame.persist
    rated = _rated(s, d) if written else _rated(s, d).persist()
    best = keep(T.top_tags(_evidence(s, d), TAGS, normalized=True))
    listed = keep(profiles.behavior_rows(rated, PROFILE).withColumnRenamed("userId", "user_id"))
    channels = F.create_map(*(F.lit(x) for pair in (("recent_liked_items", 0), ("liked_items", 1), ("interested_items", 2)) for x in pair))
    behaviors = listed.withColumn("channel", channels[F.col("list")]).filter("channel is not null").select("user_id", "channel", "position", "item_id", "weight")
    seen = listed.select("user_id", "item_id").distinct()
    interests = profiles.ranked_interests(rated, A.movies(s, d), best, PROFILE, A.items(s, d)).filter("kept")
    interests = interests.select(F.col("userId").alias("user_id"), "kind", "name", "weight", (F.col("band") == "negative").alias("negative"))
    interests = keep(interests) if written else interests
    genres = A.movies(s, d).select(F.col("movieId").alias("item_id"), F.lit("genre").alias("kind"), F.explode(text.parse_genres(F.col("genres"))).alias("name"))
    tags = best.filter("weight > 0").select(F.col("movieId").alias("item_id"), F.lit("tag").alias("kind"), F.col("tag").alias("name"))
    quality = A.movies(s, d).select("movieId").join(ratings.rating_stats(A.ratings(s, d)), "movieId", "left").withColumnRenamed("movieId", "item_id")
    quality = keep(quality) if written else quality
    disliked = listed.filter("list = 'negative_items'").select("user_id", "item_id", "weight")
    return recommend.Stores(
        (keep(listed.select("user_id").distinct()) if written else rated.select(F.col("userId").alias("user_id")).distinct()),  # each rating is listed somewhere
        behaviors,
        seen,
        keep(similarity.item_similarity(A.ratings(s, d), ITEMS)),
        keep(similarity.user_similarity(A.ratings(s, d), USERS)),
        ranking.Features(genres.union(tags), quality, interests, disliked),
        listed.filter("list <> 'negative_items'").select("user_id", "item_id").distinct(),
    )


def _of_user(found: DataFrame) -> DataFrame:
    """Results under the user's id, which is the request's here."""
    return found.drop("user_id").withColumnRenamed("request_id", "user_id") if "request_id" in found.columns else found


@query
def seen_items(s, d):
    return _stores(s, d).seen


@query
def item_cf_seeds(s, d):
    return _of_user(retrieval.item_seeds(_requests(s, d), _stores(s, d).behaviors, SERVING).select("request_id", "item_id", _r("score", 12), "seed_order"))


def _candidates(s, d, name: str) -> DataFrame:
    found = recommend.retrievers(_stores(s, d))[name](retrieval.expanded(_requests(s, d), SERVING), SERVING)
    return _of_user(found.select("request_id", "item_id", "position", _r("retrieve_score", 13), "trigger_id", _r("reason_score", 13)))


@query
def item_cf_candidates(s, d):
    return _candidates(s, d, retrieval.ITEM_CF)


@query
def user_cf_candidates(s, d):
    return _candidates(s, d, retrieval.USER_CF)


@query
def retrieval_diagnostics(s, d):
    stores = _stores(s, d)
    return _of_user(retrieval.diagnostics(_requests(s, d), stores.behaviors, stores.item_edges, stores.seen, SERVING))


def _orchestrated(s, d) -> DataFrame:
    return retrieval.orchestrate(_requests(s, d), recommend.retrievers(_stores(s, d)), SERVING)


@query
def orchestrated(s, d):
    return _of_user(_orchestrated(s, d).select("request_id", "item_id", "position", "retriever", _r("retrieve_score", 13)))


@query
def retrieval_reasons(s, d):
    return _of_user(retrieval.described(_orchestrated(s, d)).select("request_id", "item_id", "retriever", "description"))


#: Customers whose requests are served in one round, about, and rounds at most.
ROUND_USERS, ROUNDS = 20_000, 16


def _served(s, d, asked: Callable[[recommend.Stores], DataFrame]) -> tuple[DataFrame, recommend.Stores, DataFrame]:
    """Requests, stores, and recommendations: those of many customers in rounds, as candidates take far more room than results."""
    n = rounds.number(A.table(s, d, "customer").count(), ROUND_USERS, ROUNDS)
    stores = _stores(s, d, written=n > 1)
    requests = asked(stores)

    def of(r: int) -> DataFrame:
        if n == 1:
            return recommend.recommend(requests, stores, SERVING)

        def own(df: DataFrame) -> DataFrame:
            return df.filter(rounds.part("user_id", n) == r)

        f = stores.features
        features = replace(f, interests=own(f.interests), negative_items=own(f.negative_items))
        return recommend.recommend(own(requests), replace(stores, seen=own(stores.seen), features=features), SERVING)

    return requests, stores, rounds.by_round(s, n, of)


def _recommended(s, d) -> DataFrame:
    def of_stores(stores):
        return stores.users.select(F.col("user_id").alias("request_id"), "user_id", F.lit(RESULTS).alias("max_candidates"))

    return _served(s, d, of_stores)[2]


@query
def ranked(s, d):
    return _of_user(_recommended(s, d).select("request_id", "item_id", "rank_position", *map(_r, ("rank_score", "retrieval", "interest", "quality", "negative"))))


@query
def score_factors(s, d):
    found = ranking.score_factors(_recommended(s, d), SERVING)
    return _of_user(found.select("request_id", "item_id", "place", "factor_type", "name", _r("raw_value"), _r("contribution")))


@query
def recommend_users(s, d):
    return _of_user(_recommended(s, d).select("request_id", "item_id", "rank_position", _r("rank_score")))


QUERIES["recommend"] = QUERIES.pop("recommend_users")


@query
def recommend_status(s, d):
    key = F.col("c_custkey")
    asked = A.table(s, d, "customer").select((key + 1).alias("request_id"), (key + 1).alias("user_id"), F.when(key % 10 == 0, 0).otherwise(RESULTS).alias("max_candidates"))
    _, stores, found = _served(s, d, lambda _: asked)
    return _of_user(recommend.statuses(asked, stores, found).drop("msg"))


@query
def batch_profiles(s, d):
    docs = profiles.build(A.ratings(s, d), A.movies(s, d), A.tags(s, d), PROFILE, ascii_only=True, items=A.items(s, d))
    key = F.col("c_custkey")
    asked = A.table(s, d, "customer").select(F.lit(1).alias("request_id"), F.array(key + F.when(key % 100 == 0, 2**31).otherwise(1)).alias("user_ids"))
    found = recommend.batch_profiles(asked, docs)
    names = ("recent_liked_items", "liked_items", "interested_items")
    return found.select("user_id", "status", sum(F.coalesce(F.size(f"behaviors.{n}"), F.lit(0)) for n in names).cast("long").alias("n_items"))


# Sinks.


def _zsets(s, d) -> DataFrame:
    return sinks.zset_records(similarity.adjacency(similarity.item_similarity(A.ratings(s, d), ITEMS), "item_id"), "item-similarity")


@query
def redis_zset(s, d):
    return sinks.members(_zsets(s, d)).select("key", "data_type", "member", "score")


@query
def redis_top(s, d):
    return sinks.zset_top(_zsets(s, d), 10).select("key", "member", "score", "position")


@query
def dry_run_counts(s, d):
    return sinks.dry_run(_zsets(s, d))


@query
def user_diagnostics(s, d):
    stores = _stores(s, d)
    return _of_user(retrieval.user_diagnostics(_requests(s, d), stores.behaviors, stores.user_edges, stores.seen, stores.users, SERVING))


def _replayed(s, d) -> DataFrame:
    stores = _stores(s, d)
    stores = replace(stores, item_edges=fixture.cleaned(stores.item_edges), user_edges=fixture.cleaned(stores.user_edges))
    return fixture.replay(fixture.pool(stores.user_edges), stores)


@query
def fixture_replay(s, d):
    return _replayed(s, d).drop("top_item_cf", "top_user_cf")


@query
def fixture_users(s, d):
    return fixture.select_users(_replayed(s, d))
