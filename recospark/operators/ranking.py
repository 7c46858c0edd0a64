"""Rankers of candidates, by name; heuristic_v1 adds retrieval, interest and quality and takes off negative feedback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recospark import schemas
from recospark.config import ServingConfig


@dataclass(frozen=True)
class Features:
    """What rankers look up.

    names: item_id, kind (genre or tag), name, a row for each time an item has it. quality: item_id, avg, count.
    interests: user_id, kind, name, weight, and negative (boolean). negative_items: user_id, item_id, weight.
    """

    names: DataFrame
    quality: DataFrame
    interests: DataFrame
    negative_items: DataFrame


def features_of(items: DataFrame, profiles: DataFrame) -> Features:
    """Features from item and profile documents."""
    genres = items.select("item_id", F.lit("genre").alias("kind"), F.explode("genres").alias("name"))
    tags = items.select("item_id", F.explode("tags.top_tags").alias("t")).filter("t.weight > 0").select("item_id", F.lit("tag").alias("kind"), F.col("t.tag").alias("name"))
    interests = None
    for place, negative in (("interests", False), ("negative_feedbacks", True)):
        for column, kind in (("genres", "genre"), ("tags", "tag")):
            rows = profiles.select("user_id", F.explode(f"{place}.{column}").alias("x")).select("user_id", F.lit(kind).alias("kind"), F.col(f"x.{kind}").alias("name"), F.col("x.weight").alias("weight"), F.lit(negative).alias("negative"))
            interests = rows if interests is None else interests.union(rows)
    disliked = profiles.select("user_id", F.explode("negative_feedbacks.items").alias("x")).select("user_id", "x.item_id", "x.weight")
    return Features(genres.union(tags), items.select("item_id", "rating.avg", "rating.count"), interests, disliked)


#: A ranker: (candidates with user_id, features, config) -> candidates with the factors, which it adds up in order.
Ranker = Callable[[DataFrame, Features, ServingConfig], DataFrame]


def heuristic(candidates: DataFrame, features: Features, config: ServingConfig = ServingConfig()) -> DataFrame:
    """Candidates with retrieval, interest, quality and negative raw values, known (is the item indexed) and rank_score."""
    keys = ["request_id", "user_id", "item_id"]
    wanted = features.interests.filter("name <> ''").groupBy("user_id", "kind", "name").agg(
        F.sum(F.when(F.col("negative"), 0.0).otherwise(F.col("weight"))).alias("liked"), F.sum(F.when(F.col("negative"), F.col("weight")).otherwise(0.0)).alias("disliked")
    )
    # Candidates pass once: their names' matches are summed up without a join back to them.
    named = candidates.join(features.names, "item_id", "left").join(wanted, ["user_id", "kind", "name"], "left")
    others = [F.first(c).alias(c) for c in candidates.columns if c not in keys]
    matched = named.groupBy(*keys).agg(*others, F.sum("liked").alias("liked"), F.sum("disliked").alias("disliked"))
    disliked = features.negative_items.filter("item_id > 0").groupBy("user_id", "item_id").agg(F.sum("weight").alias("item_disliked"))
    quality = features.quality.withColumn("known", F.lit(True))
    rows = matched.join(disliked, ["user_id", "item_id"], "left").join(quality, "item_id", "left")
    zero = F.lit(0.0)
    good = F.when((F.col("avg") > 0) & (F.col("count") > 0), F.col("avg") / 5.0 * F.log1p(F.col("count").cast("double"))).otherwise(0.0)
    rows = rows.select(
        *candidates.columns,
        F.coalesce("known", F.lit(False)).alias("known"),
        F.col("retrieve_score").alias("retrieval"),
        F.coalesce("liked", zero).alias("interest"),
        good.alias("quality"),
        (F.coalesce("item_disliked", zero) + F.coalesce("disliked", zero)).alias("negative"),
    )
    c = config
    score = F.col("retrieval") * c.retrieval_weight + F.col("interest") * c.interest_weight + F.col("quality") * c.quality_weight - F.col("negative") * c.negative_weight
    return rows.withColumn("rank_score", score)


RANKERS: dict[str, Ranker] = {"heuristic_v1": heuristic}
DEFAULT_RANKER = "heuristic_v1"


def register(name: str, ranker: Ranker) -> None:
    """Adds a ranker under a new, non-empty name."""
    if not name or name in RANKERS:
        raise ValueError(f"a ranker needs a new name: {name!r}")
    RANKERS[name] = ranker


def rank(candidates: DataFrame, requests: DataFrame, features: Features, config: ServingConfig = ServingConfig(), ranker: str = DEFAULT_RANKER) -> DataFrame:
    """Merged candidates of requests (request_id, user_id, max_candidates) with rank_score and rank_position, best first.

    Candidates of one item are merged, their scores added; item 0 is none.
    """
    if ranker not in RANKERS:
        raise ValueError(f"unknown ranker: {ranker}")
    valid = candidates.filter("item_id <> 0").groupBy("request_id", "item_id").agg(F.sum("retrieve_score").alias("retrieve_score"))
    asked = requests.filter("max_candidates > 0").select("request_id", "user_id", "max_candidates")
    scored = RANKERS[ranker](valid.join(asked, "request_id"), features, config)
    order = Window.partitionBy("request_id").orderBy(F.desc("rank_score"), "item_id")
    ranked = scored.withColumn("rank_position", F.row_number().over(order)).filter("rank_position <= max_candidates")
    return ranked.withColumn("ranker", F.lit(ranker)).drop("max_candidates")


def score_factors(ranked: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """One row for each factor of a ranked candidate, in the order they are added; unindexed items have the outer two."""
    factors = [("retrieval", schemas.FACTOR_RETRIEVAL, config.retrieval_weight), ("interest", schemas.FACTOR_INTEREST, config.interest_weight), ("quality", schemas.FACTOR_QUALITY, config.quality_weight), ("negative", schemas.FACTOR_NEGATIVE, -config.negative_weight)]
    names = {"interest": "interest_match", "negative": "negative_feedback"}
    listed = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(code).alias("factor_type"), F.lit(names.get(c, c)).alias("name"), F.col(c).alias("raw_value"), F.lit(w).alias("weight"), (F.col(c) * w).alias("contribution")) for i, (c, code, w) in enumerate(factors)))
    rows = ranked.select("request_id", "item_id", "known", F.explode(listed).alias("f")).select("request_id", "item_id", "known", "f.*")
    return rows.filter("known or place in (0, 3)").drop("known")
