"""Recommendations for many requests in one plan: profile, retrieval, ranking and status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark import schemas
from recospark.config import ServingConfig
from recospark.operators import ranking, retrieval


@dataclass(frozen=True)
class Stores:
    """What serving looks up: users (user_id of each profile), behaviors, seen, both similarity graphs, and features.

    acted: user_id, item_id of seen items but those that are seen as negative alone; what fixtures count.
    """

    users: DataFrame
    behaviors: DataFrame
    seen: DataFrame
    item_edges: DataFrame
    user_edges: DataFrame
    features: ranking.Features
    acted: DataFrame | None = None


def stores_of(profiles: DataFrame, items: DataFrame, item_edges: DataFrame, user_edges: DataFrame, precision: str = "float32") -> Stores:
    """Stores from profile and item documents and similarity edges."""
    return Stores(profiles.select("user_id"), retrieval.behaviors_of(profiles, precision), retrieval.seen_of(profiles), item_edges, user_edges, ranking.features_of(items, profiles), retrieval.acted_of(profiles))


def retrievers(stores: Stores) -> dict[str, retrieval.Retriever]:
    """The retrievers over these stores, in the order in which their lists are interleaved."""
    s = stores
    return {
        retrieval.ITEM_CF: lambda requests, config: retrieval.item_cf(requests, s.behaviors, s.item_edges, s.seen, config),
        retrieval.USER_CF: lambda requests, config: retrieval.user_cf(requests, s.behaviors, s.user_edges, s.seen, config),
    }


def recommend(requests: DataFrame, stores: Stores, config: ServingConfig = ServingConfig()) -> DataFrame:
    """request_id, item_id, rank_position, rank_score, retrieve_score and factors of each request's items, best first."""
    known = requests.join(stores.users, "user_id", "left_semi")
    found = retrieval.orchestrate(known, retrievers(stores), config)
    return ranking.rank(found, known, stores.features, config)


def statuses(requests: DataFrame, stores: Stores, results: DataFrame) -> DataFrame:
    """request_id, user_id, status, n_items and msg of each request: no profile, no valid number of results, no candidates,
    or success."""
    g = schemas.GATEWAY
    users = stores.users.distinct().withColumn("found", F.lit(True))
    counts = results.groupBy("request_id").agg(F.count("*").alias("n"))
    rows = requests.join(users, "user_id", "left").join(counts, "request_id", "left")
    n = F.coalesce("n", F.lit(0))
    lost, wrong = F.col("found").isNull(), F.coalesce(F.col("max_candidates") <= 0, F.lit(True))
    status = F.when(lost, g["USER_NOT_FOUND"]).when(wrong, g["INVALID_REQUEST"]).when(n == 0, g["SYSTEM_ERROR"]).otherwise(g["SUCCESS"])
    user = F.col("user_id").cast("string")
    msg = F.when(lost, F.concat(F.lit("User ID of "), user, F.lit(" not found."))).when(wrong, F.lit("The number of results must be positive."))
    msg = msg.when(n == 0, F.concat(F.lit("No candidates for user "), user, F.lit(".")))
    return rows.select("request_id", "user_id", status.alias("status"), n.alias("n_items"), F.coalesce(msg, F.lit("")).alias("msg"))


def batch_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """request_id, position, user_id, status and behaviours for arrays of user ids, in the order they were asked for."""
    asked = requests.select("request_id", F.posexplode("user_ids").alias("position", "user_id"))
    own = profiles.select("user_id", F.struct("behaviors.recent_liked_items", "behaviors.liked_items", "behaviors.interested_items").alias("behaviors"))
    valid = (F.col("user_id") > 0) & (F.col("user_id") <= 2**31 - 1)
    status = F.when(~valid, "INVALID").when(F.col("behaviors").isNull(), "NOT_FOUND").otherwise("SUCCESS")
    return asked.join(own, "user_id", "left").select("request_id", "position", "user_id", status.alias("status"), "behaviors")
