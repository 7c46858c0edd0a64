"""A small fixture of large stores: users whose requests show how retrieval works, and the rows of all stores they need.

A bounded pool of users is drawn from the user graph, their requests are replayed, and quotas choose among them. What
the chosen ones need of each store is kept by semi-joins.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from recospark.config import FixtureConfig, ServingConfig
from recospark.operators import recommend, retrieval, similarity, sinks

#: Kinds of users in the order they are chosen, and how many of each.
QUOTAS = {"dual": 3, "item_strong": 2, "user_strong": 2, "sparse": 1, "overlap_filter": 1, "content": 1}
FALLBACK = "fallback"


@F.pandas_udf(DecimalType(20, 0))
def _hashed(x: pd.Series) -> pd.Series:
    from decimal import Decimal

    return x.map(lambda v: Decimal(int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "big")))


def deterministic_rank(c):
    """An id's eight-byte BLAKE2b hash, as an unsigned number."""
    return _hashed(c)


def cleaned(edges: DataFrame) -> DataFrame:
    """Edges to another, positive id with a positive score, once for each: the first place, counted anew."""
    valid = edges.filter("dst > 0 and dst <> src and score > 0")
    once = valid.groupBy("src", "dst").agg(F.min(F.struct("position", "score")).alias("x")).select("src", "dst", "x.score", F.col("x.position").alias("place"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("src").orderBy("place"))).drop("place")


def pool(user_edges: DataFrame, config: FixtureConfig = FixtureConfig()) -> DataFrame:
    """user_id of the users with the best neighbours, and of those with the least hash ranks; user_edges: cleaned.

    Of equally good users the larger ids stay, as a bounded heap keeps them.
    """
    near = user_edges.filter(F.col("position") <= config.max_neighbors)
    quality = near.groupBy(F.col("src").alias("user_id")).agg((F.sum("score") + F.count("*") * 0.05).alias("quality"))
    best = quality.orderBy(F.desc("quality"), F.desc("user_id")).limit(max(config.pool_size, config.target_users * 50))
    drawn = quality.withColumn("rank", deterministic_rank(F.col("user_id"))).orderBy("rank", "user_id").limit(max(config.pool_size // 2, config.target_users * 25))
    return best.select("user_id").union(drawn.select("user_id")).distinct()


def _serving(config: FixtureConfig) -> ServingConfig:
    return ServingConfig(max_item_seeds=config.max_seeds, max_user_seeds=config.max_neighbors)


def replay(users: DataFrame, stores: recommend.Stores, config: FixtureConfig = FixtureConfig()) -> DataFrame:
    """What the requests of users (user_id) with a profile and seeds find and pass over; edges of the stores: cleaned.

    user_id, behaviors, seeds, seen, neighbors, hits, misses, n_item_cf, n_user_cf, overlap, union, item_filtered,
    user_filtered, top_item_cf and top_user_cf (the first five).
    """
    requests = users.join(stores.users.distinct(), "user_id", "left_semi").select(F.col("user_id").alias("request_id"), "user_id", F.lit(config.max_candidates).alias("max_candidates"))
    serving = _serving(config)
    item = retrieval.item_cf(requests, stores.behaviors, stores.item_edges, stores.seen, serving)
    user = retrieval.user_cf(requests, stores.behaviors, stores.user_edges, stores.seen, serving)
    passed = retrieval.diagnostics(requests, stores.behaviors, stores.item_edges, stores.seen, serving)
    near = retrieval.user_diagnostics(requests, stores.behaviors, stores.user_edges, stores.seen, stores.users, serving)
    # Lists of at most max_candidates items.
    found = item.select("request_id", "item_id", "position", F.lit(0).alias("by")).union(user.select("request_id", "item_id", "position", F.lit(1).alias("by")))
    listed = F.sort_array(F.collect_list(F.struct("by", "position", "item_id")))
    lists = found.groupBy("request_id").agg(listed.alias("xs"))

    def of(by: int):
        return F.transform(F.filter(F.coalesce("xs", F.array()), lambda x: x["by"] == by), lambda x: x["item_id"])

    acted = stores.acted if stores.acted is not None else stores.seen
    rows = passed.join(near, "request_id", "left").join(lists, "request_id", "left").withColumnRenamed("request_id", "user_id")
    rows = rows.join(acted.groupBy("user_id").agg(F.count_distinct("item_id").alias("behaviors")), "user_id", "left")
    rows = rows.join(stores.seen.groupBy("user_id").agg(F.count_distinct("item_id").alias("seen")), "user_id", "left")
    rows = rows.withColumn("a", of(0)).withColumn("b", of(1))
    count = {n: F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("behaviors", "seeds", "seen", "neighbors")}
    return rows.select(
        "user_id", *count.values(), (F.coalesce("neighbors", F.lit(0)) - F.coalesce("missing", F.lit(0))).cast("long").alias("hits"), F.coalesce("missing", F.lit(0)).cast("long").alias("misses"),
        F.size("a").cast("long").alias("n_item_cf"), F.size("b").cast("long").alias("n_user_cf"), F.size(F.array_intersect("a", "b")).cast("long").alias("overlap"), F.size(F.array_union("a", "b")).cast("long").alias("union"),
        F.col("filtered").cast("long").alias("item_filtered"), F.coalesce("user_filtered", F.lit(0)).cast("long").alias("user_filtered"), F.slice("a", 1, 5).alias("top_item_cf"), F.slice("b", 1, 5).alias("top_user_cf"),
    )


def scores() -> dict:
    """Each kind's score of a replayed request."""
    items, users, both, hits = (F.col(c).cast("double") for c in ("n_item_cf", "n_user_cf", "union", "hits"))
    pressure = (F.col("item_filtered") + F.col("user_filtered")).cast("double")
    return {
        "dual": F.least(items, users) * 10 + both + hits,
        "item_strong": items * 10 - users * 2 + pressure,
        "user_strong": users * 10 - items * 2 + hits * 2,
        "sparse": 100.0 / F.greatest("behaviors", F.lit(1)) + both,
        "overlap_filter": F.col("overlap") * 8 + pressure * 3 + both,
        "content": both * 5 + F.col("seeds") + hits,
    }


def select_users(rows: DataFrame, config: FixtureConfig = FixtureConfig()) -> DataFrame:
    """user_id and kind of the chosen of replayed requests: each kind's best scored that no kind before it took, and those
    with most candidates, then most neighbours, to fill up. Requests without candidates are never chosen."""
    fill = F.struct(F.lit(len(QUOTAS)).alias("turn"), F.col("union").cast("double").alias("score"), F.col("hits").cast("double").alias("more"))
    by_kind = [F.struct(F.lit(i).alias("turn"), s.alias("score"), F.lit(0.0).alias("more")) for i, s in enumerate(scores().values())]
    ranked = rows.filter(F.col("union") > 0).select("user_id", F.explode(F.array(*by_kind, fill)).alias("x")).select("user_id", "x.*")
    # Whoever is chosen in a turn is among its first target_users rows, as those before took fewer; so few rows are dealt out.
    order = Window.partitionBy("turn").orderBy(F.desc("score"), F.desc("more"), "user_id")
    few = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= config.target_users).orderBy("turn", "n").collect()
    chosen: dict[int, str] = {}
    for turn, (kind, quota) in enumerate([*QUOTAS.items(), (FALLBACK, config.target_users)]):
        own = [r.user_id for r in few if r.turn == turn and r.user_id not in chosen]
        chosen |= dict.fromkeys(own[: min(quota, config.target_users - len(chosen))], kind)
    return rows.sparkSession.createDataFrame(list(chosen.items()), "user_id long, kind string")


@dataclass(frozen=True)
class Fixture:
    """The chosen users with what their requests found, the documents they need, and related items without a document."""

    users: DataFrame
    profiles: DataFrame
    user_similarity: DataFrame
    item_similarity: DataFrame
    item_index: DataFrame
    related: DataFrame
    missing: int

    def counts(self) -> dict[str, int]:
        """How many rows each part has."""
        users = self.users.count()
        return {
            "profiles": self.profiles.count(), "gateway_users": users, "user_similarity_rows": self.user_similarity.count(), "item_similarity_rows": self.item_similarity.count(),
            "related_item_ids": self.related.count(), "item_index_rows": self.item_index.count(), "missing_item_index_rows": self.missing,
        }


def extract(profiles: DataFrame, items: DataFrame, item_edges: DataFrame, user_edges: DataFrame, config: FixtureConfig = FixtureConfig()) -> Fixture:
    """A fixture of profile documents, item documents and both graphs."""
    item_edges, user_edges = cleaned(item_edges), cleaned(user_edges)
    stores = recommend.stores_of(profiles, items, item_edges, user_edges, precision="double")
    rows = replay(pool(user_edges, config), stores, config)
    # target_users rows at most, which everything else starts from.
    found = rows.join(F.broadcast(select_users(rows, config)), "user_id")
    users = rows.sparkSession.createDataFrame(found.collect(), found.schema)
    chosen = users.select("user_id")
    near = user_edges.filter(F.col("position") <= config.max_neighbors).join(F.broadcast(chosen.withColumnRenamed("user_id", "src")), "src", "left_semi")
    kept = profiles.join(chosen.union(near.select("dst")).distinct(), "user_id", "left_semi")
    requests = chosen.select(F.col("user_id").alias("request_id"), "user_id", F.lit(config.max_candidates).alias("max_candidates"))
    serving = _serving(config)
    seeds = retrieval.item_seeds(requests, stores.behaviors, serving).select("item_id").distinct()
    lists = item_edges.join(seeds.withColumnRenamed("item_id", "src"), "src", "left_semi")
    named = [
        seeds, lists.filter(F.col("position") <= config.max_candidates).select("dst"), stores.seen.join(kept.select("user_id"), "user_id", "left_semi").select("item_id"),
        retrieval.item_cf(requests, stores.behaviors, item_edges, stores.seen, serving).select("item_id"), retrieval.user_cf(requests, stores.behaviors, user_edges, stores.seen, serving).select("item_id"),
    ]
    related = named[0]
    for more in named[1:]:
        related = related.union(more)
    related = related.distinct()
    index = items.join(related, "item_id", "left_semi")
    missing = related.join(items.select("item_id"), "item_id", "left_anti").count()
    return Fixture(users, kept, similarity.adjacency(_counted(near), "user_id"), similarity.adjacency(_counted(lists), "item_id"), index, related, missing)


def _counted(edges: DataFrame) -> DataFrame:
    return edges if "cooccurrence" in edges.columns else edges.withColumn("cooccurrence", F.lit(None).cast("long"))


def manifest(found: Fixture, path: str, config: FixtureConfig = FixtureConfig()) -> DataFrame:
    """One row: parameters, paths, formats, counts, and what the chosen users' requests found."""
    parts = ("profiles", "user_similarity", "item_similarity", "item_index")
    user = F.struct(
        "user_id", F.col("behaviors").alias("profile_item_count"), F.col("seeds").alias("trigger_seed_count"), F.col("seen").alias("filter_item_count"), F.col("neighbors").alias("user_similarity_neighbor_count"),
        F.col("hits").alias("neighbor_profile_hits"), F.col("misses").alias("neighbor_profile_misses"), F.col("n_item_cf").alias("item_cf_candidate_count"), F.col("n_user_cf").alias("user_cf_candidate_count"),
        F.col("overlap").alias("overlap_count"), F.col("item_filtered").alias("item_cf_filtered_count"), F.col("user_filtered").alias("user_cf_filtered_count"),
        F.col("top_item_cf").alias("top_item_cf_items"), F.col("top_user_cf").alias("top_user_cf_items"),
    )
    parameters = {"target_user_count": config.target_users, "max_user_neighbors": config.max_neighbors, "max_trigger_seeds": config.max_seeds, "max_candidates": config.max_candidates}

    def struct(values: dict):
        return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))

    return found.users.agg(F.sort_array(F.collect_list(user)).alias("users")).select(
        F.lit("Small fixture of recommendation stores.").alias("description"), struct(parameters).alias("parameters"), struct({p: f"{path}/{p}" for p in parts}).alias("paths"),
        struct(dict.fromkeys(parts, "jsonl")).alias("formats"), F.transform("users", lambda u: u["user_id"]).alias("selected_user_ids"), struct(found.counts()).alias("counts"), "users",
    )


def write(found: Fixture, path: str, config: FixtureConfig = FixtureConfig()) -> None:
    """The fixture's documents as JSON lines sorted by id, each kind below its name, and the manifest."""
    for name, key in (("profiles", "user_id"), ("user_similarity", "user_id"), ("item_similarity", "item_id"), ("item_index", "item_id")):
        sinks.write_json(getattr(found, name).orderBy(key), f"{path}/{name}")
    sinks.write_json(manifest(found, path, config), f"{path}/manifest")
