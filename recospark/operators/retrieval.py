"""Candidate retrieval for many requests at once: item-based, user-based, and their combination.

requests: request_id, user_id, max_candidates. behaviors: user_id, channel (0 recent, 1 liked, 2 interested), position,
item_id, weight. edges: src, dst, score, position (best first). seen: user_id, item_id.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recospark.config import ServingConfig

#: Fixed weights of the channels recent, liked and interested.
ITEM_CHANNELS, USER_CHANNELS = (1.0, 0.5, 0.3), (1.0, 0.7, 0.3)
#: Retrievers in the order in which their lists are interleaved.
ITEM_CF, USER_CF = "item_cf", "user_cf"
RETRIEVERS = (ITEM_CF, USER_CF)

#: A retriever: (requests, config) -> candidates as rows of request_id, item_id, retrieve_score, trigger_id,
#: reason_score and position.
Retriever = Callable[[DataFrame, ServingConfig], DataFrame]


def behaviors_of(profiles: DataFrame, precision: str = "float32") -> DataFrame:
    """The behaviour rows of profile documents. float32: weights as they are served."""
    lists = [("recent_liked_items", 0), ("liked_items", 1), ("interested_items", 2)]
    out = None
    for name, channel in lists:
        rows = profiles.select("user_id", F.posexplode(f"behaviors.{name}").alias("place", "x"))
        weight = F.col("x.weight").cast("float").cast("double") if precision == "float32" else F.col("x.weight")
        rows = rows.select("user_id", F.lit(channel).alias("channel"), (F.col("place") + 1).alias("position"), F.col("x.item_id").alias("item_id"), weight.alias("weight"))
        out = rows if out is None else out.union(rows)
    return out


def _named(profiles: DataFrame, *more: Column) -> DataFrame:
    b = "behaviors."
    lists = [*(F.col(f"{b}{n}.item_id") for n in ("recent_liked_items", "liked_items", "interested_items")), F.col(f"{b}rated_items"), *more]
    ids = F.flatten(F.array(*(F.coalesce(x, F.array()) for x in lists)))
    return profiles.select("user_id", F.explode(F.array_distinct(ids)).alias("item_id")).filter("item_id > 0")


def seen_of(profiles: DataFrame) -> DataFrame:
    """The distinct items that a profile document names anywhere: liked, recent, interested, rated or negative."""
    return _named(profiles, F.col("negative_feedbacks.items.item_id"))


def acted_of(profiles: DataFrame) -> DataFrame:
    """The distinct items that a profile document names as liked, recent, interested or rated."""
    return _named(profiles)


def _limit(config: ServingConfig) -> Column:
    """A request's number of candidates; none or less takes the default."""
    return F.when(F.col("max_candidates") > 0, F.col("max_candidates")).otherwise(config.default_candidates)


def _scored(rows: DataFrame, channels: tuple[float, ...], key: list[str]) -> DataFrame:
    """Behaviour rows with their score, base weight over position; of an item's rows the first channel's stays."""
    base = F.array(*map(F.lit, channels))[F.col("channel")]
    score = base * F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0) / F.col("position")
    first = Window.partitionBy(*key, "item_id").orderBy("channel", "position")
    valid = rows.filter("item_id > 0").withColumn("score", score)
    return valid.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def item_seeds(requests: DataFrame, behaviors: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """request_id, user_id, max_candidates, item_id, score, seed_order: the items that a request starts from.

    Up to max_item_seeds keep the order of their channels; of more the best scored stay, in that order.
    """
    rows = _scored(requests.join(behaviors, "user_id"), ITEM_CHANNELS, ["request_id"])
    by_request = Window.partitionBy("request_id")
    many = F.col("_all") > config.max_item_seeds
    order = by_request.orderBy(F.when(many, -F.col("score")), F.when(many, F.col("item_id")), "channel", "position")
    ranked = rows.withColumn("_all", F.count("*").over(by_request)).withColumn("seed_order", F.row_number().over(order))
    return ranked.filter(F.col("seed_order") <= config.max_item_seeds).select("request_id", "user_id", "max_candidates", "item_id", "score", "seed_order")


def _ranked(found: DataFrame, seen: DataFrame, multiplier: float) -> DataFrame:
    """Candidates from contributions (request_id, user_id, most, item_id, c, seed_order, trigger_id), in ranked order.

    A candidate's contributions, one from each seed at most, are added in the order of the seeds; its reason is the
    greatest, the first of equals.
    """
    new = found.filter("item_id <> 0 and c > 0").join(seen, ["user_id", "item_id"], "left_anti")
    listed = F.sort_array(F.collect_list(F.struct("seed_order", "c", "trigger_id"))).alias("xs")
    grouped = new.groupBy("request_id", "most", "item_id").agg(listed)
    best = F.array_max(F.transform("xs", lambda x: F.struct(x["c"].alias("c"), (-x["seed_order"]).alias("o"), x["trigger_id"].alias("t"))))
    rows = grouped.withColumn("raw", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["c"])).withColumn("best", best)
    order = Window.partitionBy("request_id").orderBy(F.desc("raw"), "item_id")
    ranked = rows.withColumn("position", F.row_number().over(order)).filter("position <= most")
    return ranked.select("request_id", "item_id", (F.col("raw") * multiplier).alias("retrieve_score"), F.col("best.t").alias("trigger_id"), (F.col("best.c") * multiplier).alias("reason_score"), "position")


def item_cf(requests: DataFrame, behaviors: DataFrame, edges: DataFrame, seen: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """Neighbours of the items that a user liked."""
    seeds = item_seeds(requests, behaviors, config).withColumn("most", _limit(config))
    e = edges.filter("score > 0").select(F.col("src").alias("seed"), F.col("dst"), F.col("score").alias("similarity"), F.col("position").alias("place"))
    met = seeds.withColumnRenamed("item_id", "seed").join(e, "seed").filter("place <= most")
    found = met.select("request_id", "user_id", "most", F.col("dst").alias("item_id"), (F.col("score") * F.col("similarity")).alias("c"), "seed_order", F.col("seed").alias("trigger_id"))
    return _ranked(found, seen, config.item_multiplier)


def user_seeds(requests: DataFrame, edges: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """request_id, user_id, most, neighbor, similarity, seed_order: the most similar users of each request's user."""
    near = edges.filter(F.col("position") <= config.max_user_seeds).select(F.col("src").alias("user_id"), F.col("dst").alias("neighbor"), F.col("score").alias("similarity"), F.col("position").alias("seed_order"))
    met = requests.withColumn("most", _limit(config)).join(near, "user_id").filter("neighbor <> 0 and neighbor <> user_id and similarity > 0")
    first = Window.partitionBy("request_id", "neighbor").orderBy("seed_order")
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("request_id", "user_id", "most", "neighbor", "similarity", "seed_order")


def user_cf(requests: DataFrame, behaviors: DataFrame, edges: DataFrame, seen: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """Items that similar users liked; a similar user without a profile gives none."""
    liked = _scored(behaviors, USER_CHANNELS, ["user_id"]).select(F.col("user_id").alias("neighbor"), "item_id", "score")
    met = user_seeds(requests, edges, config).join(liked, "neighbor")
    found = met.select("request_id", "user_id", "most", "item_id", (F.col("similarity") * F.col("score")).alias("c"), "seed_order", F.col("neighbor").alias("trigger_id"))
    return _ranked(found, seen, config.user_multiplier)


def expanded(requests: DataFrame, config: ServingConfig) -> DataFrame:
    """Requests with the number of candidates that retrievers are asked for."""
    m = F.col("max_candidates")
    return requests.withColumn("max_candidates", F.when(m <= 0, m).otherwise(F.greatest(m, F.ceil(m * config.recall_ratio).cast(requests.schema["max_candidates"].dataType))))


def interleaved(requests: DataFrame, lists: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """request_id, item_id, position, retriever, retrieve_score, signals: retrievers' lists taken in turn.

    The first max_candidates distinct items stay; an item that comes again adds its signal, also once the list is full.
    """
    rows = None
    for turn, (name, found) in enumerate(lists):
        own = found.filter("item_id <> 0").withColumn("turn", F.lit(turn)).withColumn("retriever", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    signal = F.struct("position", "turn", "retriever", "retrieve_score", "trigger_id", "reason_score")
    merged = rows.groupBy("request_id", "item_id").agg(F.sort_array(F.collect_list(signal)).alias("xs"))
    merged = merged.withColumn("first", F.struct(F.col("xs")[0]["position"].alias("p"), F.col("xs")[0]["turn"].alias("t")))
    ranked = merged.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("first")))
    kept = ranked.join(requests.select("request_id", "max_candidates"), "request_id").filter("position <= max_candidates")
    names = F.array_join(F.array_distinct(F.filter(F.transform("xs", lambda x: x["retriever"]), lambda n: n != "")), ",")
    signals = F.transform("xs", lambda x: F.struct(x["retriever"].alias("retriever"), x["retrieve_score"].alias("retrieve_score"), x["trigger_id"].alias("trigger_id"), x["reason_score"].alias("reason_score")))
    return kept.select("request_id", "item_id", "position", names.alias("retriever"), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["retrieve_score"]).alias("retrieve_score"), signals.alias("signals"))


def orchestrate(requests: DataFrame, retrievers: dict[str, Retriever], config: ServingConfig = ServingConfig()) -> DataFrame:
    """Asks each named retriever for an expanded list and interleaves what they give.

    A retriever that can't be planned (a store that is missing, say) is left out with a warning; if none is left, its
    error is raised.
    """
    asked, lists, failed = expanded(requests, config), [], None
    for name, retrieve in retrievers.items():
        try:
            lists.append((name, retrieve(asked, config)))
        except Exception as error:
            warnings.warn(f"retriever {name} failed: {error}", stacklevel=2)
            failed = error
    if failed and not lists:
        raise failed
    return interleaved(requests, lists)


def described(candidates: DataFrame) -> DataFrame:
    """Each signal of each candidate with the sentence that explains it."""
    rows = candidates.select("request_id", "item_id", F.explode("signals").alias("s")).select("request_id", "item_id", "s.*")
    item = F.format_string("Retrieved from item_cf using trigger item %d.", "trigger_id")
    user = F.format_string("Retrieved from user_cf using similar user %d.", "trigger_id")
    return rows.withColumn("description", F.when(F.col("retriever") == ITEM_CF, item).when(F.col("retriever") == USER_CF, user))


def diagnostics(requests: DataFrame, behaviors: DataFrame, edges: DataFrame, seen: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """request_id, seeds, fetched and filtered: how many seeds a request has, neighbours they gave, and seen ones of those."""
    seeds = item_seeds(requests, behaviors, config).withColumn("most", _limit(config))
    e = edges.select(F.col("src").alias("item_id"), F.col("dst"), F.col("position").alias("place"))
    met = seeds.select("request_id", "user_id", "most", "item_id").join(e, "item_id").filter("place <= most")
    marked = met.join(seen.select("user_id", F.col("item_id").alias("dst"), F.lit(1).alias("hit")), ["user_id", "dst"], "left")
    fetched = marked.groupBy("request_id").agg(F.count("*").alias("fetched"), F.count("hit").alias("filtered"))
    counts = seeds.groupBy("request_id").agg(F.count("*").alias("seeds")).join(fetched, "request_id", "left")
    return counts.select("request_id", "seeds", F.coalesce("fetched", F.lit(0)).alias("fetched"), F.coalesce("filtered", F.lit(0)).alias("filtered"))


def user_diagnostics(requests: DataFrame, behaviors: DataFrame, edges: DataFrame, seen: DataFrame, users: DataFrame, config: ServingConfig = ServingConfig()) -> DataFrame:
    """request_id, neighbors, missing, user_fetched and user_filtered: similar users of each request, those without a
    profile (users: user_id of each), the items that the others liked, and seen ones of those."""
    near = user_seeds(requests, edges, config)
    known = users.select(F.col("user_id").alias("neighbor"), F.lit(1).alias("hit")).distinct()
    counts = near.join(known, "neighbor", "left").groupBy("request_id").agg(F.count("*").alias("neighbors"), F.count_if(F.col("hit").isNull()).alias("missing"))
    liked = _scored(behaviors, USER_CHANNELS, ["user_id"]).select(F.col("user_id").alias("neighbor"), "item_id")
    met = near.select("request_id", "user_id", "neighbor").join(liked, "neighbor").join(known.drop("hit"), "neighbor", "left_semi")
    marked = met.join(seen.select("user_id", "item_id", F.lit(1).alias("hit")), ["user_id", "item_id"], "left")
    fetched = marked.groupBy("request_id").agg(F.count("*").alias("user_fetched"), F.count("hit").alias("user_filtered"))
    return counts.join(fetched, "request_id", "left").na.fill(0, ["user_fetched", "user_filtered"])


def demo_scores(candidates: DataFrame, base: float = 1.0, step: float = 0.05) -> DataFrame:
    """Candidates (position from 1) with a retrieve_score that falls by step from base, 0.01 at least; for demonstrations."""
    return candidates.withColumn("retrieve_score", F.greatest(F.lit(0.01), F.lit(base) - (F.col("position") - 1) * step))
