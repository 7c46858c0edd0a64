"""User profiles: behaviour lists, interests, negative feedback and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recospark.config import ProfileConfig
from recospark.functions.text import parse_genres
from recospark.operators import tags as T
from recospark.operators.ratings import weighted
from recospark.schemas import PROFILE, SOURCE_RATING

#: Behaviour lists: the band they show, whether the latest come first, and the setting of their length.
LISTS = {
    "liked_items": ("positive", False, "max_liked_items"),
    "recent_liked_items": ("positive", True, "max_recent_liked_items"),
    "interested_items": ("weak", False, "max_interested_items"),
    "negative_items": ("negative", False, "max_negative_items"),
}

#: What a table holds of so many items at most is broadcast: some 300 bytes of names each.
BROADCAST_ITEMS = 500_000


def is_small(items: DataFrame) -> bool:
    """Whether there are BROADCAST_ITEMS rows at most."""
    return items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS


def _first(rows: DataFrame, order: list, limit: int, by: str = "userId") -> DataFrame:
    """Rows with their position in each user's order, the first `limit` of them (all, if it is 0 or less)."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("position") <= limit) if limit > 0 else ranked


def behavior_list(rated: DataFrame, name: str, config: ProfileConfig) -> DataFrame:
    """A behaviour list as rows: userId, position, item_id, weight, event_time, source, confidence, raw_score."""
    band, recent, limit = LISTS[name]
    rows = rated.filter(F.col("band") == band).select(
        "userId",
        F.col("movieId").alias("item_id"),
        F.round("weight", 6).alias("weight"),
        F.col("timestamp").alias("event_time"),
        F.lit(SOURCE_RATING).alias("source"),
        F.round(F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"),
        F.round("rating", 6).alias("raw_score"),
    )
    by = [F.desc("event_time"), F.desc("weight")] if recent else [F.desc("weight"), F.desc("event_time")]
    return _first(rows, [*by, "item_id"], getattr(config, limit))


def rated_items(rated: DataFrame, config: ProfileConfig) -> DataFrame:
    """userId, position, item_id of what users rated, the latest first."""
    rows = rated.select("userId", F.col("movieId").alias("item_id"), "timestamp", "rating")
    return _first(rows, [F.desc("timestamp"), F.desc("rating"), "item_id"], config.max_rated_items).select("userId", "position", "item_id")


def placed(rated: DataFrame, config: ProfileConfig) -> DataFrame:
    """Each rating with `places`: its entries (list, position) in its user's lists, rated_items among them.

    All lists are read off three orders of one partitioning by user, so that none is shuffled by itself.
    """
    of_band = Window.partitionBy("userId", "band")
    event, weight = F.col("timestamp"), F.round("weight", 6)
    orders = {
        "_strong": of_band.orderBy(F.desc(weight), F.desc(event), "movieId"),
        "_recent": of_band.orderBy(F.desc(event), F.desc(weight), "movieId"),
        "_rated": Window.partitionBy("userId").orderBy(F.desc(event), F.desc("rating"), "movieId"),
    }
    entries = []
    for name, (band, recent, limit) in LISTS.items():
        entries.append((name, F.col("band") == band, "_recent" if recent else "_strong", getattr(config, limit)))
    entries.append(("rated_items", F.lit(True), "_rated", config.max_rated_items))

    def entry(name, of, order, limit):
        within = of & (F.col(order) <= limit) if limit > 0 else of
        return F.when(within, F.struct(F.lit(name).alias("list"), F.col(order).alias("position")))

    rows = rated.withColumns({name: F.row_number().over(order) for name, order in orders.items()})
    return rows.withColumn("places", F.array_compact(F.array(*(entry(*e) for e in entries)))).drop(*orders)


def behavior_rows(rated: DataFrame, config: ProfileConfig) -> DataFrame:
    """userId, list, position, item_id, weight of all lists, rated_items among them."""
    rows = placed(rated, config).select("userId", F.col("movieId").alias("item_id"), F.round("weight", 6).alias("weight"), F.explode("places").alias("x"))
    return rows.select("userId", "x.list", "x.position", "item_id", "weight")


def genre_scores(rated: DataFrame, movies: DataFrame, band: str) -> DataFrame:
    """userId, name, score, support, update_time: a band's weights shared among the genres of its items."""
    genres = movies.select("movieId", parse_genres(F.col("genres")).alias("genres"))
    rows = rated.filter(F.col("band") == band).join(genres, "movieId")
    shares = rows.select("userId", "timestamp", (F.col("weight") / F.greatest(F.size("genres"), F.lit(1))).alias("share"), F.explode("genres").alias("name"))
    return shares.groupBy("userId", "name").agg(F.sum("share").alias("score"), F.count("*").alias("support"), F.max("timestamp").alias("update_time"))


def tag_scores(rated: DataFrame, top_tags: DataFrame, band: str) -> DataFrame:
    """The same for tags, by the weights that items give them."""
    rows = rated.filter(F.col("band") == band).join(top_tags.select("movieId", F.col("tag").alias("name"), F.col("weight").alias("tag_weight")), "movieId")
    return rows.groupBy("userId", "name").agg(F.sum(F.col("weight") * F.col("tag_weight")).alias("score"), F.count("*").alias("support"), F.max("timestamp").alias("update_time"))


def interests(scores: DataFrame, limit: int, config: ProfileConfig) -> DataFrame:
    """userId, position, name, weight, confidence, update_time: scores relative to each user's best, the first `limit`."""
    top = F.max("score").over(Window.partitionBy("userId"))
    rows = scores.select(
        "userId",
        "name",
        F.round(F.when(top > 0, F.col("score") / top).otherwise(0.0), 6).alias("weight"),
        F.round(F.least(F.col("support") / F.lit(float(max(config.interest_confidence_support, 1))), F.lit(1.0)), 6).alias("confidence"),
        "update_time",
    )
    return _first(rows, [F.desc("weight"), F.desc("confidence"), "name"], limit)


def entropy(scores: DataFrame) -> DataFrame:
    """userId, interest_entropy: the evenness of positive genre scores, 0 to 1."""
    share = F.col("score") / F.sum("score").over(Window.partitionBy("userId"))
    rows = scores.filter("score > 0").select("userId", share.alias("p"))
    total = rows.groupBy("userId").agg(F.sum(-F.col("p") * F.log("p")).alias("h"), F.count("*").alias("k"))
    return total.select("userId", F.when(F.col("k") > 1, F.round(F.col("h") / F.log(F.col("k").cast("double")), 6)).otherwise(0.0).alias("interest_entropy"))


def _names(movies: DataFrame, top_tags: DataFrame, items: DataFrame) -> DataFrame:
    """movieId, names, factors (what shares a weight's part) and n_genres: genres, then tags of each of the items that has any."""
    genres = movies.select("movieId", parse_genres(F.col("genres")).alias("genres"))
    genres = genres.select("movieId", F.lit("genre").alias("kind"), F.greatest(F.size("genres"), F.lit(1)).cast("double").alias("factor"), F.explode("genres").alias("name"))
    names = genres.unionByName(top_tags.select("movieId", F.lit("tag").alias("kind"), F.col("weight").cast("double").alias("factor"), F.col("tag").alias("name")))
    listed = names.join(items, "movieId", "left_semi").groupBy("movieId").agg(F.sort_array(F.collect_list(F.struct("kind", "name", "factor"))).alias("xs"))
    n_genres = F.size(F.filter("xs", lambda x: x["kind"] == "genre"))
    return listed.select("movieId", F.transform("xs", lambda x: x["name"]).alias("names"), F.transform("xs", lambda x: x["factor"]).alias("factors"), n_genres.alias("n_genres"))


def ranked_interests(rated: DataFrame, movies: DataFrame, top_tags: DataFrame, config: ProfileConfig, items: DataFrame | None = None) -> DataFrame:
    """Interests of all kinds (genre, tag) and bands (positive, negative) at once.

    userId, kind, band, position, name, weight, confidence, update_time as interests() has them, `kept` for those within
    their list's length, and `share`, a positive genre's part of the user's positive scores as in entropy().
    items: movieId of all that are rated at least, each once. The names of up to BROADCAST_ITEMS are broadcast, so that
    ratings stay with their user; those of more meet ratings by item, and both go to the user before names are listed.
    """
    items = rated.select("movieId").distinct() if items is None else items
    names = _names(movies, top_tags, items)
    rows = rated.filter(F.col("band").isin("positive", "negative")).select("userId", "movieId", "band", "weight", "timestamp")
    rows = rows.join(F.broadcast(names), "movieId") if is_small(items) else rows.join(names, "movieId").repartition("userId")
    rows = rows.select("userId", "band", "weight", "timestamp", "factors", "n_genres", F.posexplode("names").alias("place", "name"))
    rows = rows.withColumn("kind", F.when(F.col("place") < F.col("n_genres"), "genre").otherwise("tag")).withColumn("factor", F.get("factors", F.col("place")))
    part = F.when(F.col("kind") == "genre", F.col("weight") / F.col("factor")).otherwise(F.col("weight") * F.col("factor"))
    scores = rows.groupBy("userId", "band", "kind", "name").agg(F.sum(part).alias("score"), F.count("*").alias("support"), F.max("timestamp").alias("update_time"))
    own = Window.partitionBy("userId", "band", "kind")
    top, total = F.max("score").over(own), F.sum(F.when(F.col("score") > 0, F.col("score"))).over(own)
    liked = (F.col("kind") == "genre") & (F.col("band") == "positive") & (F.col("score") > 0)
    rows = scores.select(
        "userId",
        "kind",
        "band",
        "name",
        F.round(F.when(top > 0, F.col("score") / top).otherwise(0.0), 6).alias("weight"),
        F.round(F.least(F.col("support") / F.lit(float(max(config.interest_confidence_support, 1))), F.lit(1.0)), 6).alias("confidence"),
        "update_time",
        F.when(liked, F.col("score") / total).alias("share"),
    )
    rows = rows.withColumn("position", F.row_number().over(own.orderBy(F.desc("weight"), F.desc("confidence"), "name")))
    kept = F.lit(False)
    for kind, band, limit in (
        ("genre", "positive", config.top_genres),
        ("tag", "positive", config.top_tags),
        ("genre", "negative", config.top_negative_genres),
        ("tag", "negative", config.top_negative_tags),
    ):
        within = (F.col("kind") == kind) & (F.col("band") == band)
        kept = kept | (within & (F.col("position") <= limit) if limit > 0 else within)
    return rows.withColumn("kept", kept)


def _stats(config: ProfileConfig) -> list[Column]:
    full = F.log1p(F.lit(float(max(config.profile_confidence_rating_count, 1))))

    def count(band):
        return F.count_if(F.col("band") == band)

    return [
        F.count("*").alias("rating_count"),
        count("positive").alias("positive_rating_count"),
        count("weak").alias("weak_positive_rating_count"),
        count("negative").alias("negative_rating_count"),
        F.round(F.avg("rating"), 6).alias("avg_rating"),
        F.round(F.stddev_pop("rating"), 6).alias("rating_stddev"),
        F.min("timestamp").alias("first_event_time"),
        F.max("timestamp").alias("last_event_time"),
        (F.max("timestamp") - F.min("timestamp")).alias("active_timeframe"),
        F.round(F.least(F.log1p(F.count("*").cast("double")) / full, F.lit(1.0)), 6).alias("profile_confidence"),
    ]


def user_stats(rated: DataFrame, config: ProfileConfig) -> DataFrame:
    """Counts by band, mean and deviation of ratings, times and confidence of each user."""
    return rated.groupBy("userId").agg(*_stats(config))


def _listed(when: Column, fields: dict[str, Column], name: str, position: Column) -> Column:
    """A group's rows that fulfil the condition, in order of position, as an array of structs (of values, if one field)."""
    ordered = F.sort_array(F.collect_list(F.when(when, F.struct(position.alias("position"), *(v.alias(k) for k, v in fields.items())))))
    inner = F.transform(ordered, lambda x: F.struct(*(x[f].alias(f) for f in fields)) if len(fields) > 1 else x[next(iter(fields))])
    return inner.alias(name)


def build(ratings: DataFrame, movies: DataFrame, tags: DataFrame, config: ProfileConfig = ProfileConfig(), ascii_only: bool = False, items: DataFrame | None = None) -> DataFrame:
    """One document for each user with a rating, as in schemas.PROFILE.

    Statistics and behaviour lists come from one aggregate over the ratings by user, interests from another; both read
    one shuffle of the ratings. items: as in ranked_interests.
    """
    rated = weighted(ratings, config)
    top_tags = T.top_tags(T.evidence(tags, movies, ascii_only), config.tags, normalized=True)
    fields = {
        "item_id": F.col("movieId"),
        "weight": F.round("weight", 6),
        "event_time": F.col("timestamp"),
        "source": F.lit(SOURCE_RATING),
        "confidence": F.round(F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)), 6),
        "raw_score": F.round("rating", 6),
    }

    def listed(name: str, fields: dict[str, Column]) -> Column:
        place = F.get(F.filter("places", lambda x: x["list"] == name), F.lit(0))["position"]
        return _listed(place.isNotNull(), fields, name, place)

    lists = [listed(name, fields) for name in LISTS] + [listed("rated_items", {"item_id": F.col("movieId")})]
    parts = placed(rated, config).groupBy("userId").agg(*_stats(config), *lists)

    def of(name: str, kind: str, band: str) -> Column:
        wanted = F.col("kept") & (F.col("kind") == kind) & (F.col("band") == band)
        return _listed(wanted, {kind: F.col("name"), **{f: F.col(f) for f in ("weight", "confidence", "update_time")}}, name, F.col("position"))

    items = ratings.select("movieId").distinct() if items is None else items
    found = ranked_interests(rated, movies, top_tags, config, items).groupBy("userId").agg(
        of("genres", "genre", "positive"),
        of("tags", "tag", "positive"),
        of("negative_genres", "genre", "negative"),
        of("negative_tags", "tag", "negative"),
        F.sum(-F.col("share") * F.log("share")).alias("_h"),
        F.count("share").alias("_k"),
    )
    parts = parts.join(found, "userId", "left")
    parts = parts.withColumn("interest_entropy", F.when(F.col("_k") > 1, F.round(F.col("_h") / F.log(F.col("_k").cast("double")), 6)).otherwise(0.0))

    def typed(field: str, value):
        return value.cast(PROFILE[field].dataType).alias(field)

    def items(name: str):
        return F.coalesce(name, F.array().cast(parts.schema[name].dataType)).alias(name.removeprefix("negative_"))

    def named(template: str):
        return F.replace(F.lit(template), F.lit("{user_id}"), F.col("userId").cast("string"))

    stats = PROFILE["stats"].dataType.fieldNames()
    return parts.select(
        F.col("userId").alias("user_id"),
        typed("demographics", F.struct(named(config.username_template), named(config.display_name_template), F.lit(0), F.lit(""), F.lit(0))),
        typed("social", F.struct(F.array(), F.array())),
        typed("interests", F.struct(items("genres"), items("tags"))),
        typed("negative_feedbacks", F.struct(*(items(f"negative_{n}") for n in ("items", "genres", "tags")))),
        typed("behaviors", F.struct(*(items(n) for n in ("liked_items", "recent_liked_items", "interested_items", "rated_items")))),
        typed("embedding_sets", F.array()),
        typed("stats", F.struct(*stats)),
    )
