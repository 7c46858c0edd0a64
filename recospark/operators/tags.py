"""Tags of items: evidence, document frequency and TF-IDF top tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recospark.config import TagConfig
from recospark.functions.text import normalize_tag


def evidence(tags: DataFrame, movies: DataFrame, ascii_only: bool = False) -> DataFrame:
    """movieId, tag, rows, users: uses of each normalised tag of an item in the catalogue, and its distinct users.

    A blank user counts as a row but as no user. The rows are persisted, as frequencies, counts and top tags each read
    them; a lost part is computed again from its lineage.
    """
    # Not a semi-join, which Spark would push below a repartition by item and so shuffle the tags twice.
    known = tags.join(movies.select("movieId").distinct(), "movieId")
    named = known.withColumn("tag", normalize_tag(F.col("tag"), ascii_only)).filter("tag <> ''")
    if not ascii_only:
        named = named.repartition("movieId")  # Spark takes rows from Python as dealt by nothing; one shuffle for both counts
    return named.groupBy("movieId", "tag").agg(F.count("*").alias("rows"), F.count_distinct(F.nullif(F.trim("userId"), F.lit(""))).alias("users")).persist()


def document_frequency(found: DataFrame) -> DataFrame:
    """tag, df: how many items a tag that has a user is on."""
    return found.filter("users > 0").groupBy("tag").agg(F.count("*").alias("df"))


def top_tags(found: DataFrame, config: TagConfig, normalized: bool = False) -> DataFrame:
    """movieId, tag, weight and rank of the tags that items keep, best first; normalized: weights relative to the best."""
    used = found.filter("users > 0")
    items = used.agg(F.greatest(F.count_distinct("movieId"), F.lit(1)).alias("items"))
    # The scalar is one row.
    scored = used.join(document_frequency(found), "tag").join(F.broadcast(items)).withColumn(
        "weight", (1 + F.log(F.greatest("users", F.lit(1)).cast("double"))) * (F.log((1.0 + F.col("items")) / (1.0 + F.col("df"))) + 1)
    )
    by_item = Window.partitionBy("movieId")
    order = by_item.orderBy(F.desc("weight"), F.desc("users"), "tag")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(config.top_k, 1))
    kept = ranked.withColumn("top", F.max("weight").over(by_item)).filter(
        (F.col("rank") == 1) | ((F.col("weight") >= config.min_weight) & (F.col("weight") >= F.col("top") * config.min_relative_weight))
    )
    weight = F.when(F.col("top") > 0, F.col("weight") / F.col("top")).otherwise(0.0) if normalized else F.round("weight", 4)
    return kept.select("movieId", "tag", weight.alias("weight"), F.row_number().over(by_item.orderBy("rank")).alias("rank"))
