"""Ratings: positive weights, deduplication, bands and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recospark.config import ProfileConfig, SimilarityConfig


def positives(ratings: DataFrame, config: SimilarityConfig) -> DataFrame:
    """userId, movieId, weight, timestamp of the ratings that count as positive."""
    weight = F.col("rating") - config.positive_weight_offset if config.use_rating_weight else F.lit(1.0)
    rows = ratings.filter(F.col("rating") >= config.min_rating).select("userId", "movieId", weight.alias("weight"), "timestamp")
    return rows.filter("weight > 0")


def deduplicated(ratings: DataFrame, *best: str) -> DataFrame:
    """One row for each user and item: the greatest by the given columns in turn."""
    order = Window.partitionBy("userId", "movieId").orderBy(*(F.desc(c) for c in best))
    return ratings.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def rating_stats(ratings: DataFrame) -> DataFrame:
    """movieId, avg (4 digits) and count of each item's ratings."""
    return ratings.groupBy("movieId").agg(F.round(F.avg("rating"), 4).alias("avg"), F.count("*").alias("count"))


def _ramp(ratio: Column, low: float, high: float = 1.0) -> Column:
    return F.lit(low) + F.lit(high - low) * F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))


def weighted(ratings: DataFrame, config: ProfileConfig) -> DataFrame:
    """Deduplicated ratings with their band (positive, weak, negative or neutral) and weight, recency included.

    A band's weight rises over its range and decays with the age of the event against the user's latest one.
    """
    rows = deduplicated(ratings.repartition("userId"), "timestamp", "rating")  # one shuffle for both windows
    r, c = F.col("rating"), config
    band = F.when(r >= c.positive_min_rating, "positive").when(r >= c.weak_positive_min_rating, "weak").when(r <= c.negative_max_rating, "negative").otherwise("neutral")
    base = (
        F.when(F.col("band") == "positive", _ramp((r - c.positive_min_rating) / (c.max_rating - c.positive_min_rating), c.positive_min_weight))
        .when(F.col("band") == "weak", _ramp((r - c.weak_positive_min_rating) / (c.positive_min_rating - c.weak_positive_min_rating), c.weak_min_weight, c.weak_max_weight))
        .when(F.col("band") == "negative", _ramp((c.negative_max_rating - r) / (c.negative_max_rating - c.min_rating), c.negative_min_weight))
    )
    age = (F.max("timestamp").over(Window.partitionBy("userId")) - F.col("timestamp")) / F.lit(86400.0)
    recency = F.lit(c.recency_floor) + F.lit(1 - c.recency_floor) * F.pow(F.lit(0.5), age / F.lit(c.recency_half_life_days)) if c.recency_half_life_days > 0 else F.lit(1.0)
    return rows.withColumn("band", band).withColumn("weight", base * recency)
