"""Ratings, movies, tags and links derived from the driver's star schema.

Keys start at 0 there, and id 0 is invalid here, so 1 is added to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def ratings(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    """userId, movieId, rating (half steps from 0.5 to 5) and timestamp (seconds) of what customers bought."""
    return _sales(spark, sf_dir).select(
        (F.col("o_custkey") + 1).alias("userId"),
        (F.col(item) + 1).alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) / F.lit(2.0)).cast("double").alias("rating"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, title and pipe-separated genres of parts."""
    key = F.col("p_partkey")
    title = F.concat(F.col("p_name"), F.when(key % 3 == 0, ", The").otherwise(""), F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(" ("), 1980 + F.col("p_size"), F.lit(")"))))
    genres = F.when(key % 11 == 0, "(no genres listed)").otherwise(F.concat_ws("|", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select((key + 1).alias("movieId"), title.alias("title"), genres.alias("genres"))


def items(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    """movieId of all items that ratings() may have, each once."""
    return table(spark, sf_dir, "lineitem").select((F.col(item) + 1).alias("movieId")).distinct()


def tags(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """userId (text), movieId and tag: buyers' market segments and order priorities.

    Orders get their segments before they meet their lines. dealt: lines are dealt by item before their tags are listed,
    so that what is counted by item is not shuffled again; of no use to what sends tags through Python first.
    """
    customers = table(spark, sf_dir, "customer").groupBy("c_custkey").agg(F.collect_list("c_mktsegment").alias("segments"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    named = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    named = named.select("o_orderkey", "o_custkey", F.concat(F.coalesce("segments", F.array().cast("array<string>")), F.array("o_orderpriority")).alias("tags"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    sales = lines.join(named, lines.l_orderkey == named.o_orderkey).select("o_custkey", (F.col("l_partkey") + 1).alias("movieId"), "tags")
    sales = sales.repartition("movieId") if dealt else sales
    return sales.select((F.col("o_custkey") + 1).cast("string").alias("userId"), "movieId", F.explode("tags").alias("tag"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId and external ids as text, some of them blank or no number."""
    key = F.col("p_partkey")
    text = key.cast("string")
    return table(spark, sf_dir, "part").select(
        (key + 1).alias("movieId"), F.when(key % 5 == 0, "").otherwise(text).alias("imdbId"), F.when(key % 4 == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("tmdbId")
    )
