"""Profiles kept fresh from a stream of ratings: each micro-batch rebuilds the profiles of the users that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recospark.config import ProfileConfig
from recospark.operators import profiles


def refresh(batch: DataFrame, history: DataFrame, movies: DataFrame, tags: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Profiles of the users in batch, from their ratings in history, which holds the batch's rows too."""
    touched = history.join(batch.select("userId").distinct(), "userId", "left_semi")
    return profiles.build(touched, movies, tags, config)


def start(ratings: DataFrame, store: str, output: str, movies: DataFrame, tags: DataFrame, checkpoint: str, config: ProfileConfig = ProfileConfig()) -> StreamingQuery:
    """Starts a query that appends each batch of ratings to the Parquet store and writes the touched profiles.

    Profiles of a batch go to output/batch=<number>, overwritten if the batch runs again, as are its rows in the store.
    """
    spark = ratings.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        history = spark.read.parquet(store).drop("batch")
        refresh(rows, history, movies, tags, config).write.mode("overwrite").parquet(f"{output}/batch={number}")
        rows.unpersist()

    return ratings.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()
