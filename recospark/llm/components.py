"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import checkpoint, release


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to the least vertex among itself and its neighbours."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex ties itself and its smaller neighbours to the least of them; links lead from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def stars(links: DataFrame) -> DataFrame:
    """(u, v) for each vertex u of the links (u, v) that isn't the least of its component; v is that least vertex.

    Each round is written to the shared checkpoint folder. Only the number of links and a checksum come to the driver.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    links, before = checkpoint(links), None
    while True:
        said = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == before or not said[0]:
            return links
        before = said
        links = checkpoint(_small_star(_large_star(links)))
        release(links.sparkSession)
