"""Deterministic samples of an item's users: stable ranks, stratified caps and coverage anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recospark.config import UserSimilarityConfig
from recospark.operators.ratings import deduplicated

#: Fixed multipliers of the stable rank's hash.
ITEM_FACTOR, USER_FACTOR, FIRST_FACTOR, SECOND_FACTOR = 1000003, 9176, 0x7FEB352D, 0x846CA68B


def _times(x: Column, factor: int, bits: int) -> Column:
    """The low bits of a product that 64 bits may not hold; decimals stay exact and need no Python."""
    return ((x.cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)")) % F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("long")


def stable_rank(item: Column, user: Column) -> Column:
    """A 32-bit mixed number of an item and a user. Only the low bits of each step reach it, so higher ones are cut."""
    x = (item * F.lit(ITEM_FACTOR)).bitwiseXOR(user * F.lit(USER_FACTOR))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = _times(x, FIRST_FACTOR, 63)
    x = x.bitwiseXOR(F.shiftright(x, 15)).bitwiseAND(F.lit((1 << 48) - 1))
    x = _times(x, SECOND_FACTOR, 48)
    return x.bitwiseXOR(F.shiftright(x, 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def stratified(rows: DataFrame, size: int) -> DataFrame:
    """`size` users of each item, taken in turn from its weights, the heaviest first; all if it has no more.

    The k-th user of every weight comes before the (k+1)-th of any, so the turn is a rank by place, then by weight.
    """
    within = Window.partitionBy("movieId", "weight").orderBy("sample_rank", F.desc("timestamp"), "userId")
    turn = Window.partitionBy("movieId").orderBy("_k", F.desc("weight"))
    ranked = rows.withColumn("_k", F.row_number().over(within))
    if size > 0:
        # A user's turn is the place within its weight at least, so each weight is cut before an item's users come together.
        ranked = ranked.filter(F.col("_k") <= size)
    ranked = ranked.withColumn("_turn", F.row_number().over(turn))
    return (ranked.filter(F.col("_turn") <= size) if size > 0 else ranked).drop("_k", "_turn")


def anchors(valid: DataFrame, raw: DataFrame, count: int) -> DataFrame:
    """userId, movieId: for each user the `count` positive items that fewest rows of all users name."""
    popularity = raw.groupBy("movieId").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("userId").orderBy("rows", F.desc("weight"), F.desc("timestamp"), "sample_rank", "movieId")
    ranked = valid.join(popularity, "movieId").withColumn("sample_rank", stable_rank(F.col("movieId"), F.col("userId"))).withColumn("_n", F.row_number().over(order))
    return ranked.filter(F.col("_n") <= count).select("userId", "movieId").distinct()


def participants(valid: DataFrame, raw: DataFrame, config: UserSimilarityConfig) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows (movieId, userId, weight) that form an item's pairs: the capped sample; and, if anchors are asked for, the
    anchored users beyond it with the sample that they are paired with."""
    best = deduplicated(valid, "weight", "timestamp").withColumn("sample_rank", stable_rank(F.col("movieId"), F.col("userId")))
    many = best.groupBy("movieId").agg(F.count("*").alias("n")).filter(F.col("n") >= max(config.min_item_users, 2))
    ranked = best.join(many.select("movieId"), "movieId", "left_semi")
    if config.max_item_users == 1:
        ranked = ranked.limit(0)  # one user forms no pair
    sampled = stratified(ranked, config.max_item_users) if config.max_item_users > 0 else ranked
    if config.coverage_anchor_items_per_user <= 0 or config.max_item_users <= 0:
        return sampled, None, None
    anchored = ranked.join(anchors(valid, raw, config.coverage_anchor_items_per_user), ["userId", "movieId"], "left_semi")
    extra = anchored.join(sampled.select("userId", "movieId"), ["userId", "movieId"], "left_anti")
    baseline = stratified(ranked, max(config.max_item_users, config.coverage_pair_sample_size))
    return sampled, extra, baseline
