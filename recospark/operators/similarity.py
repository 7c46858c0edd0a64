"""Item and user neighbours from co-occurring positive ratings.

A score is the sum of a pair's weight products over the root of both norms. Norms and support count raw positive rows,
pairs the deduplicated and capped ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recospark.config import ItemSimilarityConfig, SimilarityConfig, UserSimilarityConfig
from recospark.operators import rounds, sampling
from recospark.operators.ratings import deduplicated, positives


def norms(rows: DataFrame, key: str) -> DataFrame:
    """key, norm (sum of squared weights) and n (rows) over raw positive rows."""
    return rows.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"), F.count("*").alias("n"))


def capped_items(rows: DataFrame, config: ItemSimilarityConfig) -> DataFrame:
    """Each user's strongest deduplicated positive items, max_user_items of them."""
    best = deduplicated(rows, "weight", "timestamp")
    if config.max_user_items <= 0:
        return best
    order = Window.partitionBy("userId").orderBy(F.desc("weight"), F.desc("timestamp"), "movieId")
    return best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= config.max_user_items).drop("_n")


def pairs(left: DataFrame, right: DataFrame, shared: str, of: str, canonical: bool = False) -> DataFrame:
    """l < r, w (product of weights): pairs of `of` that meet in a row of `shared`.

    canonical: both sides may hold either end, so a pair is put in order after it is formed.
    """
    a = left.select(shared, F.col(of).alias("a"), F.col("weight").alias("wa"))
    b = right.select(shared, F.col(of).alias("b"), F.col("weight").alias("wb"))
    met = a.join(b, shared)
    if not canonical:
        return met.filter("a < b").select(F.col("a").alias("l"), F.col("b").alias("r"), (F.col("wa") * F.col("wb")).alias("w"))
    return met.filter("a <> b").select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), (F.col("wa") * F.col("wb")).alias("w"))


def reduced(met: DataFrame) -> DataFrame:
    """l, r, weight (sum) and cooccurrence of each pair."""
    return met.groupBy("l", "r").agg(F.sum("w").alias("weight"), F.count("*").alias("cooccurrence"))


def neighbors(met: DataFrame, norm: DataFrame, key: str, config: SimilarityConfig) -> DataFrame:
    """src, dst, score (8 digits), cooccurrence, position: the top_k neighbours of each entity."""
    kept = reduced(met).filter(F.col("cooccurrence") >= config.min_cooccurrence)
    n = norm.select(F.col(key).alias("k"), "norm")
    scored = kept.join(n.toDF("l", "nl"), "l").join(n.toDF("r", "nr"), "r").withColumn("raw", F.col("weight") / F.sqrt(F.col("nl") * F.col("nr")))
    scored = scored.filter(F.col("raw") >= config.min_similarity).withColumn("score", F.round("raw", 8))
    ends = F.explode(F.array(F.struct(F.col("l").alias("src"), F.col("r").alias("dst")), F.struct(F.col("r").alias("src"), F.col("l").alias("dst")))).alias("e")
    both = scored.select(ends, "score", "cooccurrence").select("e.src", "e.dst", "score", "cooccurrence")
    order = Window.partitionBy("src").orderBy(F.desc("score"), F.desc("cooccurrence"), "dst")
    return both.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= config.top_k)


def item_similarity(ratings: DataFrame, config: ItemSimilarityConfig = ItemSimilarityConfig()) -> DataFrame:
    """Item neighbours as rows src, dst, score, cooccurrence, position."""
    rows = positives(ratings, config)
    norm = norms(rows, "movieId").filter((F.col("n") >= config.min_item_users) & (F.col("norm") > 0))
    capped = capped_items(rows.join(norm.select("movieId"), "movieId", "left_semi"), config)
    return neighbors(pairs(capped, capped, "userId", "movieId"), norm, "movieId", config)


def user_similarity(ratings: DataFrame, config: UserSimilarityConfig = UserSimilarityConfig()) -> DataFrame:
    """User neighbours as rows src, dst, score, cooccurrence, position."""
    rows = positives(ratings, config)
    norm = norms(rows, "userId").filter((F.col("n") >= config.min_user_items) & (F.col("norm") > 0))
    valid = rows.join(norm.select("userId"), "userId", "left_semi")
    sampled, extra, baseline = sampling.participants(valid, rows, config)
    if extra is None:
        return neighbors(pairs(sampled, sampled, "movieId", "userId"), norm, "userId", config)
    # Kept apart, as each round reads them anew: 0 for the sample, 1 for anchored users beyond it, 2 for their partners.
    sides = [side.select("movieId", "userId", "weight", F.lit(i).alias("side")) for i, side in enumerate((sampled, extra, baseline))]
    named = sides[0].union(sides[1]).union(sides[2]).join(norm.select("userId", "norm"), "userId")
    kept = rounds.materialise(named)
    n = rounds.number(rounds.rows_of(kept), ROUND_ROWS)
    return rounds.by_round(kept.sparkSession, n, lambda r: _near(kept, n, r, config), kept)


#: Rows of participants (user, item) whose pairs are formed in one round, about.
ROUND_ROWS = 200_000


def _near(participants: DataFrame, n: int, r: int, config: UserSimilarityConfig) -> DataFrame:
    """neighbors() of one in n users, src: each pair is formed from its src, so all that a user needs comes together once."""
    own, other = (participants.select("movieId", F.col("userId").alias(u), F.col("weight").alias(w), F.col("norm").alias(m), F.col("side").alias(s)) for u, w, m, s in (("src", "ws", "ns", "a"), ("dst", "wd", "nd", "b")))
    own = own.filter(rounds.part("src", n) == r)
    met = own.join(other, "movieId").filter("src <> dst and (a = 0 and b = 0 or a = 1 and b = 2 or a = 2 and b = 1)")
    met = met.select("src", "dst", (F.col("ws") * F.col("wd")).alias("w"), (F.col("ns") * F.col("nd")).alias("norms"))
    kept = met.groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.count("*").alias("cooccurrence"), F.first("norms").alias("norms")).filter(F.col("cooccurrence") >= config.min_cooccurrence)
    raw = F.col("weight") / F.sqrt("norms")
    scored = kept.filter(raw >= config.min_similarity).select("src", "dst", F.round(raw, 8).alias("score"), "cooccurrence")
    order = Window.partitionBy("src").orderBy(F.desc("score"), F.desc("cooccurrence"), "dst")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= config.top_k)


def adjacency(edges: DataFrame, id_field: str) -> DataFrame:
    """Neighbour rows as documents: an entity and its neighbours in order of position."""
    listed = F.sort_array(F.collect_list(F.struct("position", F.col("dst").alias(id_field), "score", "cooccurrence")))
    inner = F.transform(listed, lambda x: F.struct(x[id_field].alias(id_field), x["score"].alias("score"), x["cooccurrence"].alias("cooccurrence")))
    return edges.groupBy(F.col("src").alias(id_field)).agg(inner.alias("neighbors"))
