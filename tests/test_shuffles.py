"""What is shuffled by the queries that need most disk, and that results don't depend on how they keep it low."""

import contextlib
import io
import re

from recospark.config import ProfileConfig, UserSimilarityConfig
from recospark.operators import profiles, similarity
from recospark.operators import tags as T
from recospark.operators.ratings import weighted
from recospark.plans import catalog
from recospark.sources import adapters as A

SF = "/root/testdata/sf0.001"


def exchanges(frame):
    """The keys of each shuffle in a frame's first plan, without expression ids."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text.getvalue())]


def test_interests_stay_with_their_user(spark, monkeypatch):
    rated = weighted(A.ratings(spark, SF), ProfileConfig())
    best = T.top_tags(T.evidence(A.tags(spark, SF), A.movies(spark, SF), True), ProfileConfig().tags, normalized=True)
    few = profiles.ranked_interests(rated, A.movies(spark, SF), best, ProfileConfig(), A.items(spark, SF))
    assert sum(x.startswith("userId") for x in exchanges(few)) == 1
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(profiles, "BROADCAST_ITEMS", 0)
    many = profiles.ranked_interests(rated, A.movies(spark, SF), best, ProfileConfig())
    rounded = [str(r) for r in many.collect()]
    cut = re.compile(r"(\.\d{9})\d+")
    assert want and sorted(cut.sub(r"\1", x) for x in rounded) == sorted(cut.sub(r"\1", x) for x in want)


def test_tags_are_shuffled_once_by_item(spark):
    assert not any("tag" in x for x in exchanges(T.evidence(A.tags(spark, SF), A.movies(spark, SF), True).unpersist()))
    assert not any("tag" in x for x in exchanges(T.evidence(A.tags(spark, SF, dealt=False), A.movies(spark, SF)).unpersist()))


def test_coverage_in_rounds_gives_the_same_neighbours(spark, monkeypatch):
    config = UserSimilarityConfig(min_rating=3.5, use_rating_weight=True, max_item_users=4, coverage_anchor_items_per_user=2, coverage_pair_sample_size=8)
    ratings = A.ratings(spark, SF)
    want = sorted(map(tuple, similarity.user_similarity(ratings, config).select("src", "dst", "score", "cooccurrence", "position").collect()))
    monkeypatch.setattr(similarity, "ROUND_ROWS", 50)
    found = similarity.user_similarity(ratings, config)
    assert want and sorted(map(tuple, found.select("src", "dst", "score", "cooccurrence", "position").collect())) == want
    assert not exchanges(found)  # its shuffles are done with


def test_status_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(catalog, "ROUND_USERS", 60)
    found = catalog.QUERIES["recommend_status"](spark, SF).collect()
    assert len({r.user_id for r in found}) == len(found) == A.table(spark, SF, "customer").count()
    got = catalog.QUERIES["recommend"](spark, SF)
    assert not exchanges(got)  # its shuffles are done with
    n = {r.user_id: r["count"] for r in got.groupBy("user_id").count().collect()}
    assert n and all(n[r.user_id] == r.n_items for r in found if r.n_items)
