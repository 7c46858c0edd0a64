"""Settings of the builders and of serving, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, replace


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class TagConfig:
    """How many tags an item keeps, and what weight a tag after the first needs, absolute and relative to the first."""

    top_k: int = 10
    min_weight: float = 0.0
    min_relative_weight: float = 0.3


@dataclass(frozen=True)
class ProfileConfig:
    """Rating bands, weights, recency decay and list lengths of user profiles; a length of 0 or less is no limit."""

    positive_min_rating: float = 4.0
    weak_positive_min_rating: float = 3.0
    negative_max_rating: float = 2.0
    max_rating: float = 5.0
    min_rating: float = 0.5
    positive_min_weight: float = 0.75
    weak_min_weight: float = 0.25
    weak_max_weight: float = 0.65
    negative_min_weight: float = 0.4
    recency_half_life_days: float = 365.0
    recency_floor: float = 0.2
    max_liked_items: int = 100
    max_recent_liked_items: int = 30
    max_interested_items: int = 50
    max_rated_items: int = 300
    max_negative_items: int = 50
    top_genres: int = 10
    top_tags: int = 30
    top_negative_genres: int = 10
    top_negative_tags: int = 20
    tags: TagConfig = TagConfig()
    interest_confidence_support: int = 5
    profile_confidence_rating_count: int = 50
    username_template: str = "user_{user_id}"
    display_name_template: str = "User {user_id}"

    def __post_init__(self) -> None:
        _need(self.max_rating > self.positive_min_rating > self.weak_positive_min_rating > self.negative_max_rating > self.min_rating, "rating bands must ascend")
        _need(0 <= self.recency_floor <= 1, "recency_floor must be between 0 and 1")


@dataclass(frozen=True)
class SimilarityConfig:
    """Thresholds that item and user similarity share."""

    min_rating: float = 4.0
    use_rating_weight: bool = False
    positive_weight_offset: float = 3.0
    min_cooccurrence: int = 3
    min_similarity: float = 0.0
    top_k: int = 100

    def __post_init__(self) -> None:
        _need(self.top_k > 0, "top_k must be positive")
        _need(self.min_cooccurrence > 0, "min_cooccurrence must be positive")


@dataclass(frozen=True)
class ItemSimilarityConfig(SimilarityConfig):
    """Item similarity: items of a user that form pairs (0 or less: all), and rows an item needs."""

    max_user_items: int = 300
    min_item_users: int = 5

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.min_item_users > 0, "min_item_users must be positive")


@dataclass(frozen=True)
class UserSimilarityConfig(SimilarityConfig):
    """User similarity: users of an item that form pairs (0 or less: all), and the coverage extension."""

    min_cooccurrence: int = 2
    top_k: int = 10
    min_user_items: int = 5
    min_item_users: int = 2
    max_item_users: int = 30
    coverage_anchor_items_per_user: int = 0
    coverage_pair_sample_size: int = 0

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.min_user_items > 0, "min_user_items must be positive")
        _need(self.min_item_users > 0, "min_item_users must be positive")
        _need(self.coverage_anchor_items_per_user >= 0, "coverage_anchor_items_per_user must not be negative")
        _need(self.coverage_pair_sample_size >= 0, "coverage_pair_sample_size must not be negative")


@dataclass(frozen=True)
class ServingConfig:
    """Retrieval and ranking of requests."""

    recall_ratio: float = 1.0
    max_item_seeds: int = 24
    max_user_seeds: int = 10
    item_multiplier: float = 1.0
    user_multiplier: float = 1.0
    default_candidates: int = 10
    retrieval_weight: float = 1.0
    interest_weight: float = 1.0
    negative_weight: float = 1.0
    quality_weight: float = 0.1

    def __post_init__(self) -> None:
        _need(self.max_item_seeds > 0 and self.max_user_seeds > 0, "seed limits must be positive")


@dataclass(frozen=True)
class FixtureConfig:
    """How many users a fixture has, and how many of what they are chosen from and shown with."""

    target_users: int = 10
    pool_size: int = 2500
    max_neighbors: int = 10
    max_seeds: int = 24
    max_candidates: int = 20

    def __post_init__(self) -> None:
        _need(min(self.target_users, self.pool_size, self.max_neighbors, self.max_seeds, self.max_candidates) > 0, "the fixture's numbers must be positive")


#: Settings of the production jobs.
PRODUCTION_ITEMS = ItemSimilarityConfig(min_rating=3.5, use_rating_weight=True)
PRODUCTION_USERS = UserSimilarityConfig(
    min_rating=3.5, use_rating_weight=True, max_item_users=100, coverage_anchor_items_per_user=3, coverage_pair_sample_size=300, top_k=50
)
PRODUCTION_SERVING = ServingConfig(recall_ratio=2.0, item_multiplier=0.8, user_multiplier=8.0)


def overlaid(config, **settings):
    """A config with other settings; an unknown name is an error."""
    unknown = set(settings) - set(config.__dataclass_fields__)
    _need(not unknown, f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(config, **settings)
