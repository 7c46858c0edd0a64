"""Row types of inputs and documents, and the codes of the enumerations."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

LONG, INT, DOUBLE, STRING = LongType(), IntegerType(), DoubleType(), StringType()


def _struct(**fields: DataType) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


def _list(**fields: DataType) -> ArrayType:
    return ArrayType(_struct(**fields))


RATINGS = _struct(userId=LONG, movieId=LONG, rating=DOUBLE, timestamp=LONG)
MOVIES = _struct(movieId=LONG, title=STRING, genres=STRING)
TAGS = _struct(userId=STRING, movieId=LONG, tag=STRING)
LINKS = _struct(movieId=LONG, imdbId=STRING, tmdbId=STRING)

ITEM_INDEX = _struct(
    item_id=LONG,
    title=STRING,
    title_raw=STRING,
    title_norm=STRING,
    year=INT,
    genres=ArrayType(STRING),
    tags=_struct(top_tags=_list(tag=STRING, weight=DOUBLE), tag_count=LONG, unique_tag_count=LONG),
    rating=_struct(avg=DOUBLE, count=LONG),
    search=_struct(tag_text=STRING, all_text=STRING),
    ext=_struct(imdb_id=STRING, tmdb_id=LONG),
)

_WEIGHTED = _list(item_id=LONG, weight=DOUBLE, event_time=LONG, source=INT, confidence=DOUBLE, raw_score=DOUBLE)
_GENRES = _list(genre=STRING, weight=DOUBLE, confidence=DOUBLE, update_time=LONG)
_TAGS = _list(tag=STRING, weight=DOUBLE, confidence=DOUBLE, update_time=LONG)
PROFILE = _struct(
    user_id=LONG,
    demographics=_struct(username=STRING, display_name=STRING, birth_year=INT, gender=STRING, location_id=INT),
    social=_struct(following=ArrayType(LONG), followers=ArrayType(LONG)),
    interests=_struct(genres=_GENRES, tags=_TAGS),
    negative_feedbacks=_struct(items=_WEIGHTED, genres=_GENRES, tags=_TAGS),
    behaviors=_struct(liked_items=_WEIGHTED, recent_liked_items=_WEIGHTED, interested_items=_WEIGHTED, rated_items=ArrayType(LONG)),
    embedding_sets=_list(embedding_id=STRING, description=STRING, vector=ArrayType(FloatType()), active=BooleanType()),
    stats=_struct(
        rating_count=LONG,
        positive_rating_count=LONG,
        weak_positive_rating_count=LONG,
        negative_rating_count=LONG,
        avg_rating=DOUBLE,
        rating_stddev=DOUBLE,
        first_event_time=LONG,
        last_event_time=LONG,
        active_timeframe=LONG,
        profile_confidence=DOUBLE,
        interest_entropy=DOUBLE,
    ),
)


def similarity(id_field: str, text: bool = False) -> StructType:
    """Adjacency rows of an entity: item_id or user_id, and its neighbours; text: ids and numbers as text."""
    number, score = (STRING, STRING) if text else (LONG, DOUBLE)
    return _struct(**{id_field: number, "neighbors": _list(**{id_field: number, "score": score, "cooccurrence": number})})


# Fixed codes.
ENTITY_ITEM, ENTITY_USER = 1, 6
REASON_USER_CF, REASON_ITEM_CF = 1, 2
FACTOR_RETRIEVAL, FACTOR_INTEREST, FACTOR_NEGATIVE, FACTOR_QUALITY = 1, 2, 3, 4
SOURCE_RATING = 1
GATEWAY = {"SUCCESS": 0, "USER_NOT_FOUND": 1, "INVALID_REQUEST": 2, "SYSTEM_ERROR": 3}
RETRIEVER_OK, RETRIEVER_EMPTY_SEEDS = 0, 4
RANKING_OK, RANKING_EMPTY = 0, 4
