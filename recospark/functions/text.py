"""String functions on titles, genres, tags and external ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(c: Column, ascii_only: bool = False) -> Column:
    """Compatibility composition, which Spark has no function for; only texts beyond ASCII are sent to Python.

    ascii_only: the texts are known to be ASCII, so the plan has no Python at all.
    """
    return c if ascii_only else F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_spaces(c: Column) -> Column:
    """Stretches of Unicode white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize_tag(c: Column, ascii_only: bool = False) -> Column:
    return normalize_spaces(F.lower(nfkc(c, ascii_only)))


def normalize_search_text(c: Column, ascii_only: bool = False) -> Column:
    """Lower case, with letters, digits and underscores of any script kept and all else a space."""
    return normalize_spaces(F.regexp_replace(F.lower(nfkc(c, ascii_only)), r"(?U)[^\w\s]+", " "))


def move_trailing_article(c: Column) -> Column:
    return F.regexp_replace(c, "^(.+), (The|A|An)$", "$2 $1")


_TITLE = r"^(.+?)\s+\((\d{4})\)$"


def title_of(raw: Column) -> Column:
    """A title without its year, its trailing article put first."""
    return move_trailing_article(F.when(raw.rlike(_TITLE), F.regexp_extract(raw, _TITLE, 1)).otherwise(raw))


def year_of(raw: Column) -> Column:
    return F.when(raw.rlike(_TITLE), F.regexp_extract(raw, _TITLE, 2)).cast("int")


def parse_genres(c: Column) -> Column:
    """The genres between bars, empty ones dropped and repeated ones kept."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(c, F.lit("")).isin("", "(no genres listed)"), none).otherwise(F.filter(F.split(c, r"\|"), lambda g: g != ""))


def format_imdb_id(c: Column) -> Column:
    v = F.trim(c)
    padded = F.when(F.length(v) < 7, F.lpad(v, 7, "0")).otherwise(v)
    return F.when(v == "", None).when(v.startswith("tt"), v).when(v.rlike(r"^\d+$"), F.concat(F.lit("tt"), padded)).otherwise(F.concat(F.lit("tt"), v))


def format_tmdb_id(c: Column) -> Column:
    return F.trim(c).try_cast("long")
