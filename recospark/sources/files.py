"""Readers of CSV inputs and JSON document stores, with declared schemas."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recospark import schemas

REQUIRED = {
    "ratings": (schemas.RATINGS, ["userId", "movieId", "rating", "timestamp"]),
    "movies": (schemas.MOVIES, ["movieId", "genres"]),
    "tags": (schemas.TAGS, ["userId", "movieId", "tag"]),
    "links": (schemas.LINKS, []),
}


def read_csv(spark: SparkSession, path: str, kind: str, optional: bool = False) -> DataFrame:
    """A CSV input by its header, typed as declared. Missing required columns are an error that names them.

    optional: a path that does not exist gives no rows. A field that can't be read as its type fails the query.
    """
    schema, required = REQUIRED[kind]
    if optional and not _exists(spark, path):
        warnings.warn(f"{path} does not exist and is read as empty", stacklevel=2)
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns: {', '.join(missing)}")
    return raw.select(*((F.trim(c) if f.dataType.simpleString() != "string" or c == "userId" else F.col(c)).cast(f.dataType).alias(c) if (c := f.name) in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one that is last in the given order column, which is dropped."""
    from pyspark.sql import Window

    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", order)


def read_documents(spark: SparkSession, path: str, schema: StructType, fmt: str = "auto") -> DataFrame:
    """JSON documents, one a line or in one array. auto: an array if the first character that isn't white space is '['.

    A document that can't be parsed fails the query. Blank lines are skipped, unknown fields ignored; no file is an
    error, an empty one has no documents.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if fmt == "auto":
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        fmt = "json" if first and first[0].value.lstrip().startswith("[") else "jsonl"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=fmt == "json")


def validate_input(spark: SparkSession, path: str, fmt: str = "auto") -> None:
    """An error that names the path if it doesn't exist, is empty, has no document, or is read as an array and is none."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at)
    if not summary.getFileCount():
        raise ValueError(f"{path} is not a file, and holds none")
    if not summary.getLength():
        raise ValueError(f"{path} is empty")
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no document")
    if fmt == "json" and not first[0].value.lstrip().startswith("["):
        raise ValueError(f"{path} is no JSON array")


def _checked(value: Column, valid: Column, path: str, what: str) -> Column:
    """The value, or an error that names the path, the file and the value."""
    said = F.concat(F.lit(f"{path}: {what}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(F.raise_error(said))


def _place() -> Column:
    """A row's place in file order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_store(spark: SparkSession, path: str, schema: StructType, key: str, most: int = 2**63 - 1) -> DataFrame:
    """A store of documents: ids must be positive, `most` at most, and of documents with one id the last in file order stays."""
    rows = read_documents(spark, path, schema).withColumn("_order", _place())
    checked = rows.withColumn(key, _checked(F.col(key), (F.col(key) > 0) & (F.col(key) <= most), path, f"{key} must be positive and in range"))
    return last_wins(checked, key, "_order")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A store of profile documents, whose user ids must fit 32 bits."""
    return read_store(spark, path, schemas.PROFILE, "user_id", 2**31 - 1)


def read_similarity(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """Edges src, dst, score, cooccurrence, position of a similarity store; ids and scores may be numbers or their text.

    An id that is no positive integer, or a score that is no finite number, fails the query and is named.
    """
    rows = read_documents(spark, path, schemas.similarity(id_field, text=True)).withColumn("_order", _place())

    def whole(c: Column) -> Column:
        return F.when(c.rlike(r"^[0-9]+$"), c.try_cast("long"))

    src = F.col(id_field)
    rows = rows.select(_checked(src, whole(src) > 0, path, f"{id_field} must be a positive integer").cast("long").alias(id_field), "neighbors", "_order")
    flat = last_wins(rows, id_field, "_order").select(F.col(id_field).alias("src"), F.posexplode("neighbors").alias("position", "n"))
    dst, score = F.col(f"n.{id_field}"), F.col("n.score")
    number = score.try_cast("double")
    return flat.select(
        "src",
        _checked(dst, whole(dst) > 0, path, f"{id_field} must be a positive integer").cast("long").alias("dst"),
        _checked(score, F.abs(number) < float("inf"), path, "score must be a finite number").cast("double").alias("score"),
        F.coalesce(F.col("n.cooccurrence").cast("long"), F.lit(0)).alias("cooccurrence"),
        (F.col("position") + 1).alias("position"),
    )


def lines_of(spark: SparkSession, path: str, id_field: str, ids: DataFrame, schema: StructType) -> DataFrame:
    """The documents of JSON lines whose id is among `ids` (column id_field): others are told by a scan for the id and never
    parsed. A document that can't be parsed fails the query."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    number = F.regexp_extract("value", f'"{id_field}":\\s*(-?[0-9]+)', 1).try_cast("long")
    kept = lines.withColumn("_id", number).join(ids.select(F.col(id_field).alias("_id")).distinct(), "_id", "left_semi")
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
