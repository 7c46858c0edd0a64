"""Command line: build item index, profiles or similarities from CSV files, and write them as JSON, tables or sorted sets.

python -m recospark.jobs.build item-similarity --ratings r.csv --output out/ [--sink zset] [--production] [--set top_k=50]
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from recospark import config as C
from recospark import schemas
from recospark.operators import item_index, profiles, similarity, sinks
from recospark.sources.files import last_wins, read_csv, read_documents, validate_input

JOBS = ("item-index", "profiles", "item-similarity", "user-similarity")


def _set(config, settings: list[str]):
    """A config with settings given as name=value, each as the type of its default."""
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(config)}
    given = {}
    for name, _, value in (x.partition("=") for x in settings):
        kind = kinds.get(name, str)
        given[name] = value.lower() in ("true", "1", "yes", "on") if kind is bool else kind(value)
    return C.overlaid(config, **given)


def build(spark: SparkSession, job: str, args: argparse.Namespace) -> DataFrame:
    def source(kind: str, optional: bool = False) -> DataFrame:
        return read_csv(spark, getattr(args, kind), kind, optional)

    if job == "item-similarity":
        return similarity.adjacency(similarity.item_similarity(source("ratings"), _set(C.PRODUCTION_ITEMS if args.production else C.ItemSimilarityConfig(), args.set)), "item_id")
    if job == "user-similarity":
        return similarity.adjacency(similarity.user_similarity(source("ratings"), _set(C.PRODUCTION_USERS if args.production else C.UserSimilarityConfig(), args.set)), "user_id")
    movies = source("movies")
    if job == "profiles":
        return profiles.build(source("ratings"), _last(movies), source("tags", optional=True), _set(C.ProfileConfig(), args.set))
    return item_index.build(movies, source("tags"), _last(source("links")), source("ratings"), _set(C.TagConfig(), args.set))


def _last(rows: DataFrame) -> DataFrame:
    """One row for each movie, the last in file order."""
    from pyspark.sql import functions as F

    return last_wins(rows.withColumn("_order", F.monotonically_increasing_id()), "movieId", "_order")


def staged(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The documents to write: built, or where a place for them is named, read from there after the build has written them."""
    if not args.documents:
        return build(spark, args.job, args)
    if not args.skip_build:
        sinks.write_json(build(spark, args.job, args), args.documents)
    shapes = {"item-index": schemas.ITEM_INDEX, "profiles": schemas.PROFILE, "item-similarity": schemas.similarity("item_id"), "user-similarity": schemas.similarity("user_id")}
    validate_input(spark, args.documents)
    return read_documents(spark, args.documents, shapes[args.job])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("job", choices=JOBS)
    for kind in ("ratings", "movies", "tags", "links"):
        parser.add_argument(f"--{kind}", default=f"{kind}.csv")
    parser.add_argument("--output")
    parser.add_argument("--documents", help="where the documents stand between the build and the write")
    parser.add_argument("--skip-build", action="store_true", help="write the documents that stand there")
    parser.add_argument("--skip-write", action="store_true", help="only build them")
    parser.add_argument("--sink", choices=("json", "table", "zset", "count"), default="json")
    parser.add_argument("--production", action="store_true")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    args = parser.parse_args(argv)
    if (args.skip_build or args.skip_write) and not args.documents:
        parser.error("--skip-build and --skip-write need --documents")
    if args.skip_build and args.skip_write:
        parser.error("nothing is left to do")
    if not args.skip_write and not args.output:
        parser.error("name an --output")
    spark = SparkSession.builder.appName(f"recospark {args.job}").getOrCreate()
    documents = staged(spark, args)
    if args.skip_write:
        return 0
    if args.sink == "table":
        sinks.write_table(documents, args.output)
    elif args.sink == "json":
        sinks.write_json(documents, args.output)
    else:
        records = sinks.zset_records(documents, args.job)
        if args.sink == "count":
            print(*sinks.dry_run(records).first())
        else:
            records.write.parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
