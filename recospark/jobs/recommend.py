"""Command line: recommend items to users from documents that the build job wrote.

python -m recospark.jobs.recommend --profiles p/ --items i/ --item-similarity s/ --user-similarity u/ --user-id 1 --user-id 2
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recospark import schemas
from recospark.config import ServingConfig
from recospark.operators import recommend
from recospark.sources.files import read_similarity, read_store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("profiles", "items", "item-similarity", "user-similarity"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--user-id", action="append", type=int, required=True)
    parser.add_argument("--max-results", type=int, default=10)
    parser.add_argument("--recall-ratio", type=float, default=1.0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("recospark recommend").getOrCreate()
    stores = recommend.stores_of(
        read_store(spark, args.profiles, schemas.PROFILE, "user_id"),
        read_store(spark, args.items, schemas.ITEM_INDEX, "item_id"),
        read_similarity(spark, args.item_similarity, "item_id"),
        read_similarity(spark, args.user_similarity, "user_id"),
    )
    requests = spark.createDataFrame([(i, u, args.max_results) for i, u in enumerate(args.user_id)], "request_id long, user_id long, max_candidates int")
    found = recommend.recommend(requests, stores, ServingConfig(recall_ratio=args.recall_ratio))
    for row in recommend.statuses(requests, stores, found).orderBy("request_id").collect():
        print(row.user_id, {v: k for k, v in schemas.GATEWAY.items()}[row.status])
    for row in found.orderBy("request_id", "rank_position").select("user_id", "rank_position", "item_id", F.round("rank_score", 6)).collect():
        print(*row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
