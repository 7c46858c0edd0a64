"""Sinks: JSON files, keyed tables, document bulk actions and sorted sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Adapters of similarity documents: key prefix and the field of the ids.
PRESETS = {"item-similarity": ("rec:item_cf:v1:neighbors", "item_id"), "user-similarity": ("rec:user_cf:v1:neighbors", "user_id")}


def redis_key(prefix: str, *parts: Column) -> Column:
    """A key of a prefix, less the colons at its end, and parts."""
    return F.concat_ws(":", F.lit(prefix.rstrip(":")), *parts)


def zset_records(documents: DataFrame, schema: str = "item-similarity", prefix: str | None = None) -> DataFrame:
    """key, data_type and values (member -> score) of similarity documents; co-occurrences are left out."""
    if schema not in PRESETS:
        raise ValueError(f"unknown input schema: {schema}")
    preset, field = PRESETS[schema]
    pairs = F.transform("neighbors", lambda n: F.struct(n[field].cast("string").alias("key"), n["score"].alias("value")))
    return documents.select(redis_key(prefix or preset, F.col(field).cast("string")).alias("key"), F.lit("zset").alias("data_type"), F.map_from_entries(pairs).alias("values"))


def passthrough(records: DataFrame) -> DataFrame:
    """Records as they are given: values as a map, or members as an array of (member, score); type stands for data_type."""
    columns = records.columns
    kind = F.coalesce(*(F.col(c) for c in ("data_type", "type") if c in columns), F.lit("zset"))
    listed = F.map_from_entries(F.transform("members", lambda m: F.struct(m["member"].cast("string"), m["score"].cast("double")))) if "members" in columns else None
    values = [F.col("values")] * ("values" in columns) + [listed] * (listed is not None)
    return records.select("key", kind.alias("data_type"), F.coalesce(*values).alias("values"))


def members(records: DataFrame) -> DataFrame:
    """key, data_type, member, score: the records' members as rows."""
    return records.select("key", "data_type", F.explode("values").alias("member", "score"))


def zset_top(records: DataFrame, n: int) -> DataFrame:
    """The n highest members of each sorted set, ties by member in descending text order, as such stores give them."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))
    return members(records).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def dry_run(records: DataFrame) -> DataFrame:
    """How many records and values would be written."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size("values")), F.lit(0)).cast("long").alias("value_count"))


def write_json(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as JSON lines, in as many files as there are partitions; null fields are written."""
    documents.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_array(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as one JSON array in one file, in their order: a single task streams the rows, so this is for exports."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([("," if started or i else "[") + x for i, x in enumerate(lines)])], ["value"])
                started = True
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows = documents.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if rows.isEmpty():
        documents.sparkSession.createDataFrame([("[]",)], "value string").write.mode(mode).text(path)
        return
    rows.coalesce(1).mapInArrow(run, "value string").write.mode(mode).text(path)


def write_table(documents: DataFrame, name: str, create: bool = True, mapping: dict[str, str] | None = None) -> None:
    """Documents appended to a table. A missing one is created only if asked for; an existing one is never changed.

    mapping: the columns that are allowed; others are an error.
    """
    extra = sorted(set(documents.columns) - set(mapping)) if mapping else []
    if extra:
        raise ValueError(f"the mapping lacks: {', '.join(extra)}")
    exists = documents.sparkSession.catalog.tableExists(name)
    if not exists and not create:
        raise ValueError(f"no such table: {name}")
    writer = documents.write.format("parquet")
    writer.mode("append").saveAsTable(name) if exists else writer.saveAsTable(name)


def bulk_actions(documents: DataFrame, index: str, id_field: str) -> DataFrame:
    """_index, _id (null: the store makes one) and _source (JSON) of a document store's bulk writes."""
    return documents.select(F.lit(index).alias("_index"), F.col(id_field).cast("string").alias("_id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_source"))


#: Sends a batch of rows to a store and returns how many it took.
Send = Callable[[list[Row]], int]


def send_in_batches(rows: DataFrame, connect: Callable[[], Send], size: int = 500, retries: int = 3) -> int:
    """Sends all rows from the executors in batches; a batch that fails `retries` times fails the job. Returns the count.

    connect is called once a task. A task that runs again sends its batches again, so a store must write by key.
    """

    def run(part: Iterator[Row]) -> Iterator[int]:
        send, batch, done = connect(), [], 0

        def flush() -> int:
            for left in range(retries - 1, -1, -1):
                try:
                    return send(batch)
                except Exception:
                    if not left:
                        raise
            return 0

        for row in part:
            batch.append(row)
            if len(batch) >= size:
                done += flush()
                batch.clear()
        if batch:
            done += flush()
        yield done

    return rows.rdd.mapPartitions(run).sum()


#: Runs a pipeline of commands against a store: [(name, *arguments), ...].
Execute = Callable[[list[tuple]], None]


def send_zsets(records: DataFrame, connect: Callable[[], Execute], replace: bool = True, expire_seconds: int = 0, size: int = 500, retries: int = 3) -> int:
    """Writes sorted sets from the executors in pipelines of `size` records; returns how many records were sent."""

    def connected() -> Send:
        execute = connect()

        def send(batch: list[Row]) -> int:
            commands: list[tuple] = []
            for r in batch:
                if replace:
                    commands.append(("DEL", r.key))
                if r["values"]:
                    commands.append(("ZADD", r.key, r["values"]))
                    if expire_seconds > 0:
                        commands.append(("EXPIRE", r.key, expire_seconds))
            execute(commands)
            return len(batch)

        return send

    return send_in_batches(records, connected, size, retries)


#: Sends a bulk write of (index, id, source) and returns the error of each document that the store refused, by place.
Bulk = Callable[[list[Row]], dict[int, str]]


def send_bulk(documents: DataFrame, index: str, id_field: str, connect: Callable[[], Bulk], size: int = 500) -> DataFrame:
    """_id and error of the documents that a store refused; writes are keyed by id, so a task that runs again replaces."""

    def run(part: Iterator[Row]) -> Iterator[tuple[str, str]]:
        send, batch = connect(), []
        for row in part:
            batch.append(row)
            if len(batch) >= size:
                yield from ((batch[i]["_id"], e) for i, e in send(batch).items())
                batch = []
        if batch:
            yield from ((batch[i]["_id"], e) for i, e in send(batch).items())

    actions = bulk_actions(documents, index, id_field)
    return documents.sparkSession.createDataFrame(actions.rdd.mapPartitions(run), "_id string, error string")


def zset_commands(records: DataFrame, replace: bool = True, expire_seconds: int = 0) -> DataFrame:
    """key, step and command of each write: DEL if replaced, ZADD if there are values, EXPIRE if asked for."""
    filled = F.size("values") > 0
    add = F.concat(F.lit("ZADD "), "key", F.lit(" "), F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws(" ", e["value"].cast("string"), e["key"])), " "))
    steps = [F.when(F.lit(replace), F.concat(F.lit("DEL "), "key")), F.when(filled, add), F.when(filled & F.lit(expire_seconds > 0), F.concat(F.lit("EXPIRE "), "key", F.lit(f" {expire_seconds}")))]
    rows = records.select("key", F.posexplode(F.array(*steps)).alias("step", "command"))
    return rows.filter("command is not null")
