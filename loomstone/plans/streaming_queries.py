"""Queries of the streaming extensions and of files written and read again; each runs to completion and returns a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.lineage import shared_dir
from loomstone.sources.files import append_new, json_lines, replace_partitions, write_if_empty
from loomstone.sources.tables import table
from loomstone.streaming.ingest import file_stream, ingest_new, last_turns, read_latest, upsert_latest, windowed_counts

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _place(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark, sf_dir) -> str:
    """The events as a folder of files, as a stream would find them."""
    at = _place(spark)
    table(spark, sf_dir, "events").repartition(4, "user_id").write.parquet(at)
    return at


def stream_ingest(spark, sf_dir):
    """New files are taken in once: a second run finds nothing new."""
    source, out = _source(spark, sf_dir), _place(spark)
    for _ in range(2):
        ingest_new(file_stream(spark, source, _EVENTS).select("event_id", "user_id", "event_type"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", "event_type")


def stream_upsert(spark, sf_dir):
    """The latest event of each user."""
    source, out = _source(spark, sf_dir), _place(spark)
    stream = file_stream(spark, source, _EVENTS).select("user_id", F.struct("ts", "event_id").alias("seq"), "event_id", "event_type")
    upsert_latest(stream, "user_id", "seq", f"{out}/rows", f"{out}/checkpoint")
    return read_latest(spark, f"{out}/rows").select("user_id", "event_id", "event_type")


def _run(spark, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and keep each batch's rows with the batch's number."""
    out = _place(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def stream_windows(spark, sf_dir):
    """Events per day and type, in event time."""
    stream = file_stream(spark, _source(spark, sf_dir), _EVENTS)
    rows = _run(spark, windowed_counts(stream, "ts", "event_type", "1 day", "400 days"), "update")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def chat_state(spark, sf_dir):
    """Number of turns of each chat, from the state that holds its last fifty."""
    stream = file_stream(spark, _source(spark, sf_dir), _EVENTS).select(F.col("user_id").alias("chat"), F.col("event_id").alias("seq"), F.col("props").alias("content"))
    rows = _run(spark, last_turns(stream), "update")
    return rows.groupBy("chat").agg(F.max("n_turns").alias("n_turns"), F.max(F.size("history")).alias("n_kept"))


def json_round_trip(spark, sf_dir):
    """Clusters written as JSON lines by season and read again with a schema."""
    out = _place(spark)
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "season", "cluster_size").dropDuplicates(["cluster_id"])
    rows.write.mode("overwrite").json(out)
    return json_lines(spark, out, "cluster_id string, season string, cluster_size int").where("_corrupt_record is null").select("cluster_id", "season", "cluster_size")


def resumed_append(spark, sf_dir):
    """A table that a first run filled in part is completed by a second one."""
    out = _place(spark)
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "season").dropDuplicates(["cluster_id"])
    append_new(rows.where("season is not null"), out, "cluster_id")
    append_new(rows, out, "cluster_id")
    return spark.read.parquet(out).select("cluster_id", "season")


def seeded_once(spark, sf_dir):
    """An item table that is filled only while it is empty, of one asset type, with known fields."""
    out = _place(spark)
    rows = table(spark, sf_dir, "fashion_item", "id", "source_path", "asset_type").dropDuplicates(["id"])
    write_if_empty(rows.where("asset_type = 'runway'"), out, ["id", "source_path", "unknown_field"])
    write_if_empty(rows, out, ["id"])
    return spark.read.parquet(out)


def replaced_partitions(spark, sf_dir):
    """One season's partition is replaced, others stay."""
    out = _place(spark)
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "season").dropDuplicates(["cluster_id"]).where("season is not null").withColumn("version", F.lit(1))
    replace_partitions(rows, out, ["season"])
    replace_partitions(rows.where("season like 'SS%'").withColumn("version", F.lit(2)), out, ["season"])
    return spark.read.parquet(out).groupBy("version").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_upsert, stream_windows, chat_state, json_round_trip, resumed_append, seeded_once, replaced_partitions)}
_R = "WITH r AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry)"
ORACLES = {
    "stream_ingest": "SELECT event_id, user_id, event_type FROM events",
    "stream_upsert": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "chat_state": "SELECT user_id AS chat, count(*) AS n_turns, least(count(*), 50)::INT AS n_kept FROM events GROUP BY 1",
    "json_round_trip": _R + " SELECT cluster_id, season, cluster_size FROM r",
    "resumed_append": _R + " SELECT cluster_id, season FROM r",
    "seeded_once": "SELECT DISTINCT ON (id) id, source_path FROM fashion_item WHERE asset_type = 'runway'",
    "replaced_partitions": _R + " SELECT CASE WHEN season LIKE 'SS%' THEN 2 ELSE 1 END AS version, count(*) AS n FROM r WHERE season IS NOT NULL GROUP BY 1",
}
