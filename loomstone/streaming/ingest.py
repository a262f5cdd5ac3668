"""Streaming extensions: incremental ingest of files and state of chats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """A stream over the files of a folder; each file is read once per checkpoint."""
    return spark.readStream.schema(schema).format(file_format).load(path)


def ingest_new(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what is new since the last call and stop: the resumable form of a batch job."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_latest(stream: DataFrame, key: str, seq: str, out: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep the latest row of each key in a table, micro-batch by micro-batch.

    The table is partitioned by a hash of the key. A batch rewrites only the buckets its keys are
    in, into new folders of its own number; a list of each bucket's current folder is written
    last, so a failed batch leaves the old rows in place and a repeated one gives the same. Folders
    that no list names any more are removed, but for those of the list before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lists = _numbers(spark, f"{out}/lists")
        done = max((n for n in lists if n < number), default=None)
        current = {} if done is None else {r.bucket: r.number for r in spark.read.parquet(f"{out}/lists/{done}").collect()}  # one row per bucket
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        old = [f"{out}/rows/{current[b]}/bucket={b}" for b in touched if b in current]
        if old:
            rows = rows.unionByName(spark.read.option("basePath", f"{out}/rows").schema(batch.schema).parquet(*old).select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        columns = [c for c in batch.columns if c != key]
        latest = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("r")).select("bucket", key, "r.*")
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/{number}")
        listed = current | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(listed.items()), "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{out}/lists/{number}")
        for n in lists:  # the list before stays for readers
            if done is not None and n < done:
                _remove(spark, f"{out}/lists/{n}")
        for n in _numbers(spark, f"{out}/rows"):
            if n not in {*listed.values(), *current.values()}:
                _remove(spark, f"{out}/rows/{n}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The rows of a table that upsert_latest() keeps, by its newest list."""
    newest = max(_numbers(spark, f"{out}/lists"))
    folders = [f"{out}/rows/{r.number}/bucket={r.bucket}" for r in spark.read.parquet(f"{out}/lists/{newest}").collect()]
    return spark.read.parquet(*folders)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers that name folders within a folder."""
    at, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n) for n in names if n.isdigit()]


def _remove(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event time window; rows later than the watermark are dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


HISTORY = 50


def last_turns(turns: DataFrame, most: int = HISTORY) -> DataFrame:
    """`(chat, n_turns, history)`: each chat's latest turns, kept as state between micro-batches."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("seq")
        held = (list(held) + rows["content"].tolist())[-most:]
        n += len(rows)
        state.update((n, held))
        yield pd.DataFrame({"chat": [key[0]], "n_turns": [n], "history": [held]})

    kind = dict(turns.dtypes)["chat"]
    return turns.groupBy("chat").applyInPandasWithState(
        keep, f"chat {kind}, n_turns long, history array<string>", "n long, held array<string>", "update", GroupStateTimeout.NoTimeout
    )
