"""Cutting lineage with tables in the folder that all executors share.

The folder is the session's `spark.checkpoint.dir`. Only where that is unset and Spark runs in
this one process (`local[...]`, as in tests) a temporary folder of this machine is taken, which is
removed when Python ends; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomstone-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` to the shared folder and read it again: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._loomstone_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Remove a table made by cut() once nothing reads it any more."""
    path = getattr(df, "_loomstone_path", None)
    if path:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
