"""Tables that a job writes for later jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none: a temporary folder if everything runs on this machine, else the warehouse, which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        local = master.startswith("local") and not master.startswith("local-cluster")
        _own[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{app}"
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table and read again: its lineage ends there, and a lost executor takes nothing along."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def folders(spark: SparkSession, path: str) -> int:
    """How many partition folders a table has at its top, from the file system's listing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm_path)
    return sum(1 for f in listed if f.isDirectory())
