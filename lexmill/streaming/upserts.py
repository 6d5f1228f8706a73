"""A stream of changes, applied batch by batch to a table, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.changes import latest
from pyspark.sql import functions as F


def apply_changes(stream: DataFrame, directory: str, key: str, order: str) -> StreamingQuery:
    """Every micro-batch goes to its own folder, overwritten if it is repeated; ``current`` reads the latest row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, [key], [F.desc(order)]).write.mode("overwrite").parquet(f"{directory}/batches/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{directory}/checkpoint").trigger(availableNow=True).start()


def current(spark, directory: str, key: str, order: str) -> DataFrame:  # noqa: ANN001
    rows = spark.read.parquet(f"{directory}/batches")
    return latest(rows, [key], [F.desc(order), F.desc("batch")]).drop("batch")
