"""Soft deletes with a time limit: a restore within it cancels, else the document is purged. The same rules for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PURGE = "doc_id long, deleted_at timestamp, purged_at timestamp"


def purges(events: DataFrame, seconds: int, now) -> DataFrame:  # noqa: ANN001
    """events(doc_id, at, kind: deleted or restored) of a table -> doc_id, deleted_at, purged_at: the first deletion of a document that no restore follows in time.

    Deletions while a document is deleted change nothing, nor does anything after its purge. A restore at the very moment of the purge comes too late. Deletions whose time is not up at ``now`` give no row.
    """
    order = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    restored = F.col("kind") == "restored"
    x = events.where(F.col("kind").isin("deleted", "restored")).withColumn("restores", F.sum(restored.cast("int")).over(order))
    spans = x.groupBy("doc_id", "restores").agg(F.min(F.when(~restored, F.col("at"))).alias("deleted_at"), F.min(F.when(restored, F.col("at"))).alias("restored_at"))
    next_ = F.lead("restored_at").over(Window.partitionBy("doc_id").orderBy("restores"))
    due = F.col("deleted_at") + F.make_interval(secs=F.lit(seconds))
    s = spans.withColumn("next", next_).withColumn("purged_at", due).where(F.col("purged_at") <= F.coalesce("next", now))
    return s.groupBy("doc_id").agg(F.min("deleted_at").alias("deleted_at"), F.min("purged_at").alias("purged_at")).where(F.col("purged_at") <= now)


class _Retention(StatefulProcessor):
    """A document's state: when it was deleted (microseconds), and whether it is purged. One timer at most."""

    def __init__(self, seconds: int):
        self.keep = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retention", "deleted long, purged boolean")

    def _timer(self, deleted: int) -> int:
        return -(-(deleted + self.keep) // 1000)

    def _purged(self, doc_id: int, deleted: int) -> pd.DataFrame:
        self.state.update((deleted, True))
        stamps = pd.to_datetime([deleted, deleted + self.keep], unit="us")
        return pd.DataFrame({"doc_id": [doc_id], "deleted_at": stamps[:1], "purged_at": stamps[1:]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        deleted, purged = self.state.get() if self.state.exists() else (None, False)
        before = deleted
        events = sorted((int(at.value // 1000), kind) for batch in rows for at, kind in zip(batch["at"], batch["kind"]))
        for at, kind in events:
            if purged:
                break
            if deleted is not None and deleted + self.keep <= at:
                if before is not None:
                    self.handle.deleteTimer(self._timer(before))
                yield self._purged(key[0], deleted)
                return
            if kind == "deleted":
                deleted = at if deleted is None else deleted
            elif kind == "restored":
                deleted = None
        if purged or deleted == before:
            return
        if before is not None:
            self.handle.deleteTimer(self._timer(before))
        if deleted is None:
            self.state.clear()
        else:
            self.handle.registerTimer(self._timer(deleted))
            self.state.update((deleted, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        deleted, purged = self.state.get() if self.state.exists() else (None, True)
        if not purged and self._timer(deleted) == expiredTimerInfo.getExpiryTimeInMs():
            yield self._purged(key[0], deleted)

    def close(self) -> None:
        pass


def stream_purges(events: DataFrame, seconds: int, delay: str) -> DataFrame:
    """The same for a stream, each purge once, as soon as the watermark (``delay`` behind the latest event) reaches it. Events behind the watermark are dropped.

    Needs the RocksDB state store. A purged document keeps a mark, so that late events don't revive it.
    """
    grouped = events.withWatermark("at", delay).groupBy("doc_id")
    return grouped.transformWithStateInPandas(_Retention(seconds), PURGE, "append", "EventTime")
