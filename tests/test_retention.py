"""Timers of soft deletes: the batch form against a walk in order, the stream against the batch form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import retention

START = datetime(2024, 1, 1)
SCHEMA = "doc_id long, at timestamp, kind string"
KEEP = 50


def at(s):
    return START + timedelta(seconds=s)


def some_events(seed, n=260, docs=25):
    rng = random.Random(seed)
    return [(rng.randrange(docs), at(rng.randrange(400)), rng.choice(["deleted", "deleted", "restored", "viewed"])) for _ in range(n)] + [(99, at(400), "viewed"), (100, at(10), "deleted"), (100, at(10), "restored"), (101, at(10), "deleted"), (101, at(60), "restored")]


def walk(events, now):
    state, out = {}, {}
    for doc, t, kind in sorted(events, key=lambda e: (e[1], e[2])):
        if doc in out or kind == "viewed":
            continue
        if doc in state and state[doc] + timedelta(seconds=KEEP) <= t:
            out[doc] = state[doc]
        elif kind == "deleted":
            state.setdefault(doc, t)
        else:
            state.pop(doc, None)
    for doc, t in state.items():
        if doc not in out and t + timedelta(seconds=KEEP) <= now:
            out[doc] = t
    return {(d, t, t + timedelta(seconds=KEEP)) for d, t in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_against_a_walk(spark, seed):
    events = some_events(seed)
    for now in (at(120), at(390), at(1000)):
        seen = [e for e in events if e[1] <= now]
        got = retention.purges(spark.createDataFrame(seen, SCHEMA), KEEP, F.lit(now))
        assert {tuple(r) for r in got.collect()} == walk(seen, now)
    assert retention.purges(spark.createDataFrame([], SCHEMA), KEEP, F.lit(at(0))).count() == 0


def test_stream_against_batch(spark, tmp_path):
    """Two runs of one query over a growing folder; a late event behind the watermark changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = [e for e in some_events(4) if e[1] < at(400)]
    first, second = [e for e in events if e[1] < at(200)], [e for e in events if e[1] >= at(200)] + [(500, at(400), "viewed")]

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = retention.stream_purges(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), KEEP, "10 seconds")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    try:
        now = max(t for _, t, _ in first) - timedelta(seconds=10)
        got = run(first)
        assert got >= walk(first, now) and got <= walk(first, max(t for _, t, _ in first))
        everything = run(second + [(600, at(1), "deleted")])
        assert everything >= walk(events, at(390)) and everything <= walk(events, at(400))
        assert 600 not in {d for d, *_ in everything}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
