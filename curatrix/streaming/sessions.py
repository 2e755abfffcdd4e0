"""Runs of one value over a stream, as Structured Streaming.

:func:`session_stream` is the declarative form: session windows under a watermark. :func:`run_stream` is
the stateful one: its state is the open run of a key (value, first and last time, rows, best score), and
a run is emitted when another value comes, when the gap is exceeded, or when the watermark passes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import folder


def session_stream(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, event_type, t0, t1, n, best of sessions; append mode gives those that the watermark closes."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return got.select("user_id", "event_type", F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n", "best")


def run_stream(events: DataFrame, gap_seconds: int = 6 * 3600, late: str = "1 hour") -> DataFrame:
    """The same by user with arbitrary state: a run also ends when the type changes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        run = list(state.get) if state.exists else None
        if state.hasTimedOut:
            done, run = [tuple(run)], None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for kind, ts, value in zip(rows["event_type"], rows["ts"], rows["value"], strict=True):
                us = int(ts.value // 1000)
                if run and (run[0] != kind or us - run[2] > gap_seconds * 1000000):
                    done.append(tuple(run))
                    run = None
                run = [kind, us, us, 1, float(value)] if run is None else [kind, run[1], max(us, run[2]), run[3] + 1, max(run[4], float(value))]
        if run is None:
            state.remove()
        else:
            state.update(tuple(run))
            state.setTimeoutTimestamp(max(run[2] // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["user_id", "event_type", "t0", "t1", "n", "best"])

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    shape = "event_type string, t0 long, t1 long, n long, best double"
    return e.groupBy("user_id").applyInPandasWithState(step, f"user_id long, {shape}", shape, "append", GroupStateTimeout.EventTimeTimeout)


def closed_sessions(spark: SparkSession, path: str, schema) -> DataFrame:
    """What :func:`session_stream` emits for the files that are there now."""
    out = f"{folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    # a pattern, so that the source may be one file or a folder of files
    stream = session_stream(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def all_sessions(spark: SparkSession, path: str, schema) -> DataFrame:
    """The sessions of a bounded input: those that the stream closed, and those still open at its end.

    Open ones are made of the events after the last closed session of their user and type, so only these
    are read into sessions again.
    """
    closed = closed_sessions(spark, path, schema)
    last = closed.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("k")).agg(F.max("t1").alias("until"))
    events = spark.read.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    rest = events.join(last, F.col("user_id").eqNullSafe(F.col("u")) & F.col("event_type").eqNullSafe(F.col("k")), "left").filter("until is null or ts >= until")
    return closed.unionByName(session_stream(rest.select(*events.columns)))
