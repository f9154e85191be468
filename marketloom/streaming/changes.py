"""Streams of events: windowed counts, exactly-once notices and change detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.folders import shared_folder

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@contextmanager
def state_store(spark: SparkSession, provider: str) -> Iterator[None]:
    """Streams started inside keep their state with ``provider``, and run no batch without data.

    Timers of processing time would else ask for empty batches for ever, and a
    run over what is there now would not end; they fire with the next data.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": provider, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there now and read what it wrote to the shared folder."""
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession, "streams")

    def write(batch: DataFrame, n: int) -> None:
        # The same batch number always names the same folder, so a replay writes nothing twice.
        target = f"{at}/out" if mode == "complete" else f"{at}/out/batch={n}"
        batch.write.mode("overwrite").parquet(target)

    # An empty stream runs no batch; its result is an empty table all the same.
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch=-1")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def tumbling(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their value in cents, by window and type; late events count up to two hours."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = events.withWatermark("ts", "2 hours").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return sums.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between them."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_notices(events: DataFrame) -> DataFrame:
    """Each user and type once, however often it is seen or replayed."""
    return events.where("event_type in ('purchase', 'signup')").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


def changes(events: DataFrame) -> DataFrame:
    """How often each user's events changed type from one to the next, in order of event id; state: last type and count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        kinds = [last, *rows["event_type"]]
        n += sum(a is not None and a != b for a, b in zip(kinds, kinds[1:]))
        state.update((kinds[-1], int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "changes": [n]})

    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, changes bigint", "last string, n bigint", "append", "NoTimeout")


def run(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    return drained(make(event_stream(spark, sf_dir)), mode)
