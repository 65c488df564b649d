"""Streams: windowed metrics with late data, stateless stages on a stream, and session state with a time-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_metrics(events: DataFrame, time: str, by: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum per window and key. On a stream, rows later than `late` are dropped and windows close."""
    zoneless = dict(events.dtypes)[time] == "timestamp_ntz"
    if events.isStreaming:
        if zoneless:  # a watermark needs an instant: the times are read as UTC, in any session
            events = events.withColumn(time, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(time)).cast("timestamp"))
        events = events.withWatermark(time, late)
    per = events.groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    start = F.col("window.start")
    if zoneless and events.isStreaming:
        start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), start.cast("timestamp_ntz"))
    return per.select(start.alias("window_start"), by, "n", "total")


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all that is available; gives its rows, or calls each(batch, number) for every batch.

    The rows are written beside the checkpoint and read from there: appended, or, in complete mode, as the last batch has them.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    spark, out = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(out)  # a stream without rows gives none
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/appended").start().awaitTermination()
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def session_slots(turns: DataFrame, session: str, slots: str, minutes: int = 60) -> DataFrame:
    """Slots of a session carried over its turns, the newest value of each winning; state ends after `minutes` without a turn."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, held = state.get if state.exists else (0, [])
        merged = dict(x.split("=", 1) for x in held)
        for batch in batches:
            n += len(batch)
            for entries in batch[slots]:
                merged.update(x.split("=", 1) for x in (entries or "").split(",") if "=" in x)
        state.update((n, [f"{k}={v}" for k, v in merged.items()]))
        state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame({session: [key[0]], "turns": [n], "slots": [",".join(f"{k}={v}" for k, v in sorted(merged.items()))]})

    kind = dict(turns.dtypes)[session]
    return turns.groupBy(session).applyInPandasWithState(update, f"{session} {kind}, turns int, slots string", "n int, held array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)
