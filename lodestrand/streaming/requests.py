"""Streams of requests: a sliding-log limiter, a trace sink, an incremental cache, resumable processing.

The limiter drops stamps ``window`` seconds old or older and admits a request if fewer than ``limit`` remain; only admitted
ones count, so a running count over a range is not the same. Its state per user is at most ``limit`` stamps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranking import check
from ..storage import exists


def admit(log: list[float], stamps: list[float], limit: int, window: float) -> tuple[list[float], list[bool]]:
    """(log afterwards, verdict for each stamp in order)."""
    out = []
    for t in stamps:
        log = [s for s in log if t - s < window]
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return log, out


def limited(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Batch form over (user_id, event_id, seconds): admitted beside each event, in time order per user. Users' logs stream
    by in batches; what is held between them is one user's admitted stamps."""
    check(limit >= 1, "limit must be at least 1")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        user, log = None, []
        for batch in batches:
            users, stamps, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for own, stamp in zip(users, stamps, strict=True):
                if own != user:
                    user, log = own, []
                log, verdict = admit(log, [stamp], limit, window)
                out += verdict
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "admitted"])

    own = events.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.col("seconds").cast("double"))
    return own.repartition("user_id").sortWithinPartitions("user_id", "seconds", "event_id").mapInArrow(run, "user_id long, event_id long, seconds double, admitted boolean")


def limited_stream(events: DataFrame, limit: int, window: float) -> DataFrame:
    """The same over a stream: state is the log of admitted stamps, dropped when a user stays away for the window."""
    check(limit >= 1, "limit must be at least 1")

    def run(key, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["seconds", "event_id"])
        log, verdicts = admit(log, frame["seconds"].tolist(), limit, window)
        state.update((log,))
        state.setTimeoutDuration(int(window * 1000))
        yield frame.assign(admitted=verdicts)[["user_id", "event_id", "seconds", "admitted"]]

    return events.select("user_id", "event_id", "seconds").groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, seconds double, admitted boolean", "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_trace(stream: DataFrame, path: str, checkpoint: str):
    """Append-only JSON trace of a stream, metadata only: text columns are left out."""
    slim = stream.drop("question", "answer", "text")
    return slim.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_stream(stream: DataFrame, path: str, checkpoint: str, key: str, compute: Callable[[DataFrame], DataFrame]):
    """Compute and append the rows of a stream whose key the table at path lacks; a batch that runs again adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        if exists(batch.sparkSession, f"{path}/_SUCCESS"):
            batch = batch.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
        compute(batch.dropDuplicates([key])).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: str, stamp: str | None = None, delay: str = "1 day") -> DataFrame:
    """Every key's first row. With a stamp, keys are forgotten once the watermark has passed them by the delay, which
    bounds the state; without one they are kept for ever."""
    if stamp is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def minute_counts(traces: DataFrame, stamp: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Extension: requests and mean value per minute of event time, late rows admitted for the delay."""
    return traces.withWatermark(stamp, delay).groupBy(F.window(stamp, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("w.start", "n", "mean")
