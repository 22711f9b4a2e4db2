"""Structured Streaming forms of the watch, report, state and trigger loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog
from ..operators.lifecycle import BUILD_TIMEOUT


def catalog_watch(spark: SparkSession, folder: str, served: catalog.Served, open_all: Callable | None = None, name: str = "catalog.json"):
    """Swap the served catalog whenever the catalog file is written; other files are not read.

    Starts with whatever ``served`` holds (an empty catalog if the file comes
    late); a catalog that does not open leaves the current one in force.
    """
    stream = spark.readStream.schema(catalog.SCHEMA).option("multiLine", True).option("pathGlobFilter", name).json(folder)

    def swap(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            served.swap(batch.select(F.explode("entries").alias("e")).select("e.*"), open_all)

    return stream.writeStream.foreachBatch(swap)


def latest_reports(reports: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Last full report of each node, as an update-mode aggregate over ``reports(node, at, phase)``."""
    return reports.withWatermark("at", watermark).groupBy("node").agg(F.max_by("phase", "at").alias("phase"), F.max("at").alias("at"))


MOVES = {
    ("", "start"): "building", ("building", "done"): "ready", ("building", "fail"): "failed", ("ready", "promote"): "active",
    ("active", "retire"): "retired", ("retired", "drop"): "deleted",
}


def version_states(events: DataFrame, timeout_seconds: int = BUILD_TIMEOUT) -> DataFrame:
    """State of each version after every batch of ``events(version, seq, at, event)``.

    A build that lasts longer than the timeout fails, by the processing-time
    timer or by the times of its own events.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            now = "failed" if now == "building" else now
        for pdf in batches:
            for e in pdf.sort_values("seq").itertuples():
                at = int(e.at.timestamp() // 1)  # whole seconds, as in the batch fold
                to = "failed" if now == "building" and at - since > timeout_seconds else MOVES.get((now, e.event), now)
                since = at if (now, to) == ("", "building") else since
                now = to
        state.update((now, since))
        if now == "building":
            state.setTimeoutDuration(timeout_seconds * 1000)
        yield pd.DataFrame({"version": [key[0]], "state": [now]})

    return events.groupBy("version").applyInPandasWithState(
        run, f"version {events.schema['version'].dataType.simpleString()}, state string", "state string, since long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def periodic(frame: DataFrame, seconds: int = 30):
    """A writer that triggers every so many seconds."""
    return frame.writeStream.trigger(processingTime=f"{seconds} seconds")


def idle_sessions(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """Connections by bursts of requests; a gap longer than the timeout closes one (0: never)."""
    if seconds == 0:
        return requests.groupBy("conn").agg(F.count("*").alias("n"))
    return requests.groupBy("conn", F.session_window("at", f"{seconds} seconds")).agg(F.count("*").alias("n"))
