"""The hunt as a stream: micro-batches of offers, state that survives restarts, one alert a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans import hunt
from ..schemas import STATE
from ..sources.outbox import KeyedNotifier, Outbox
from ..sources.sinks import Notifier
from ..sources.versions import VersionedTable

INTERVAL = "300 seconds"


def offers_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Landed offer files, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start_hunt(offers: DataFrame, state_path: str, checkpoint: str, estimator: hunt.Estimator, notifier: Notifier | None = None, once: bool = False, name: str | None = None) -> StreamingQuery:
    """Runs a hunt on each batch, every five minutes; once: on all that is there, batch by batch, then ends.

    Rejected offers may come again and are estimated again; only surfaced ones are remembered. A replayed batch
    replaces its own state rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        hunt.run(batch.sparkSession, batch, state_path, batch_id, estimator, notifier)

    writer = offers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def start_hunt_once(offers: DataFrame, path: str, estimator: hunt.Estimator, notify: KeyedNotifier, once: bool = False, repeat: int = 1) -> StreamingQuery:
    """start_hunt() with versioned state and an outbox below path: a batch that is run again, here or after a restart, alerts no second time. repeat: runs of each batch, to test that."""
    spark = offers.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        surfaced, box = VersionedTable(spark, f"{path}/surfaced", STATE), Outbox(spark, f"{path}/outbox")
        for _ in range(repeat):
            hunt.run_once(batch, surfaced, box, batch_id, estimator, notify)

    writer = offers.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


class HuntLines(StreamingQueryListener):
    """Log lines of the hunt of one name from Spark's own reports of its start, batches and end. Register before the start: spark.streams.addListener(HuntLines(name, lines.append))."""

    def __init__(self, name: str, line: Callable[[str], None]):
        self.name, self.line, self.runs = name, line, set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self.line(f"{self.name} has begun")

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) in self.runs and event.progress.numInputRows:
            self.line(f"{self.name} has read batch {event.progress.batchId} with {event.progress.numInputRows} offers")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.runs.discard(str(event.runId))
            self.line(f"{self.name} has failed: {event.exception}" if event.exception else f"{self.name} has ended")


def output_or_initial(final: DataFrame, initial: DataFrame) -> DataFrame:
    """The rows of a finished run, or the initial ones while it has none."""
    empty = final.limit(1).count() == 0
    return initial if empty else final


def updates(query: StreamingQuery, lines: list[str], output: Callable[[], DataFrame], initial: DataFrame, wait_s: float = 0.1) -> Iterator[tuple[list[str], DataFrame]]:
    """While a hunt runs in the background, its log lines so far with the initial rows; at its end all lines with its output, or the initial rows if that is empty."""
    while not query.awaitTermination(wait_s):
        yield list(lines), initial
    yield list(lines), output_or_initial(output(), initial)


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """An extension: counts and sums by event-time window and type. Zone-less times are read as UTC."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("ts", late)
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
