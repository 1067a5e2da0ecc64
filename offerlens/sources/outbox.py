"""Alerts that are sent once: an outbox with commit records.

put() stores a run's alert with the run's number; a repeated run replaces its own. deliver() first commits a claim of the run (only one of any number of senders can),
then sends, then commits a confirmation. A sender that dies before its claim leaves the alert to the next one. One that dies between claim and confirmation may or
may not have sent it: such alerts are listed by unconfirmed() and not sent again unless deliver(again=True), with the same key, for receivers that know what they have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import alert_of
from .versions import Conflict, VersionedTable

#: Sends a text; the key is the same each time it is sent.
KeyedNotifier = Callable[[str, str], None]
_ALERT, _MARK = "key string, text string, batch_id long", "key string, batch_id long"
#: Alerts that one call sends, at most; the others wait for the next call.
MOST_SENT = 1000


class Outbox:
    def __init__(self, spark: SparkSession, path: str):
        self.alerts = VersionedTable(spark, f"{path}/alerts", _ALERT)
        self.claims = VersionedTable(spark, f"{path}/claims", _MARK)
        self.done = VersionedTable(spark, f"{path}/done", _MARK)

    def put(self, alerts: DataFrame, batch_id: int) -> None:
        """alerts(key, text) of a run: one row, or none."""
        self.alerts.append(alerts.select("key", "text"), batch_id)

    def _open(self, marks: VersionedTable) -> DataFrame:
        return self.alerts.read().join(marks.read().select("batch_id"), "batch_id", "left_anti")

    def unconfirmed(self) -> DataFrame:
        """Alerts that were claimed and not confirmed."""
        return self._open(self.done).join(self.claims.read().select("batch_id"), "batch_id", "left_semi")

    def deliver(self, notify: KeyedNotifier, again: bool = False) -> int:
        """Sends what is due, the oldest runs first; how many."""
        sent = 0
        due = self._open(self.claims)
        rows = due.orderBy("batch_id", "key").limit(MOST_SENT).collect()
        rows += self.unconfirmed().orderBy("batch_id", "key").limit(MOST_SENT).collect() if again else []
        for r in rows:
            mark = self.alerts.spark.createDataFrame([(r.key, r.batch_id)], _MARK)
            if r.batch_id not in self.claims.manifest().batches:
                try:
                    self.claims.append(mark, r.batch_id, replace=False)
                except Conflict:
                    continue  # another sender has it
            notify(r.key, r.text)
            self.done.append(mark, r.batch_id)
            sent += 1
        for t in (self.alerts, self.claims, self.done):
            try:
                t.compact()
            except Conflict:
                pass  # another sender is at it
        return sent


def keyed_alerts(opportunities: DataFrame) -> DataFrame:
    """(key, text) of surfaced opportunities: the key is the offer's url."""
    return opportunities.select(F.col("deal.url").alias("key"), alert_of())
