"""Sinks: alerts through a pluggable notifier, display tables, logs."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import alert_text, dollars

Notifier = Callable[[str], None]
LOG_TAIL = 18


def table_notifier(path: str) -> Callable[[DataFrame, int], None]:
    """Writes alert texts to a table, a partition a run."""
    return lambda alerts, batch_id: alerts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def notify(alerts: DataFrame, notifier: Notifier) -> int:
    """Sends a run's alert: at most one row ever comes to the driver."""
    rows = alerts.select("text").limit(1).collect()
    for r in rows:
        notifier(r.text)
    return len(rows)


def alert_of() -> Column:
    """The text of an opportunity's alert."""
    d = F.col("deal")
    return alert_text(d["product_description"], d["price"], F.col("estimate"), F.col("discount"), d["url"]).alias("text")


def alerts(opportunities: DataFrame) -> DataFrame:
    return opportunities.select(alert_of())


def display_rows(opportunities: DataFrame, formatted: bool = True) -> DataFrame:
    """Description, price, estimate, discount, url, as numbers or as $ texts."""
    show = dollars if formatted else (lambda c: c)
    d = F.col("deal")
    return opportunities.select(d["product_description"].alias("description"), show(d["price"]).alias("price"), show(F.col("estimate")).alias("estimate"), show(F.col("discount")).alias("discount"), d["url"].alias("url"))


def log_tail(lines: DataFrame, seq: str, line: str, n: int = LOG_TAIL) -> DataFrame:
    """The last n lines as one HTML text. Only n rows meet in one task."""
    last = lines.orderBy(F.desc(seq)).limit(n)
    return last.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(line).alias("l")))), lambda x: x["l"]), "<br>").alias("html"))


class ListHandler(logging.Handler):
    """Log records as formatted lines of a list, with times to the second. Add it once."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = []
        # The format of a line and of its date.
        self.setFormatter(logging.Formatter("[%(asctime)s] %(message)s", datefmt="%Y-%m-%d %H:%M:%S %z"))

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))
