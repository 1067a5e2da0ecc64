"""One hunt: new offers, a choice of them, prices, the best one, its alert, the state. And the tool loop's plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import planner
from ..sources import sinks, state
from ..sources.outbox import KeyedNotifier, Outbox, keyed_alerts
from ..sources.versions import VersionedTable

#: What an offer's estimate needs to be called with; remote models are swapped in here.
Estimator = Callable[[DataFrame], DataFrame]
# The tools' names.
TOOLS = ("scan_the_internet_for_bargains", "estimate_true_value", "notify_user_of_deal")
#: Rows of tool results that may be broadcast.
MOST_RESULTS = 500_000


def plan(offers: DataFrame, memory: DataFrame, estimator: Estimator, threshold: float = planner.DISCOUNT_THRESHOLD) -> DataFrame:
    """At most one opportunity. The anti-join goes before the choice and the choice before the estimates: each is dearer than the one before."""
    known = memory.select(F.col("deal.url").alias("url"))
    chosen = planner.selected(planner.unseen(offers, known))
    priced = estimator(chosen).withColumn("discount", F.col("estimate") - F.col("price"))
    return planner.as_opportunity(planner.best(priced, "seq", threshold=threshold))


def run(spark, offers: DataFrame, path: str, batch_id: int, estimator: Estimator, notifier: sinks.Notifier | None = None) -> DataFrame:
    """A hunt with state: its row is written under batch_id, before the alert is sent; state of the same batch_id is not memory, so a retry repeats itself."""
    memory = state.read_state(spark, path).where(F.col("batch_id") != batch_id)
    found = plan(offers, memory, estimator)
    state.append_state(found, path, batch_id)
    surfaced = state.read_state(spark, path)
    if notifier is not None:
        sinks.notify(sinks.alerts(surfaced.where(F.col("batch_id") == batch_id)), notifier)
    return surfaced


def run_once(offers: DataFrame, surfaced: VersionedTable, box: Outbox, batch_id: int, estimator: Estimator, notify: KeyedNotifier) -> DataFrame:
    """A hunt over versioned state whose alert is sent once, however often the batch is run: state and outbox hold a batch's rows by its number, and the alert is claimed before it is sent."""
    found = plan(offers, surfaced.read().where(F.col("batch_id") != batch_id), estimator).withColumn("seq", F.lit(batch_id).cast("long"))
    surfaced.append(found, batch_id)
    box.put(keyed_alerts(surfaced.read().where(F.col("batch_id") == batch_id)), batch_id)
    box.deliver(notify)
    surfaced.compact()
    return surfaced.read()


def tool_schemas() -> list[dict]:
    """The tools' parameters as JSON schemas."""
    text, number = {"type": "string"}, {"type": "number"}
    parameters = ({}, {"description": text}, {"description": text, "deal_price": number, "estimated_true_value": number, "url": text})
    return [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "properties": p, "required": list(p), "additionalProperties": False}}} for n, p in zip(TOOLS, parameters)]


def dispatched(calls: DataFrame, results: DataFrame, name: str = "name") -> DataFrame:
    """calls with the content of their tool's result; an unknown tool's is empty."""
    small = results.limit(MOST_RESULTS + 1).count() <= MOST_RESULTS
    return calls.join(F.broadcast(results) if small else results, name, "left").withColumn("content", F.coalesce("content", F.lit("")))


def estimate_sentence(description: Column, estimate: Column) -> Column:
    return F.concat(F.lit("The estimated true value of "), description, F.lit(" is "), estimate.cast("string"))


@dataclass
class ToolLoop:
    """A deterministic policy over the tools: scan, estimate each, notify once. Every call is recorded as a message."""

    scan: Callable[[], list[dict]]
    estimate: Callable[[str], float]
    notify: Callable[[dict], None]
    messages: list[dict] = field(default_factory=list)
    opportunity: dict | None = None

    def call(self, name: str, arguments: dict) -> str:
        if name == TOOLS[0]:
            deals = self.scan()
            content = json.dumps({"deals": deals}) if deals else "No deals found"
        elif name == TOOLS[1]:
            content = f"The estimated true value of {arguments['description']} is {self.estimate(arguments['description'])}"
        elif name == TOOLS[2]:
            if self.opportunity is None:  # later calls are answered but do nothing
                self.notify(arguments)
                self.opportunity = {"deal": {"product_description": arguments["description"], "price": arguments["deal_price"], "url": arguments["url"]}, "estimate": arguments["estimated_true_value"], "discount": arguments["estimated_true_value"] - arguments["deal_price"]}
            content = "Notification sent ok"
        else:
            content = ""
        self.messages.append({"role": "tool", "content": content, "tool_call_id": str(len(self.messages))})
        return content

    def plan(self) -> dict | None:
        """Every offer is estimated; the best discount is notified, the first of equal ones."""
        self.messages, self.opportunity = [{"role": "user", "content": "find the best offer"}], None
        found = self.call(TOOLS[0], {})
        deals = json.loads(found)["deals"] if found.startswith("{") else []
        priced = []
        for d in deals:
            said = self.call(TOOLS[1], {"description": d["product_description"]})
            priced.append((float(said.rsplit(" ", 1)[1]) - d["price"], d))
        if priced:
            gain, d = max(priced, key=lambda x: x[0])
            self.call(TOOLS[2], {"description": d["product_description"], "deal_price": d["price"], "estimated_true_value": gain + d["price"], "url": d["url"]})
        self.messages.append({"role": "assistant", "content": "OK"})
        return self.opportunity
