"""The planner: new offers, their estimates, discounts and the one opportunity worth an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import DISCOUNT_THRESHOLD

#: Offers priced in a run.
MOST_PRICED = 5


def unseen(offers: DataFrame, memory: DataFrame, on: str = "url", most: int = 500_000) -> DataFrame:
    """Offers whose key was never surfaced. Offers of one batch that share a key all stay. The memory is broadcast if it is small."""
    keys = memory.select(on).where(F.col(on).isNotNull())  # keys that repeat do no harm in an anti-join; counting them distinct would shuffle the memory twice
    small = keys.limit(most + 1).count() <= most
    return offers.join(F.broadcast(keys) if small else keys.distinct(), on, "left_anti")


def with_price(offers: DataFrame) -> DataFrame:
    return offers.where("price > 0")


def selected(offers: DataFrame, most: int = MOST_PRICED) -> DataFrame:
    """The offers with the longest description and a clear price, in the place of a language model's choice; ties by seq."""
    text = F.length("product_description")
    return with_price(offers).withColumn("__n", text).orderBy(F.desc_nulls_last("__n"), "seq").limit(most).drop("__n")


def first_priced(offers: DataFrame, most: int = MOST_PRICED) -> DataFrame:
    return offers.orderBy("seq").limit(most)


def opportunities(offers: DataFrame, estimate: Column) -> DataFrame:
    return offers.withColumn("estimate", estimate).withColumn("discount", F.col("estimate") - F.col("price"))


def ranked(found: DataFrame, *ties: str) -> DataFrame:
    """By discount, descending; equal discounts stay in the order of the tie columns."""
    return found.orderBy(F.desc_nulls_last("discount"), *ties)


def best(found: DataFrame, *ties: str, threshold: float = DISCOUNT_THRESHOLD) -> DataFrame:
    """The opportunity with the highest discount if that is above the threshold. The filter goes first: it keeps the winner or leaves nothing."""
    return ranked(found.where(F.col("discount") > threshold), *ties).limit(1)


def as_opportunity(found: DataFrame) -> DataFrame:
    return found.select(F.struct("product_description", "price", "url").alias("deal"), "estimate", "discount")


def by_place(rows: DataFrame, index: int, *order: str) -> DataFrame:
    """The row at a place, from 0, in an order."""
    return rows.orderBy(*order).offset(index).limit(1)
