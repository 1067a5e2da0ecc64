"""Prices: parsing, formats, combination and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONTEXT_HEAD, ESTIMATE_HEAD, cut

# Pattern, scaling, weights and limits that results must have.
PRICE_PATTERN = r"[-+]?\d*\.\d+|\d+"
TARGET_STD = 1.0328539609909058
TARGET_MEAN = 4.434937953948975
ENSEMBLE_WEIGHTS = (0.8, 0.1, 0.1)
DISCOUNT_THRESHOLD = 50.0


def parse_price(text: Column) -> Column:
    """The first number of a text without $ and commas, 0 without any."""
    plain = F.regexp_replace(text, "[$,]", "")
    return F.coalesce(F.regexp_extract(plain, f"({PRICE_PATTERN})", 1).try_cast("double"), F.lit(0.0))


def thousands(value: Column, digits: int = 2) -> Column:
    """1,234.50; ties go to the even digit of the exact binary value."""
    return F.format_number(value, digits)


def money(value: Column, digits: int = 2) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), money(value))


def ensemble(frontier: Column, specialist: Column, network: Column) -> Column:
    a, b, c = ENSEMBLE_WEIGHTS
    return frontier * a + specialist * b + network * c


def from_target(prediction: Column) -> Column:
    """A price from a standardised log(1 + price); not below 0, and 0 for NaN."""
    price = F.exp(prediction * TARGET_STD + TARGET_MEAN) - 1
    return F.when(F.isnan(price), 0.0).otherwise(F.greatest(F.lit(0.0), price))


def to_target(price: Column) -> Column:
    return (F.log1p(price) - TARGET_MEAN) / TARGET_STD


def error_color(error: Column, truth: Column) -> Column:
    """green, orange or red by absolute or relative error. A truth of 0 has no relative error."""
    relative = F.try_divide(error, truth)
    within = lambda least, share: (error < least) | F.coalesce(relative < share, F.lit(False))
    return F.when(within(40, 0.2), "green").when(within(80, 0.4), "orange").otherwise("red")


def alert_text(description: Column, price: Column, estimate: Column, discount: Column, url: Column) -> Column:
    return F.concat(
        F.lit("Deal Alert! Price=$"), money(price), F.lit(", Estimate=$"), money(estimate), F.lit(", Discount=$"), money(discount), F.lit(" :"),
        cut(description, 10), F.lit("... "), url,
    )


def notify_text(message: Column, url: Column) -> Column:
    return F.concat(cut(message, 200), F.lit("... "), url)


def context(similars: Column, prices: Column) -> Column:
    """Prompt context of similar products with their prices; the longer array is cut."""
    n = F.least(F.size(similars), F.size(prices))
    pairs = F.arrays_zip(F.slice(similars, F.lit(1), n).alias("s"), F.slice(prices, F.lit(1), n).alias("p"))
    lines = F.transform(pairs, lambda x: F.concat(F.lit("Potentially related product:\n"), x["s"], F.lit("\nPrice is $"), money(x["p"]), F.lit("\n\n")))
    return F.concat(F.lit(CONTEXT_HEAD), F.array_join(lines, ""))


def estimate_prompt(description: Column, similars: Column, prices: Column) -> Column:
    """What a model is asked for an estimate: the product, then similar ones with their prices."""
    return F.concat(F.lit(ESTIMATE_HEAD), description, F.lit("\n\n"), context(similars, prices))
