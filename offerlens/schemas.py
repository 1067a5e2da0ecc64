"""Schemas of the offer domain. Money is a double throughout."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, MONEY, LONG = T.StringType(), T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType], nullable: bool = True) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t in fields])


OFFER = _struct(("product_description", TEXT), ("price", MONEY), ("url", TEXT), nullable=False)
OFFER_SELECTION = _struct(("deals", T.ArrayType(OFFER, False)), nullable=False)
OPPORTUNITY = _struct(("deal", OFFER), ("estimate", MONEY), ("discount", MONEY), nullable=False)
#: An opportunity as it is stored: with its place in the order of surfacing and the run that surfaced it.
STATE = T.StructType([*OPPORTUNITY.fields, T.StructField("seq", LONG, False), T.StructField("batch_id", LONG, False)])
SCRAPED_OFFER = _struct(*((n, TEXT) for n in ("category", "title", "summary", "url", "details", "features")))
FEED_ENTRY = _struct(("title", TEXT), ("summary", TEXT), ("links", T.ArrayType(_struct(("href", TEXT)))))
ITEM = T.StructType([*_struct(("title", TEXT), ("category", TEXT), ("price", MONEY), nullable=False).fields, *_struct(("full", TEXT), ("weight", MONEY), ("summary", TEXT), ("prompt", TEXT), ("id", LONG)).fields])
VECTOR_RECORD = T.StructType([T.StructField("id", LONG, False), T.StructField("embedding", T.ArrayType(T.FloatType()), False), *_struct(("document", TEXT), ("price", MONEY), ("category", TEXT)).fields])
EVAL_ROW = _struct(("i", LONG), ("title", TEXT), ("guess", MONEY), ("truth", MONEY), ("error", MONEY), ("color", TEXT))
MESSAGE = _struct(("role", TEXT), ("content", TEXT), ("tool_call_id", TEXT))
NOTIFY_ARGUMENTS = _struct(("description", TEXT), ("deal_price", MONEY), ("estimated_true_value", MONEY), ("url", TEXT))
