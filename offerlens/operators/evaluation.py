"""Evaluation of price models: errors, buckets, metrics, running means with confidence bands."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import error_color, parse_price, thousands
from ..functions.text import ellipsis

DEFAULT_SIZE = 200


def first_rows(rows: DataFrame, size: int = DEFAULT_SIZE, key: str = "id") -> DataFrame:
    """The first rows by key, numbered from 1 in `i`. Only they are numbered in one task."""
    return rows.orderBy(key).limit(size).withColumn("i", F.row_number().over(Window.orderBy(key)).cast("long"))


def numbered(rows: DataFrame, path: str, *order: str, parts: int | None = None) -> DataFrame:
    """rows with their place in an order, from 1, in `i`; ids may have gaps or repeat. No task has more than a range of the rows.

    Rows are written to path (a new folder that executors share) in ranges, rows of equal order dealt by chance, which also decides their places. The
    ranges' counts, one row a range, give what comes before each. Nulls come first. An empty table gives an empty result.
    """
    keys = [*order, "__salt"]
    dealt = rows.withColumn("__salt", F.rand(7))
    ranged = (dealt.repartitionByRange(parts, *keys) if parts else dealt.repartitionByRange(*keys)).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    held = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.groupBy("__part").agg(F.count("*").alias("__rows")).select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return held.join(F.broadcast(offsets), "__part").withColumn("i", place + F.col("__before")).drop("__part", "__salt", "__before")


def error_rows(rows: DataFrame, predictor: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows(i, title, price) with guess, truth, error, color; titles of at most 40 characters. Guesses may be numbers or texts."""
    guessed = rows.withColumn("guess", predictor) if isinstance(predictor, Column) else predictor(rows)
    guess = parse_price(F.col("guess")) if dict(guessed.dtypes)["guess"] == "string" else F.col("guess").cast("double")
    out = guessed.withColumn("guess", guess).withColumn("truth", F.col("price")).withColumn("error", F.abs(F.col("guess") - F.col("price")))
    return out.select("i", ellipsis(F.col("title")).alias("title"), "guess", "truth", "error", error_color(F.col("error"), F.col("truth")).alias("color"))


def report(errors: DataFrame, size: int | None = None) -> DataFrame:
    """n, mean absolute error (over `size` rows, if given), mean squared error, r2 in percent (coefficient of determination), limit of the axes."""
    sse = F.sum(F.pow(F.col("truth") - F.col("guess"), 2))
    spread = F.sum(F.col("truth") * F.col("truth")) - F.sum("truth") * F.sum("truth") / F.count("*")
    mean = F.sum("error") / F.lit(size) if size else F.avg("error")
    return errors.agg(F.count("*").alias("n"), mean.alias("mean_error"), (sse / F.count("*")).alias("mse"), ((1 - F.try_divide(sse, spread)) * 100).alias("r2"), F.greatest(F.max("truth"), F.max("guess")).alias("axis_max"))


def report_title(metrics: DataFrame, title: str) -> DataFrame:
    text = F.concat(F.lit(title + " results<br><b>Error:</b> $"), thousands(F.col("mean_error")), F.lit(" <b>MSE:</b> "), thousands(F.col("mse"), 0), F.lit(" <b>r²:</b> "), thousands(F.col("r2"), 1), F.lit("%"))
    return metrics.select(text.alias("title"))


def buckets(errors: DataFrame) -> DataFrame:
    return errors.groupBy("color").agg(F.count("*").alias("n"), F.avg("error").alias("mean_error"))


def running(errors: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean error up to each row with the half width and ends of its 95 % confidence band, in order of i, for each of `by`."""
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sd = F.coalesce(F.stddev_pop("error").over(w), F.lit(0.0))
    out = errors.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("i")).cast("long")).withColumn("mean", F.avg("error").over(w)).withColumn("ci", 1.96 * sd / F.sqrt("n"))
    return out.select(*by, "i", "n", "mean", "ci", (F.col("mean") + F.col("ci")).alias("upper"), (F.col("mean") - F.col("ci")).alias("lower"))


def _offsets(parts: pd.DataFrame) -> pd.DataFrame:
    """What comes before each part of a group: rows, values, their mean and squared deviations, merged in order (Chan's formula)."""
    parts = parts.sort_values("part", ignore_index=True)
    rows = values = 0
    mean = m2 = 0.0
    out = []
    for r in parts.itertuples():
        out.append((rows, values, mean, m2))
        rows += r.rows
        if r.values_n:
            values, gap, share = values + r.values_n, r.part_mean - mean, r.values_n / (values + r.values_n)
            m2 += r.part_m2 + gap * gap * (values - r.values_n) * share
            mean += gap * share
    parts[["rows0", "values0", "mean0", "m20"]] = out
    return parts.drop(columns=["rows", "values_n", "part_mean", "part_m2"])


def running_parts(errors: DataFrame, path: str, by: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """running() for any number of rows: no task has more than a range of them.

    Rows are written to path (a new folder that executors share) in ranges of (by, i, error), equal rows dealt by chance. Each range gives its number of rows,
    mean and squared deviations; merged in order they are what comes before each range, and windows inside the ranges go on from there.
    Rows of equal i are ordered by their error, null errors first; n counts rows, mean and ci the errors that are not null. Nulls in i come first.
    """
    spark = errors.sparkSession
    order = [*by, "i", "error", "__salt"]
    rows = errors.select(*by, "i", F.col("error").cast("double").alias("error"), F.rand(7).alias("__salt"))
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(ranged.withColumn("part", F.lit(0)).schema).parquet(path)
    partial = rows.groupBy(*by, "part").agg(F.count("*").alias("rows"), F.count("error").alias("values_n"), F.avg("error").alias("part_mean"), (F.var_pop("error") * F.count("error")).alias("part_m2"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, "part").schema)
    offsets = partial.groupBy(*by, F.pmod("part", F.lit(1)).alias("__one")).applyInPandas(_offsets, f"{kinds}, rows0 long, values0 long, mean0 double, m20 double")
    w = Window.partitionBy(*by, "part").orderBy("i", "error", "__salt").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"k": F.count(F.lit(1)).over(w), "v": F.count("error").over(w), "m": F.avg("error").over(w), "q": F.var_pop("error").over(w) * F.count("error").over(w)})
    names = {c: f"__{c}" for c in [*by, "part"]}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = local.join(offsets.withColumnsRenamed(names), same)
    values, gap = F.col("v") + F.col("values0"), F.coalesce("m", F.lit(0.0)) - F.col("mean0")
    mean = F.when(values > 0, F.col("mean0") + gap * F.try_divide(F.col("v"), values))
    m2 = F.col("m20") + F.coalesce("q", F.lit(0.0)) + gap * gap * F.try_divide(F.col("values0") * F.col("v"), values)
    n = F.col("k") + F.col("rows0")
    sd = F.coalesce(F.sqrt(F.greatest(F.try_divide(m2, values), F.lit(0.0))), F.lit(0.0))
    out = joined.withColumns({"n": n, "mean": mean, "ci": 1.96 * sd / F.sqrt(n)})
    return out.select(*by, "i", "n", "mean", "ci", (F.col("mean") + F.col("ci")).alias("upper"), (F.col("mean") - F.col("ci")).alias("lower"))


def final(curve: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The last values of running()."""
    return curve.groupBy(*by).agg(F.max("n").alias("n"), F.max_by("mean", "i").alias("mean"), F.max_by("ci", "i").alias("ci"))


def band(curve: DataFrame) -> DataFrame:
    """The confidence band as a closed line: upper ends forward, lower ends backward; `place` orders its points."""
    up = curve.select(F.col("n").alias("place"), F.col("n").alias("x"), F.col("upper").alias("y"))
    return up.unionByName(curve.select((-F.col("n")).alias("place"), F.col("n").alias("x"), F.col("lower").alias("y")))


def hover_text(errors: DataFrame) -> DataFrame:
    return errors.withColumn("hover", F.concat("title", F.lit("\nGuess=$"), thousands(F.col("guess")), F.lit(" Actual=$"), thousands(F.col("truth"))))


def bar_data(rows: DataFrame, label: str, value: str, *order: str) -> DataFrame:
    """The columns of a bar chart as arrays (labels, values), in an order, and the limit of its axis. For reports of a few rows."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(label).alias("__label"), F.col(value).alias("__value"))))
    out = rows.agg(listed.alias("rows"), F.max(value).alias("axis_max"))
    return out.select(F.col("rows.__label").alias("labels"), F.col("rows.__value").alias("values"), "axis_max")
