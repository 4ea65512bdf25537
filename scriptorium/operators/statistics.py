"""Exact aggregates: percentile definitions, unknown-propagating sums, bounds, overlaps of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, upto, total): counts of each value and their running sum, exact and pre-aggregated."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy("value")
    return c.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))


def at_index(counts: DataFrame, group: list[str], index: Column, name: str) -> DataFrame:
    """The value at a 0-based index of each group's sorted values, from ``value_counts``."""
    hit = counts.where((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index))
    return hit.select(*group, F.col("value").alias(name))


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, total, min, p50, p90, p99, max) with the percentile p at index int((n - 1) * p) of the sorted values.

    Values are counted first, so that a group with a third of all rows is a handful of counts.
    """
    c = value_counts(df, group, value)
    n = F.col("total")
    pick = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("n") <= i), F.col("value")))
    at = lambda p: F.floor((n - 1) * F.lit(p)).cast("long")
    return c.groupBy(*group).agg(
        F.max("total").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total"), F.min("value").alias("min"),
        pick(at(0.5)).alias("p50"), pick(at(0.9)).alias("p90"), pick(at(0.99)).alias("p99"), F.max("value").alias("max"),
    )


def observed_percentile(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """(group, p): the value at index ceil(n * share) - 1, which is the discrete percentile."""
    c = value_counts(df, group, value)
    return at_index(c, group, F.ceil(F.round(F.col("total") * F.lit(share), 9)) - 1, "p")


def sum_or_unknown(x: Column) -> Column:
    """The sum, or null as soon as one value is unknown."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def share_bounds(yes: Column, missing: Column) -> tuple[Column, Column]:
    """Lowest and highest share of yes when missing answers may be either."""
    n = F.count(F.lit(1))
    return F.round(F.count_if(yes) / n, 9), F.round((F.count_if(yes) + F.count_if(missing)) / n, 9)


def set_overlap(rows: DataFrame, group: list[str], side: str, a: str, b: str, item: str) -> DataFrame:
    """(group, common, only_a, only_b, jaccard) of the two sides' item sets, counted without collecting the sets."""
    seen = rows.where(F.col(side).isin(a, b)).groupBy(*group, item).agg(F.max((F.col(side) == a).cast("int")).alias("in_a"), F.max((F.col(side) == b).cast("int")).alias("in_b"))
    both = F.col("in_a") * F.col("in_b")
    out = seen.groupBy(*group).agg(F.sum(both).alias("common"), F.sum(F.col("in_a") - both).alias("only_a"), F.sum(F.col("in_b") - both).alias("only_b"))
    return out.withColumn("jaccard", F.round(F.col("common") / F.greatest(F.col("common") + F.col("only_a") + F.col("only_b"), F.lit(1)), 9))


def close_report(pairs: DataFrame, a: str, b: str, rtol: float, atol: float) -> DataFrame:
    """One row (n, max_abs_error, equal, within): bitwise equality and closeness of two number columns."""
    gap = F.abs(F.col(a) - F.col(b))
    return pairs.agg(F.count("*").alias("n"), F.max(gap).alias("max_abs_error"), F.bool_and(F.col(a) == F.col(b)).alias("equal"), F.bool_and(gap <= atol + rtol * F.abs(F.col(b))).alias("within"))


def cost_report(rows: DataFrame, channel: str, value: str, order: list[str]) -> DataFrame:
    """(channel, n, total, median, p95, first, later_median, share) of the values of each channel, ``first`` by ``order``.

    Values are counted before they are sorted; medians are averaged, p95 is the discrete percentile.
    """
    key = F.struct(*order)
    first = rows.groupBy(channel).agg(F.min_by(F.struct(F.col(value).alias("v")), key).alias("f"), F.sum(value).alias("s"))
    c = value_counts(rows, [channel], value)
    n = F.col("total")
    pick = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("n") <= i), F.col("value")))
    at = lambda x: F.floor(x).cast("long")
    a = c.groupBy(channel).agg(F.max("total").alias("n"), ((pick(at((n - 1) / 2)) + pick(at(n / 2))) / 2).alias("median"), pick(F.ceil(F.round(n * F.lit(0.95), 9)) - 1).alias("p95"))
    # the same without the first row: one less of its value
    less = c.join(first.select(channel, F.col("f.v").alias("fv")), channel)
    w = Window.partitionBy(channel).orderBy("value")
    less = less.withColumn("n", F.col("n") - (F.col("value") == F.col("fv")).cast("int")).withColumn("upto", F.sum("n").over(w)).withColumn("total", n - 1)
    b = less.groupBy(channel).agg(((pick(at((n - 1) / 2)) + pick(at(n / 2))) / 2).alias("later_median"))
    everything = F.sum("s").over(Window.partitionBy(F.lit(0)))
    f = first.select(channel, F.col("f.v").alias("first"), F.round("s", 3).alias("total"), F.round(F.col("s") / everything, 6).alias("share"))
    return a.join(b, channel).join(f, channel).select(channel, "n", "total", F.round("median", 6).alias("median"), "p95", "first", F.round("later_median", 6).alias("later_median"), "share")


def blind_sides(run: str, key: Column) -> Column:
    """AB or BA by the parity of the first byte of the digest of run and key."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{run}:"), key.cast("string")), 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "AB").otherwise("BA")


def blind_tally(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, first_better, second_better, same, open) of blind verdicts (sides, said: left, right, same or null)."""
    left = F.col("said") == "left"
    first = ((F.col("sides") == "AB") & left) | ((F.col("sides") == "BA") & (F.col("said") == "right"))
    second = ((F.col("sides") == "BA") & left) | ((F.col("sides") == "AB") & (F.col("said") == "right"))
    return verdicts.groupBy(by).agg(F.count_if(first).alias("first_better"), F.count_if(second).alias("second_better"), F.count_if(F.col("said") == "same").alias("same"), F.count_if(F.col("said").isNull()).alias("open"))
