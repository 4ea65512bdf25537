"""Ranges of characters: unions, gaps, overlaps, containment, coverage. Half-open, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Maximal ranges (keys, start, end) of ranges that overlap or touch; null, empty and reversed ranges are left out."""
    rows = ranges.where(F.col(start).isNotNull() & (F.col(end) > F.col(start))).select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).distinct()
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def union_length(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, single, covered, repeated): sum of lengths, length of the union, and the difference."""
    total = ranges.where(F.col(start).isNotNull() & (F.col(end) > F.col(start))).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("single"))
    covered = merged(ranges, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return total.join(covered, keys).withColumn("repeated", F.col("single") - F.col("covered"))


def gaps(ranges: DataFrame, lengths: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What the ranges leave of 0..length: (keys, start, end). ``lengths``: keys, length; a key without ranges is one gap."""
    m = merged(ranges, keys, start, end)
    edge = lengths.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("length"))
    stop = lengths.select(*keys, F.col("length").alias("start"), F.col("length").alias("end"), F.col("length"))
    inner = m.join(lengths, keys).select(*keys, F.least("start", "length").alias("start"), F.least("end", "length").alias("end"), "length")
    rows = edge.unionByName(inner).unionByName(stop)
    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*keys, before.alias("_from"), F.col("start").alias("_to")).where("_to > _from").select(*keys, F.col("_from").alias("start"), F.col("_to").alias("end"))


def overlaps(ranges: DataFrame, keys: list[str], ident: str, start: str = "start", end: str = "end", cell: int = 1000) -> DataFrame:
    """Overlapping pairs (keys, a, b, shared) of different ranges of one key, a < b.

    Ranges are cut into cells of ``cell`` positions and meet by equality of (key, cell); a pair is
    reported by the cell in which its overlap begins, so that long ranges cost only their cells.
    """
    rows = ranges.where(F.col(end) > F.col(start)).select(*keys, F.col(ident).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))
    cells = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor((F.col("e") - 1) / cell))))
    a = cells.select(*keys, "cell", F.col("id").alias("a"), F.col("s").alias("sa"), F.col("e").alias("ea"))
    b = cells.select(*keys, "cell", F.col("id").alias("b"), F.col("s").alias("sb"), F.col("e").alias("eb"))
    begin = F.greatest("sa", "sb")
    both = a.join(b, [*keys, "cell"]).where((F.col("a") < F.col("b")) & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea")) & (F.floor(begin / cell) == F.col("cell")))
    return both.select(*keys, "a", "b", (F.least("ea", "eb") - begin).alias("shared"))


def shared_length(ranges: DataFrame, keys: list[str], owner: str, start: str = "start", end: str = "end", cell: int = 1000) -> DataFrame:
    """(a, b, shared): positions that ranges of two owners share inside the keys, each counted once; a < b.

    Intersections are found by cells of ``cell`` positions, as in ``overlaps``, and merged before they are
    counted. Rows are pairs of owners that do share something.
    """
    rows = ranges.where(F.col(end) > F.col(start)).select(*keys, F.col(owner).alias("o"), F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    cells = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor((F.col("e") - 1) / cell))))
    a, b = (cells.select(*keys, "cell", F.col("o").alias(x), F.col("s").alias(f"s{x}"), F.col("e").alias(f"e{x}")) for x in "ab")
    both = a.join(b, [*keys, "cell"]).where((F.col("a") < F.col("b")) & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea")) & (F.floor(F.greatest("sa", "sb") / cell) == F.col("cell")))
    parts = both.select(*keys, "a", "b", F.greatest("sa", "sb").alias("start"), F.least("ea", "eb").alias("end"))
    return merged(parts, [*keys, "a", "b"]).groupBy("a", "b").agg(F.sum(F.col("end") - F.col("start")).alias("shared"))


def contained(ranges: DataFrame, keys: list[str], ident: str, order: str, start: str = "start", end: str = "end", cell: int = 1000) -> DataFrame:
    """Ranges (keys, id, by) that lie within one earlier range of the key, with the earliest such range.

    A range that holds another one holds its first position: the outer ranges are cut into cells of
    ``cell`` positions, the inner ones meet only those of the cell in which they start.
    """
    rows = ranges.where(F.col(end) > F.col(start)).select(*keys, F.col(ident).alias("id"), F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"))
    outer = rows.select(*keys, F.col("id").alias("by"), F.col("o").alias("bo"), F.col("s").alias("bs"), F.col("e").alias("be"), F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor((F.col("e") - 1) / cell))).alias("_cell"))
    hit = rows.withColumn("_cell", F.floor(F.col("s") / cell)).join(outer, [*keys, "_cell"]).where("bo < o and bs <= s and be >= e")
    return hit.groupBy(*keys, "id").agg(F.min_by("by", "bo").alias("by"))


def not_contiguous(parts: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Parts (keys, start, end, problem) that leave a gap after, or overlap, the part before them."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end))
    p = parts.withColumn("_b", before)
    word = F.when(F.col("_b").isNull() & (F.col(start) != 0), "starts late").when(F.col(start) > F.col("_b"), "gap").when(F.col(start) < F.col("_b"), "overlap")
    return p.select(*keys, start, end, word.alias("problem")).where("problem is not null")
