"""Budgeted admission of evidence and conversation windows.

Greedy admission skips what does not fit and goes on, so it is no prefix of a running sum; it runs
per query over a list bounded by retrieval depth. Everything before and after stays declarative.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_candidates(rows: DataFrame) -> DataFrame:
    """One row a (query_id, key): the least (rank, input_index), with the number of its occurrences."""
    w = Window.partitionBy("query_id", "key")
    r = rows.withColumn("_n", F.row_number().over(w.orderBy("rank", "input_index"))).withColumn("seen", F.count("*").over(w))
    return r.where("_n = 1").drop("_n")


def admit(candidates: DataFrame, total: int, each: int, most: int | None = None) -> DataFrame:
    """``candidates`` (query_id, key, rank, size) with admitted and reason, in rank order under the budgets.

    Reasons: admitted, too large, no slot, no room. A later smaller candidate may still fit.
    """
    kind = dict(candidates.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "key"])
        used, n, words = 0, 0, []
        for size in part["size"]:
            word = "too large" if size > each else "no slot" if most is not None and n >= most else "no room" if used + size > total else "admitted"
            if word == "admitted":
                used += size
                n += 1
            words.append(word)
        return part.assign(admitted=[x == "admitted" for x in words], reason=words)[["query_id", "key", "rank", "size", "admitted", "reason"]]

    return candidates.select("query_id", "key", "rank", "size").groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, key {kind['key']}, rank int, size long, admitted boolean, reason string")


def expanded(direct: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Direct candidates (query_id, key, rank) and the rows beside them in their group, as (query_id, key, reason, anchor_rank).

    ``rows``: key, group. Only direct candidates bring neighbours (the row before and after by key); a row
    found several times keeps its best reason and anchor.
    """
    w = Window.partitionBy(group).orderBy("key")
    sides = rows.where(F.col(group).isNotNull()).select("key", F.lag("key").over(w).alias("a"), F.lead("key").over(w).alias("b"))
    beside = sides.select("key", F.explode(F.array_compact(F.array("a", "b"))).alias("other"))
    near = direct.select("query_id", "key", "rank").join(beside, "key").select("query_id", F.col("other").alias("key"), F.lit(1).alias("ord"), "rank")
    both = direct.select("query_id", "key", F.lit(0).alias("ord"), "rank").unionByName(near)
    best = both.groupBy("query_id", "key").agg(F.min("ord").alias("ord"), F.min("rank").alias("anchor_rank"))
    return best.select("query_id", "key", F.when(F.col("ord") == 0, "direct").otherwise("neighbour").alias("reason"), "anchor_rank")


def packed(rows: DataFrame, owner: str, order: list[str], size: str, most: int, count: int | None) -> DataFrame:
    """``rows`` with batch: sequential greedy batches of each owner, closed when the next row would pass ``most`` (or ``count`` rows).

    Only keys and sizes are gathered, one list an owner; an owner's rows must fit one task.
    """
    import pyarrow as pa

    from .chunking import greedy_batches

    g = rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(*order, size))).alias("x"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            at, parts, numbers = [], [], []
            for i, x in enumerate(b.column("x").to_pylist()):
                at += [i] * len(x)
                parts += x
                numbers += greedy_batches([r[size] for r in x], most, count)
            kind = b.schema.field("x").type.value_type
            columns = [pa.array([r[c] for r in parts], kind.field(c).type) for c in (*order, size)]
            yield pa.RecordBatch.from_arrays([b.column(owner).take(pa.array(at, pa.int64())), *columns, pa.array(numbers, pa.int32())], names=[owner, *order, size, "batch"])

    return g.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (owner, *order, size)) + ", batch int")


def blocks(rows: DataFrame, group: list[str], order: str, text: str, step: int = 1, sep: str = "\n") -> DataFrame:
    """Neighbouring rows (order differs by at most ``step``) of a group joined: (group, first, last, rows, text)."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w)) > step, F.lit(True)).cast("int")
    r = rows.withColumn("_new", new).withColumn("_b", F.sum("_new").over(w))
    made = r.groupBy(*group, "_b").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t")))).alias("x"))
    return made.select(*group, "first", "last", "rows", F.array_join(F.col("x.t"), sep).alias("text"))


def conversation_window(turns: DataFrame, recent: int, limit: int, excerpt: int = 80) -> DataFrame:
    """The newest turns in full and an extract of the older ones, oldest dropped beyond ``limit`` bytes.

    ``turns``: conversation, turn, text. Gives (conversation, turn, kind, text, omitted_chars).
    """
    w = Window.partitionBy("conversation").orderBy(F.desc("turn"))
    r = turns.withColumn("age", F.row_number().over(w))
    full = F.col("age") <= recent
    r = r.select("conversation", "turn", "age", F.when(full, "full").otherwise("index").alias("kind"), F.when(full, F.col("text")).otherwise(F.substring("text", 1, excerpt)).alias("shown"), F.col("text").alias("_t"))
    r = r.withColumn("upto", F.sum(F.octet_length("shown")).over(Window.partitionBy("conversation").orderBy("age")))
    return r.where((F.col("upto") <= limit) | (F.col("age") == 1)).select("conversation", "turn", "kind", F.col("shown").alias("text"), (F.length("_t") - F.length("shown")).alias("omitted_chars"))


def gain(before: DataFrame, after: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, new_items, kept_items): what a later packet holds beyond an earlier one."""
    b = before.select(*keys, item).distinct().withColumn("_old", F.lit(1))
    r = after.select(*keys, item).distinct().join(b, [*keys, item], "left")
    return r.groupBy(*keys).agg(F.count_if(F.col("_old").isNull()).alias("new_items"), F.count_if(F.col("_old").isNotNull()).alias("kept_items"))
