"""One mix of several sources with a target share of tokens each, by temperature mixing.

The share of a source is w**t * s**(1 - t), normalised, with w its target weight, s its natural
share of the tokens and t the exponent, the temperature. At t = 1 the targets hold exactly, at
t = 0 the natural shares. The exponent is bisected to the largest value at which the repetition
limits allow the wanted total: without a stated total that is the largest mix that holds the
targets, and the exponent comes out as 1. ``entropy_shares`` bisects the exponent of s**a to a target
entropy instead, for mixes without target weights. Each source then gets its budget as whole passes
over all its documents and one partial pass, cut from a permutation of its documents in blocks:
whole blocks are taken by their token sums, and only the block on the boundary is looked at row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import Tokens
from ..session import cut

#: Documents of one block of a permutation.
BLOCK_ROWS = 50_000


#: Counts the tokens of a text under a public byte-level vocabulary; the rank file is read on the driver and travels with the counter.
token_counter = Tokens


def token_sizes(docs: DataFrame, counter: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, source, tokens) of each document; rows of one doc_id count once, null ids and texts are left out.

    Of several rows of one doc_id the one with the greatest (source, tokens) counts. Texts are never
    shuffled: a re-delivered row is counted again where it lies, and only its number travels.
    """
    held = docs.sparkSession.sparkContext.broadcast(counter or token_counter())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counter = held.value
            sizes = [counter(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "source", "text")
    sized = rows.mapInArrow(run, "doc_id long, source string, tokens long")
    return sized.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")


def entropy_shares(tokens: dict[str, float], entropy: float, rounds: int = 80) -> tuple[float, dict[str, float]]:
    """The exponent in [0, 1] and the shares s**exponent, normalised, whose entropy (nats) is the given one.

    The entropy falls as the exponent grows; targets outside what [0, 1] allows give the nearer end.
    """
    logs = {k: math.log(v) for k, v in tokens.items() if v > 0}

    def at(a: float) -> dict[str, float]:
        top = max(a * x for x in logs.values())
        raw = {k: math.exp(a * x - top) for k, x in logs.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}

    if not logs:
        return 0.0, {}
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        if -sum(p * math.log(p) for p in at(mid).values() if p > 0) >= entropy:
            lo = mid
        else:
            hi = mid
    return lo, at(lo)


def entropy_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tokens, exponent, share): shares s**exponent whose entropy is that of the target weights, over the targeted sources.

    One row a source with tokens and a positive weight; the targets are a bounded table of settings.
    """
    weights = {r["source"]: float(r["target_weight"]) for r in targets.where("source is not null and target_weight > 0").dropDuplicates(["source"]).collect()}
    sums = sizes.where(F.col("source").isin(list(weights)) & (F.col("tokens") > 0)).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    tokens = {r["source"]: float(r["t"]) for r in sums}
    whole = sum(weights[k] for k in tokens) or 1.0
    exponent, shares = entropy_shares(tokens, -sum(weights[k] / whole * math.log(weights[k] / whole) for k in tokens))
    return sizes.sparkSession.createDataFrame([(k, int(tokens[k]), exponent, p) for k, p in shares.items()], "source string, tokens long, exponent double, share double")


def plan_shares(tokens: dict[str, int], weights: dict[str, float], limits: dict[str, int], total: int | None = None, rounds: int = 80) -> tuple[int, float, dict[str, float]]:
    """(total tokens, temperature, share of each source) for sources with tokens, weight and a limit.

    Without ``total``, the largest that the limits allow at exactly the target weights. With it, the
    temperature is the largest in [0, 1] that respects the limits; a total beyond what even natural
    shares allow is lowered to the largest possible one.
    """
    live = [k for k in weights if weights[k] and weights[k] > 0 and tokens.get(k, 0) > 0 and limits.get(k, 0) > 0]
    if not live:
        return 0, 1.0, {}
    whole = sum(tokens[k] for k in live)
    scale = sum(weights[k] for k in live)

    def at(t: float) -> dict[str, float]:
        raw = {k: (weights[k] / scale) ** t * (tokens[k] / whole) ** (1 - t) for k in live}
        return {k: v / sum(raw.values()) for k, v in raw.items()}

    room = lambda p: min(limits[k] * tokens[k] / p[k] for k in live)
    natural = room(at(0.0))
    wanted = room(at(1.0)) if total is None else min(float(total), max(natural, room(at(1.0))))
    if room(at(1.0)) >= wanted:
        return int(wanted), 1.0, at(1.0)  # the upper end of the bisection
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if room(at(mid)) >= wanted else (lo, mid)
    return int(wanted), lo, at(lo)


def mix(sizes: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 1, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) and its report, one row a target.

    ``total`` is the wanted size in tokens, None for the largest mix that holds the targets, or
    "available" for as many tokens as the targeted sources have.

    ``sizes``: doc_id, source, tokens; ``targets``: source, target_weight, max_repeats, a bounded
    table of settings that the driver reads. Documents of other or null sources take no part; targets
    without documents get nothing and their weight is spread over the others. The report has source,
    target_share, planned_share, temperature, documents, available_tokens, mixed_tokens, reached_share and
    most_copies. A source misses its budget by less than one document.
    """
    spark = sizes.sparkSession
    wanted = {r["source"]: r for r in targets.where(F.col("source").isNotNull()).dropDuplicates(["source"]).collect()}
    weights = {k: float(r["target_weight"] or 0) for k, r in wanted.items()}
    limits = {k: int(r["max_repeats"] or 0) for k, r in wanted.items()}
    sums = sizes.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)).groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    tokens, docs = {r["source"]: r["t"] for r in sums}, {r["source"]: r["n"] for r in sums}
    if total == "available":
        total = sum(tokens[k] for k in tokens if weights[k] > 0 and limits[k] > 0)
    size, temperature, shares = plan_shares(tokens, weights, limits, total)
    rows = []
    for k, p in shares.items():
        budget = min(size * p, limits[k] * tokens[k])
        passes = min(int(budget // tokens[k]), limits[k])
        rows.append((k, passes, float(budget - passes * tokens[k]) if passes < limits[k] else 0.0, max(1, math.ceil(docs[k] / block_rows))))
    plan = spark.createDataFrame(rows, "source string, passes int, rest double, blocks int")
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = sizes.where(F.col("tokens") > 0).join(F.broadcast(plan), "source").withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("blocks")).cast("int"))
    block_sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    up_to = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block"))
    block_sums = block_sums.withColumn("before", up_to - F.col("block_tokens")).select("source", "block", "before", "block_tokens")
    placed = placed.join(block_sums, ["source", "block"])
    inside = F.col("before") + F.col("block_tokens") <= F.col("rest")
    edge = placed.where(~inside & (F.col("before") < F.col("rest")))
    running = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("order", "doc_id"))
    edge = edge.withColumn("in_pass", F.col("before") + running - F.col("tokens") / 2 <= F.col("rest"))
    out = placed.where(inside).withColumn("in_pass", F.lit(True)).unionByName(edge).unionByName(placed.where(F.col("before") >= F.col("rest")).withColumn("in_pass", F.lit(False)))
    out = out.select("doc_id", "source", "tokens", (F.col("passes") + F.col("in_pass").cast("int")).alias("copies")).where("copies > 0")
    made = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    scale = sum(weights.values()) or 1.0
    settings = spark.createDataFrame([(k, weights[k] / scale, shares.get(k, 0.0), temperature, docs.get(k, 0), tokens.get(k, 0)) for k in wanted], "source string, target_share double, planned_share double, temperature double, documents long, available_tokens long")
    report = settings.join(F.broadcast(made), "source", "left")
    everything = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    report = report.select("source", "target_share", "planned_share", "temperature", "documents", "available_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), (F.coalesce("mixed_tokens", F.lit(0)) / everything).alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    return out, report


def mixed_documents(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 1, counter: Callable[[str], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``mix`` of whole documents (doc_id, source, text), sized with the tokenizer once."""
    return mix(cut(token_sizes(docs, counter)), targets, total, seed)


def in_order(mixed: DataFrame, seed: int = 1) -> DataFrame:
    """One row (doc_id, source, tokens, copy_no, place) a copy; ``place`` orders the copies at random, block by block."""
    copies = mixed.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    return copies.withColumn("place", F.xxhash64(F.lit(seed + 2), "doc_id", "copy_no"))
