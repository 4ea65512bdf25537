"""Rank fusion, deferral of covered candidates, diversified ordering and quota selection.

Ranked lists are tables (query_id, route, key, rank[, granularity]). Everything that is a sum or a
window stays declarative; only the choices that depend on what was chosen before (deferral, MMR,
disjoint selection) run as one small function per query, whose input is bounded by the list depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rrf(hits: DataFrame, k: int = 60, weight: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion (query_id, key, score, rank), ties by key; ``weight`` is of the hit's list."""
    one = (F.lit(1.0) if weight is None else weight) / (k + F.col("rank"))
    scored = hits.groupBy("query_id", "key").agg(F.round(F.sum(one), 12).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))


def balanced_rrf(hits: DataFrame, sources: DataFrame, k: int = 60) -> DataFrame:
    """RRF in which each query weighs one over the number of queries of its source.

    ``hits``: query_id, key, rank; ``sources``: query_id, source. Gives (source, key, score, rank).
    """
    counted = sources.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("source")))
    joined = hits.join(counted, "query_id")
    return rrf(joined.select(F.col("source").alias("query_id"), "key", "rank", "w"), k, F.col("w")).withColumnRenamed("query_id", "source")


def fuse_routes(hits: DataFrame, weights: dict[str, float], profile: str = "f1_max", k: int = 60, limit: int = 100) -> DataFrame:
    """Weighted fusion of channel x granularity routes: (query_id, key, score, rank).

    ``hits``: query_id, channel, granularity, key, rank. Weights are normalised over the channels.
    ``f0`` sums weighted reciprocal ranks over all routes. ``f1_max`` and ``f1_rrf`` first fuse inside
    each granularity, rank again there, and then take the largest, or the sum, of the reciprocal new
    ranks. Ties go by key. Repeated identical hits count once.
    """
    total = sum(weights.values())
    w = F.create_map(*(x for c, v in weights.items() for x in (F.lit(c), F.lit(v / total))))[F.col("channel")]
    rows = hits.select("query_id", "channel", "granularity", "key", "rank").distinct().where(F.col("channel").isin(list(weights)))
    one = w / (k + F.col("rank"))
    if profile == "f0":
        scored = rows.groupBy("query_id", "key").agg(F.round(F.sum(one), 12).alias("score"))
    else:
        inner = rows.groupBy("query_id", "granularity", "key").agg(F.round(F.sum(one), 12).alias("s"))
        inner = inner.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "granularity").orderBy(F.desc("s"), "key")))
        again = 1.0 / (k + F.col("r"))
        scored = inner.groupBy("query_id", "key").agg(F.round(F.max(again) if profile == "f1_max" else F.sum(again), 12).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= limit)


def contract_violations(hits: DataFrame) -> DataFrame:
    """(query_id, channel, granularity, problem) of routes that break the fusion contract.

    Problems: two keys at one position, one key at two positions, positions that are not 1..n.
    """
    route = ["query_id", "channel", "granularity"]
    rows = hits.select(*route, "key", "rank").distinct()
    s = rows.groupBy(*route).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    problems = F.array_compact(F.array(F.when(F.col("ranks") < F.col("n"), "position taken twice"), F.when(F.col("keys") < F.col("n"), "key at two positions"), F.when((F.col("lo") != 1) | (F.col("hi") != F.col("ranks")), "positions not contiguous")))
    return s.select(*route, F.explode(problems).alias("problem"))


def fuse_two_ranks(ranked: DataFrame, first: str, second: str, w_first: float = 0.35, w_second: float = 0.65, k: int = 60) -> DataFrame:
    """``ranked`` (query_id, key, two rank columns) with score and rank of their weighted reciprocal sum."""
    score = F.round(w_first / (k + F.col(first)) + w_second / (k + F.col(second)), 12)
    return ranked.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), first, "key")))


def stable_rerank(scored: DataFrame) -> DataFrame:
    """``scored`` (query_id, key, rank, score) with new_rank by score, then old rank, then key. Null scores come last."""
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank", "key")))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax probability of the first of two logits."""
    return 1 / (1 + F.exp(no - yes))


def containment(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(by, key): hits of one query of which the text of ``key`` stands whole in that of ``by``; equal texts cover each other.

    ``hits``: query_id, key; ``texts``: key, text. Only the hits of a query meet, so that the work is
    bounded by the depth of retrieval. Null and empty texts neither cover nor are covered.
    """

    def run(group):
        rows = list(zip(group["key"], group["text"]))
        found = [(a, b) for a, outer in rows for b, inner in rows if a != b and len(inner) <= len(outer) and inner in outer]
        return pd.DataFrame({"by": [x[0] for x in found], "key": [x[1] for x in found]}, dtype=group["key"].dtype)

    kind = dict(hits.dtypes)["key"]
    held = hits.select("query_id", "key").distinct().join(texts.where("text <> ''"), "key")
    return held.groupBy("query_id").applyInPandas(run, f"by {kind}, key {kind}").distinct()


def defer_covered(ranked: DataFrame, covers: DataFrame, limit: int = 100) -> DataFrame:
    """Candidates covered by one earlier main candidate moved behind all main ones.

    ``ranked``: query_id, key, rank; ``covers``: by, key (key's parts all lie within by's). Gives
    ``ranked`` with main, final_rank and disposition (selected, selected_refill, outside). The
    candidates of a query, bounded by the depth of its list, are decided in one pass.
    """
    earlier = ranked.select("query_id", F.col("key").alias("by"), F.col("rank").alias("by_rank"))
    links = ranked.join(covers, "key").join(earlier, ["query_id", "by"]).where("by_rank < rank").groupBy("query_id", "key").agg(F.collect_set("by").alias("covered_by"))
    rows = ranked.select("query_id", "key", "rank").join(links, ["query_id", "key"], "left")

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        main: set = set()
        flags = []
        for key, by in zip(part["key"], part["covered_by"]):
            free = by is None or not main.intersection(by)
            if free:
                main.add(key)
            flags.append(free)
        part = part.assign(main=flags)
        part = pd.concat([part[part["main"]], part[~part["main"]]])
        place = np.arange(1, len(part) + 1)
        part["final_rank"] = place
        part["disposition"] = np.where(place > limit, "outside", np.where(part["main"], "selected", "selected_refill"))
        return part[["query_id", "key", "rank", "main", "final_rank", "disposition"]]

    kind = dict(ranked.dtypes)
    return rows.groupBy("query_id").applyInPandas(decide, f"query_id {kind['query_id']}, key {kind['key']}, rank int, main boolean, final_rank int, disposition string")


def mmr(candidates: DataFrame, depth: int = 50, keep: int = 10, lam: float = 0.7, protect: int = 3, gap: float = 0.1) -> DataFrame:
    """Maximal marginal relevance with protected leaders: ``candidates`` (query_id, key, score, embedding) with pick.

    The pool is the best ``depth`` by score. A candidate's loss is its min-max distance from the best
    score; the first ``protect`` with a loss of at most ``gap`` are taken as they are. Then the largest
    lam * (1 - loss) - (1 - lam) * max(0, cosine to the picked) is picked again and again; ties go to
    the better relevance rank. Embeddings must be unit vectors.
    """
    pool = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= depth)

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        s = part["score"].to_numpy(np.float64)
        span = s.max() - s.min()
        loss = (s.max() - s) / span if span > 0 else np.zeros(len(s))
        chosen = [i for i in range(min(protect, len(s))) if loss[i] <= gap]
        near = np.zeros(len(s))
        for i in chosen:
            near = np.maximum(near, v @ v[i])
        left = [i for i in range(len(s)) if i not in chosen]
        while left and len(chosen) < keep:
            value = np.round(lam * (1 - loss[left]) - (1 - lam) * near[left], 12)
            i = left.pop(int(np.argmax(value)))
            chosen.append(i)
            near = np.maximum(near, v @ v[i])
        out = part.iloc[chosen[:keep]][["query_id", "key", "rank", "score"]].copy()
        out["pick"] = np.arange(1, len(out) + 1)
        return out

    kind = dict(candidates.dtypes)
    return pool.groupBy("query_id").applyInPandas(pick, f"query_id {kind['query_id']}, key {kind['key']}, rank int, score double, pick int")


def supplement(base: DataFrame, donor: DataFrame, most: int = 20) -> DataFrame:
    """``base`` (query_id, key, rank) followed by up to ``most`` donor-only candidates in donor order."""
    extra = donor.join(base.select("query_id", "key"), ["query_id", "key"], "left_anti")
    extra = extra.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key"))).where(F.col("n") <= most)
    size = base.groupBy("query_id").agg(F.max("rank").alias("size"))
    extra = extra.join(size, "query_id", "left").select("query_id", "key", (F.coalesce("size", F.lit(0)) + F.col("n")).alias("rank"), F.lit("supplement").alias("part"))
    return base.select("query_id", "key", "rank", F.lit("base").alias("part")).unionByName(extra)


def within_budget(prefix: Column, content: Column, suffix: Column, budget: int) -> tuple[Column, Column]:
    """Columns prompt and cut: token arrays joined so that ``budget`` holds; prefix and suffix stay whole, the content loses its end."""
    room = F.greatest(F.lit(0), F.lit(budget) - F.size(prefix) - F.size(suffix))
    return F.array_join(F.concat(prefix, F.slice(content, F.lit(1), room), suffix), " ").alias("prompt"), (F.size(content) > room).alias("cut")


def covering_sample(rows: DataFrame, key: str, category: str, seed: str, size: int) -> DataFrame:
    """(key, category, for_coverage): ``size`` rows in hash order, the first of every category before all others.

    Only ``size`` rows of a category and then of the whole can be chosen, so that no task sorts more.
    """
    h = hash_order(F.lit(seed), F.col(key))
    c = rows.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy("_h"))).where(F.col("_n") <= size)
    top = c.orderBy(F.col("_n") > 1, "_h").limit(size)
    return top.select(key, category, (F.col("_n") == 1).alias("for_coverage"))


def hash_order(*parts: Column) -> Column:
    """A reproducible pseudo-random order: the SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def nested_quota(rows: DataFrame, queue: str, entity: str, key: str, per_entity: int, quotas: dict[str, int]) -> DataFrame:
    """Rows in key order with at most ``per_entity`` of an entity and then ``quotas[queue]`` of a queue, with slot."""
    first = rows.withColumn("_e", F.row_number().over(Window.partitionBy(queue, entity).orderBy(key))).where(F.col("_e") <= per_entity)
    quota = F.create_map(*(x for q, n in quotas.items() for x in (F.lit(q), F.lit(n))))[F.col(queue)]
    return first.withColumn("slot", F.row_number().over(Window.partitionBy(queue).orderBy(key))).where(F.col("slot") <= quota).drop("_e")


def disjoint_selection(rows: DataFrame, stratum: str, key: str, sources: tuple[str, str], seed: str, quota: int, page: int = 1000) -> DataFrame:
    """Per stratum, ``quota`` rows in hash order such that no source occurs twice over all strata, which are taken in order.

    Gives every row of ``rows`` as (stratum, key, place, disposition): selected, source used, or quota full.
    The chosen rows (quota times the number of strata, a stated bound) are found on the driver: a
    stratum's candidates are read in hash order, ``page`` at a time and without those whose sources are
    taken already, until the quota is full or no candidate is left. Null strata take no part.
    """
    a, b = sources
    ordered = rows.where(F.col(stratum).isNotNull()).select(stratum, key, a, b, hash_order(F.lit(seed), F.col(stratum), F.col(key)).alias("_h"))
    used: set = set()
    chosen: list[tuple] = []
    for (s,) in ordered.select(stratum).distinct().orderBy(stratum).collect():
        taken, after = 0, None
        while taken < quota:
            left = ordered.where(F.col(stratum) == s)
            if used:
                left = left.where(~F.coalesce(F.col(a).isin(list(used)), F.lit(False)) & ~F.coalesce(F.col(b).isin(list(used)), F.lit(False)))
            if after is not None:
                left = left.where(F.struct("_h", key) > F.struct(F.lit(after[0]), F.lit(after[1])))
            found = left.orderBy("_h", key).limit(page).collect()
            for r in found:
                if taken < quota and not {r[a], r[b]} & used:
                    used |= {r[a], r[b]} - {None}
                    chosen.append((s, r[key], r["_h"]))
                    taken += 1
            if len(found) < page:
                break
            after = (found[-1]["_h"], found[-1][key])
    kind = dict(rows.dtypes)
    picked = rows.sparkSession.createDataFrame(chosen, f"_s {kind[stratum]}, _k {kind[key]}, _ph string")
    last = picked.groupBy(F.col("_s").alias("_ls")).agg(F.count("*").alias("_n"), F.max("_ph").alias("_last"))
    out = ordered.join(F.broadcast(picked), (F.col(stratum) == F.col("_s")) & (F.col(key) == F.col("_k")), "left").join(F.broadcast(last), F.col(stratum) == F.col("_ls"), "left")
    word = F.when(F.col("_k").isNotNull(), "selected").when((F.col("_n") == quota) & (F.col("_h") > F.col("_last")), "quota full").otherwise("source used")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    return out.select(stratum, key, place.alias("place"), word.alias("disposition"))


def spread(rows: DataFrame, source: str, key: str, most: int = 4) -> DataFrame:
    """At most ``most`` evenly spaced rows of each source in key order (half-even rounding of the positions)."""
    w = Window.partitionBy(source)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count("*").over(w))
    slots = F.when(F.col("_n") <= most, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(most - 1)), 0).cast("long")))
    return r.where(F.array_contains(slots.cast("array<long>"), F.col("_i").cast("long"))).drop("_i", "_n")


def round_robin(hits: DataFrame, query: str, lane: str, key: str, rank: str, most: int) -> DataFrame:
    """(query, key, place): lanes read in turn, each in its own order; a key read before in another lane is passed over."""
    first = hits.withColumn("_again", F.row_number().over(Window.partitionBy(query, key).orderBy(rank, lane))).where("_again = 1")
    return first.select(query, key, F.row_number().over(Window.partitionBy(query).orderBy(rank, lane)).alias("place")).where(F.col("place") <= most)


def matched(anchors: DataFrame, controls: DataFrame, stratum: str, anchor: str, control: str, size: str) -> DataFrame:
    """(stratum, anchor, control, distance): for each anchor in order the unused control of the nearest size, ties to the smaller key.

    Anchors, a chosen few, are held by the driver's plan per stratum: an anchor can only take one of the
    nearest controls, as many as there are anchors of its stratum on either side of its size, and only
    those candidates (a number that does not grow with the controls) reach the sequential step.
    """
    kind = dict(anchors.dtypes) | dict(controls.dtypes)
    a = anchors.select(stratum, F.col(anchor).alias("anchor"), F.col(size).alias("size"))
    n = a.groupBy(stratum).agg(F.count("*").alias("n"))
    c = controls.select(stratum, F.col(control).alias("control"), F.col(size).alias("csize")).join(F.broadcast(n), stratum)
    # n controls of one size are enough: more of them can never all be used
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "csize").orderBy("control"))).where(F.col("_k") <= F.col("n"))
    side = a.select(stratum, F.col("size").alias("at"), F.lit(None).cast(kind[control]).alias("control"), F.col("anchor")).unionByName(c.select(stratum, F.col("csize").alias("at"), "control", F.lit(None).cast(kind[anchor]).alias("anchor")))
    up = Window.partitionBy(stratum).orderBy("at", F.col("anchor").isNotNull())
    marks = side.withColumn("_u", F.count("control").over(up)).join(F.broadcast(n), stratum)
    edges = marks.where("anchor is not null").select(F.col(stratum).alias("_s"), (F.col("_u") - F.col("n")).alias("_lo"), (F.col("_u") + F.col("n")).alias("_hi")).distinct()
    near = marks.where("control is not null").join(F.broadcast(edges), (F.col(stratum) == F.col("_s")) & (F.col("_u") > F.col("_lo")) & (F.col("_u") <= F.col("_hi")), "left_semi").select(stratum, "control", F.col("at").alias("csize"))
    both = a.select(stratum, F.lit(0).alias("kind"), F.col("anchor").cast("string").alias("key"), "size").unionByName(near.select(stratum, F.lit(1).alias("kind"), F.col("control").cast("string").alias("key"), F.col("csize").alias("size")))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        left = [(int(s), k) for k, s in part[part["kind"] == 1][["key", "size"]].itertuples(index=False)]
        out = []
        for k, s in sorted(part[part["kind"] == 0][["key", "size"]].itertuples(index=False), key=lambda x: (len(x[0]), x[0])):
            if not left:
                break
            best = min(left, key=lambda x: (abs(x[0] - s), len(x[1]), x[1]))
            left.remove(best)
            out.append((part[stratum].iloc[0], k, best[1], abs(best[0] - int(s))))
        return pd.DataFrame(out, columns=[stratum, anchor, control, "distance"])

    found = both.groupBy(stratum).applyInPandas(choose, f"{stratum} {kind[stratum]}, {anchor} string, {control} string, distance long")
    return found.select(stratum, F.col(anchor).cast(kind[anchor]).alias(anchor), F.col(control).cast(kind[control]).alias(control), "distance")
