"""Long exact spans shared between records, and repeated lines.

Units are lines, trimmed of white space: their digests are grouped globally, every copy is shared
as a whole, and of a line held by many records only the first and the last owner (in the order of
their numbers) go on to the next step; the rest is removed there, with its offsets kept for the
result. A shared passage may also start and end inside lines, so that line digests alone can't give
all spans; the exact check behind them hashes windows of ``least`` code points at every offset of
what is left. Windows are not sent wholesale: each is first represented by the smallest hash of the
half-length runs inside it (winnowing). A window that occurs in two records has the same
representative in both, so only windows whose representative is held by two records are hashed in
full, with 96 bits (a line is named by 64 bits and its length). Two kept owners suffice: whoever else holds part of such a line meets at least
one of them that is another record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import code_points, gram_hashes, gram_positions, span_hashes
from ..functions.lines import numbered_lines
from ..session import cut
from .collide import colliding

_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x3000], np.uint32)


def representatives(points: np.ndarray, least: int) -> np.ndarray:
    """For every start of a window of ``least`` code points, the least hash of the runs of half that length."""
    k = least // 2
    low = gram_hashes(points, k)
    width, have = least - k + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        shift = width - have
        low = np.minimum(low[:-shift], low[shift:])
    return low


def _emit_representatives(least: int):
    def emit(b: pa.RecordBatch):
        points, offsets = code_points(b.column("text"))
        at, rows = gram_positions(offsets, least)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        low = representatives(points, least)[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
        space = b.column("space").to_numpy(zero_copy_only=False)[rows[new]].astype(np.uint64)
        return low[new] + space * np.uint64(0x9E3779B97F4A7C15), b.column("rid").to_numpy(zero_copy_only=False)[rows[new]], np.zeros(int(new.sum()), np.int32)

    return emit


def _lines(points: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines of ``least`` code points or more, white space at their ends left out."""
    n = len(points)
    breaks = points == 0x0A
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(breaks), np.flatnonzero(breaks) + 1]))
    starts, ends = cuts[:-1], cuts[1:]
    shown = ~np.isin(points, _BLANKS)
    after = np.minimum.accumulate(np.where(shown, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    before = np.maximum.accumulate(np.where(shown, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    starts, ends = after[starts], before[ends - 1] + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    keep = ends - starts >= least
    return starts[keep], ends[keep], rows[keep]


def _emit_lines(least: int):
    """Lines as keys of 64 bits and, with their starts in the extras, their lengths, which belong to the key."""

    def emit(b: pa.RecordBatch):
        points, offsets = code_points(b.column("text"))
        starts, ends, rows = _lines(points, offsets, least)
        space = b.column("space").to_numpy(zero_copy_only=False)[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return span_hashes(points, starts, ends) + space, b.column("rid").to_numpy(zero_copy_only=False)[rows], (ends - starts) << 32 | starts - offsets[:-1][rows]

    return emit


def _placed(offset: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An offset in the lower and 32 bits of a second hash in the upper half of one number."""
    return (second & np.uint64(0xFFFFFFFF00000000)).view(np.int64) | offset.astype(np.int64)


def _emit_windows(least: int):
    def emit(b: pa.RecordBatch):
        points, offsets = code_points(b.column("text"))
        at, rows = gram_positions(offsets, least)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = b.column("space").to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        low = representatives(points, least)[at] + space[rows]
        wanted = b.column("keys")
        held = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        keep = np.isin(low, held)  # a key wanted by another text of the batch only adds work, never a wrong row
        removed = b.column("removed")
        if len(removed.flatten()):
            gone = np.zeros(len(points) + 1, np.int64)  # windows that start and end inside a removed line
            counts = pc.fill_null(pc.list_value_length(removed), 0).to_numpy(zero_copy_only=False)
            line = removed.flatten().to_numpy(zero_copy_only=False)
            first = (line & 0xFFFFFFFF) + offsets[:-1][np.repeat(np.arange(len(counts)), counts)]
            np.add.at(gone, first, 1)
            np.add.at(gone, first + (line >> 32) - least + 1, -1)
            keep &= np.cumsum(gone)[at] == 0
        at, rows = at[keep], rows[keep]
        first, second = (gram_hashes(points, least, seed)[at] for seed in (0, 1))
        return first + space[rows], b.column("rid").to_numpy(zero_copy_only=False)[rows], _placed(at - offsets[:-1][rows], second)

    return emit


def _merge(least: int):
    kind = pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32())]))

    def run(batches):
        for b in batches:
            spans = []
            for starts, whole in zip(b.column("starts").to_pylist(), b.column("lines").to_pylist()):
                starts, line = (np.asarray(x or [], np.int64) for x in (starts, whole))
                first = line & 0xFFFFFFFF
                ends = first + (line >> 32)
                pairs = np.stack([np.concatenate([starts, first]), np.concatenate([starts + least, ends])])
                pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
                reach = np.maximum.accumulate(pairs[1])
                new = np.flatnonzero(pairs[0][1:] > reach[:-1]) + 1
                spans.append([{"span_start": int(x), "span_end": int(y)} for x, y in zip(pairs[0][np.r_[0, new]], reach[np.r_[new - 1, len(reach) - 1]])])
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(spans, kind)], names=["rid", "spans"])

    return run


def shared_spans(records: DataFrame, least: int = 40) -> DataFrame:
    """Maximal runs (origin, item_key, span_start, span_end) of characters that another record also has.

    ``records``: origin, item_key, text; records are compared within one origin. A character counts
    if it lies in a run of at least ``least`` code points that also occurs in another record; runs
    that touch or overlap are one. Rows of one key count once; null keys, null texts and texts under
    ``least`` give no rows. Offsets are 0-based and half-open. Texts held by several records are
    compared once, named by the 64-bit hash of (origin, text), and are shared as a whole.
    """
    rows = records.select("origin", "item_key", "text").where(F.col("item_key").isNotNull() & (F.length("text") >= least))
    rows = rows.withColumn("rid", F.xxhash64("origin", "text")).withColumn("space", F.xxhash64("origin"))
    items = cut(rows.select("origin", "item_key", "rid", F.length("text").alias("n")).distinct())
    texts = rows.groupBy("rid", "space").agg(F.first("text").alias("text"))
    lines = cut(colliding(rows.select("rid", "space", "text"), _emit_lines(least), wide=True).select("key", "owner", "extra", F.shiftright("extra", 32).alias("tell")))
    ends = lines.groupBy("key", "tell").agg(F.min("owner").alias("first"), F.max("owner").alias("last"))
    kept = F.col("owner").isin(F.col("first"), F.col("last"))
    lines = lines.join(ends, ["key", "tell"]).groupBy(F.col("owner").alias("rid")).agg(F.collect_set("extra").alias("lines"), F.collect_set(F.when(~kept, F.col("extra"))).alias("removed"))
    seeds = colliding(rows.select("rid", "space", "text"), _emit_representatives(least))
    hits = seeds.groupBy(F.col("owner").alias("rid")).agg(F.collect_set("key").alias("keys"))
    touched = texts.join(hits, "rid").join(lines.select("rid", "removed"), "rid", "left")
    windows = colliding(touched, _emit_windows(least), wide=True)
    found = windows.groupBy(F.col("owner").alias("rid")).agg(F.collect_set(F.col("extra").bitwiseAND(0xFFFFFFFF).cast("int")).alias("starts"))
    found = found.join(lines.select("rid", "lines"), "rid", "full")
    found = found.mapInArrow(_merge(least), "rid long, spans array<struct<span_start:int, span_end:int>>")
    copies = items.groupBy("rid").agg(F.min("item_key").alias("lo"), F.max("item_key").alias("hi")).where("lo < hi").select("rid", F.lit(True).alias("copied"))
    whole = F.array(F.struct(F.lit(0).alias("span_start"), F.col("n").alias("span_end")))
    out = items.join(found, "rid", "left").join(copies, "rid", "left")
    return out.select("origin", "item_key", F.explode(F.when(F.col("copied"), whole).otherwise(F.col("spans"))).alias("s")).select("origin", "item_key", "s.span_start", "s.span_end")


def shared_amount(records: DataFrame, least: int = 40) -> DataFrame:
    """For each record of ``records``: its length and how many of its characters are shared elsewhere."""
    total = shared_spans(records, least).groupBy("origin", "item_key").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("spans"))
    items = records.where(F.col("item_key").isNotNull() & F.col("text").isNotNull()).groupBy("origin", "item_key").agg(F.max(F.length("text")).alias("n_chars"))
    return items.join(total, ["origin", "item_key"], "left").select("origin", "item_key", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"))


def repeated_lines(docs: DataFrame, least: int = 12) -> DataFrame:
    """Later occurrences (doc_id, line_no, span_start, span_end, first_doc_id) of lines that repeat.

    ``docs``: doc_id, text. Lines are cut at line feeds and trimmed of blanks; lines under ``least``
    characters are left alone. The earliest occurrence in the order (doc_id, line_no) is kept; every
    other is reported with its offsets in the stored text, ready for removal. Digests are
    pre-aggregated before the shuffle, so that a line held by a third of all rows is one row there.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(numbered_lines("text")).alias("l")).select("doc_id", "l.*")
    lines = lines.withColumn("unit", F.trim("line")).where(F.length("unit") >= least)
    lines = lines.select("doc_id", "line_no", "span_start", (F.col("span_start") + F.length("line")).alias("span_end"), F.sha2("unit", 256).alias("digest"))
    first = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = lines.join(first.select("digest", "first"), "digest").where(F.struct("doc_id", "line_no") > F.col("first"))
    return out.select("doc_id", "line_no", "span_start", "span_end", F.col("first.doc_id").alias("first_doc_id"))
