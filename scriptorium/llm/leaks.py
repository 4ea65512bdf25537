"""Evaluation passages inside training text, by greedy string tiling over Karp-Rabin seeds.

Both sides are reduced to letters and digits of one case and width (compatibility decomposition,
composition of marks, lower case), every text by the same vectorised rule. A window of ``least``
characters is represented by its seed, the least hash of the half-length runs inside it, so that
equal windows have equal seeds. The seeds of the items make a bit filter of bounded size; one pass
over the documents keeps the regions whose windows have a seed in the filter. Regions meet items by
a join on seeds, and each touched pair of document and item is tiled: the longest match not yet
covered is marked again and again, until no match of ``least`` characters is left, so that passages
moved about are still found. The tiles give the item's coverage.

Neither side is ever drawn to the driver; only the filter is, whose size has a stated bound. A
filter that is too small for the items lets more regions through, which the join then drops.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import _power_table, code_points, gram_positions, mix64
from ..session import cut
from .compose import compose, expand, table_of
from .spans import representatives

#: Largest filter, in bits: 32 MB.
FILTER_BITS = 1 << 28
RESULT = "doc_id long, item_id long, tiles int, covered int, longest int, coverage double"
_BETWEEN = 0xFFFFF  # a code point of no text, between two regions


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compatibility expansions (offsets and values), and the lower-case letter or digit of each code point, 0 if dropped."""
    every = np.arange(0x110000, dtype=np.uint32)
    special: dict[int, list[int]] = {}
    kept = np.zeros(0x110000, np.uint32)
    for cp in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        c = chr(cp)
        form = unicodedata.normalize("NFKD", c)
        if form != c:
            special[cp] = list(map(ord, form))
        if c.isalnum():
            low = c.lower()
            kept[cp] = ord(low[0]) if low[0].isalnum() else cp
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x323B0)):  # ideographs and syllables are themselves
        kept[lo:hi] = np.where(np.fromiter((chr(cp).isalnum() for cp in range(lo, hi)), bool, hi - lo), every[lo:hi], 0)
    return (*table_of(special), kept)


def kept_characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a column of texts, in one case and width, with the offsets of the texts."""
    edges, flat, kept = _tables()
    points, bounds = compose(*expand(*code_points(column), edges, flat))
    out = kept[points]
    keep = out > 0
    return out[keep], np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[bounds]


class _Windows:
    """Karp-Rabin hashes of the windows of any length of one text, from one prefix sum."""

    def __init__(self, points: np.ndarray):
        up, self.down = _power_table(len(points))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points + np.uint64(0x5851F42D)) * up[: len(points)], out=self.sums[1:])

    def hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.down[at]


def _free(used: np.ndarray) -> np.ndarray:
    """For every position the number of unmarked ones from there on."""
    at = np.where(used, np.arange(len(used)), len(used))
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(used))


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two code-point arrays: (start in doc, start in item, length), longest first.

    Each round finds, by bisection over window hashes, the greatest length at which unmarked
    windows of both meet, and marks the meeting ones from left to right (the leftmost free partner
    of the item each). Work grows with the lengths and the number of different tile lengths, never
    with the number of equal windows, so that repetitive texts cost no more than others.
    """
    if min(len(doc), len(item)) < least:
        return []
    a, b = _Windows(doc), _Windows(item)
    used_a, used_b = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    top = min(len(doc), len(item))
    while True:
        free_a, free_b = _free(used_a), _free(used_b)

        def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            at_a, at_b = np.flatnonzero(free_a >= n), np.flatnonzero(free_b >= n)  # noqa: B023
            h_a, h_b = a.hashes(n, at_a), b.hashes(n, at_b)
            meet_a = np.isin(h_a, h_b)
            return at_a[meet_a], h_a[meet_a], at_b, h_b

        if not len(shared(least)[0]):
            return tiles
        lo, hi = least, min(top, int(free_a.max()), int(free_b.max()))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(shared(mid)[0]) else (lo, mid - 1)
        at_a, h_a, at_b, h_b = shared(lo)
        order = np.lexsort((at_b, h_b))
        at_b, h_b = at_b[order], h_b[order]
        first, end = np.searchsorted(h_b, h_a), np.searchsorted(h_b, h_a, "right")
        next_of: dict[int, int] = {}
        stop = -1
        for i, h, f, e in zip(at_a.tolist(), h_a.tolist(), first.tolist(), end.tolist()):
            if i < stop:
                continue
            k = next_of.get(h, f)
            while k < e and used_b[at_b[k] : at_b[k] + lo].any():
                k += 1  # marks are never taken back, so that a passed partner stays passed
            next_of[h] = k
            if k < e:
                j = int(at_b[k])
                if (doc[i : i + lo] == item[j : j + lo]).all():
                    used_a[i : i + lo] = used_b[j : j + lo] = True
                    tiles.append((i, j, lo))
                    stop = i + lo
        top = lo if tiles and tiles[-1][2] == lo else lo - 1  # lo - 1 only if all that met were unequal texts of one hash
        if top < least:
            return tiles


def _seeds(least: int, name: str):
    """Distinct seeds (id, seed) of the items' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, offsets = kept_characters(b.column("text"))
            at, rows = gram_positions(offsets, least)
            low = representatives(points, least)[at] if len(at) else np.zeros(0, np.uint64)
            pairs = np.unique(np.stack([rows.astype(np.uint64), low]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(name).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=[name, "seed"])

    return run


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Words of a bit array in which the slot of each seed is set; at most bits / 64 rows come to the driver."""
    shift = 64 - int(np.log2(bits))
    slots = seeds.select(F.shiftrightunsigned("seed", shift).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _regions(bitmap, bits: int, least: int):
    """Regions (doc_id, region, body, seeds) of the documents under windows with a seed in the filter."""
    shift = np.uint64(64 - int(np.log2(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for b in batches:
            ids, at, body, seeds = [], [], [], []
            points, offsets = kept_characters(b.column("text"))
            starts, rows = gram_positions(offsets, least)
            low = representatives(points, least)[starts] if len(starts) else np.zeros(0, np.uint64)
            slot = low >> shift
            hit = np.flatnonzero(known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            starts, rows, low = starts[hit], rows[hit], low[hit]
            new = np.ones(len(starts), bool)
            new[1:] = (np.diff(starts) > least) | (np.diff(rows) != 0)
            edges = np.append(np.flatnonzero(new), len(starts))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                ids.append(int(rows[s]))
                at.append(int(starts[s] - offsets[rows[s]]))
                body.append(points[starts[s] : starts[e - 1] + least].tobytes())
                seeds.append(np.unique(low[s:e]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(body, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                names=["doc_id", "region", "body", "seeds"],
            )

    return run


def _tiled(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts, offsets = kept_characters(b.column("text"))
            for i, (doc_id, item_id, regions) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), b.column("regions").to_pylist())):
                item = texts[offsets[i] : offsets[i + 1]]
                parts = [x for r in regions for x in (np.frombuffer(r["body"], np.uint32), np.array([_BETWEEN], np.uint32))]
                tiles = tile(np.concatenate(parts), item, least)
                if tiles:
                    covered = sum(t[2] for t in tiles)
                    out.append((doc_id, item_id, len(tiles), covered, max(t[2] for t in tiles), covered / len(item)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "tiles", "covered", "longest", "coverage"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least: int = 40, least_coverage: float = 0.0, filter_bits: int | None = None) -> DataFrame:
    """Pairs (doc_id, item_id, tiles, covered, longest, coverage) of documents and the items found in them.

    ``docs``: doc_id, text; ``items``: item_id, text. Null ids and texts and items with fewer than
    ``least`` letters and digits are never found. Several rows of one doc_id are one document of
    several regions; of several rows of one item_id the greatest text counts. ``coverage`` is the
    share of the item's characters under tiles; pairs below ``least_coverage`` are left out. Passages
    of fewer than ``least`` characters are no leak. The order and the batches of the rows don't
    matter. ``filter_bits`` (a power of two, at least 64) sets the size of the filter, which else has
    1,024 bits a seed up to FILTER_BITS; no size changes the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text"))
    seeds = cut(items.mapInArrow(_seeds(least, "item_id"), "item_id long, seed long"))
    if filter_bits is None:
        filter_bits = 1 << max(16, min(int(np.log2(FILTER_BITS)), int(np.ceil(np.log2(1024 * max(seeds.count(), 1))))))
    bitmap = spark.sparkContext.broadcast(_filter(seeds, filter_bits))
    regions = cut(docs.mapInArrow(_regions(bitmap, filter_bits, least), "doc_id long, region int, body binary, seeds array<long>"))
    touched = regions.select("doc_id", "region", F.explode("seeds").alias("seed")).join(seeds, "seed").select("doc_id", "region", "item_id").distinct()
    held = touched.join(regions.select("doc_id", "region", "body"), ["doc_id", "region"])
    pairs = held.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set(F.struct("region", "body"))).alias("regions")).join(items, "item_id")
    found = pairs.select("doc_id", "item_id", "regions", "text").mapInArrow(_tiled(least), RESULT)
    return found.where(F.col("coverage") >= least_coverage)
