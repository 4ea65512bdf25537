"""Exact and near duplicates, survivors, decontamination and literal matching outside the training package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.grams import with_gram_sets
from ..functions.codepoints import code_points, gram_hashes, gram_positions

_BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def exact_groups(rows: DataFrame, key: str, norm: Column) -> DataFrame:
    """(key, survivor, copies): every row's smallest key among rows of equal normalised text, and their number."""
    h = rows.select(F.col(key).alias("key"), F.sha2(norm, 256).alias("h")).where("h is not null")
    g = h.groupBy("h").agg(F.min("key").alias("survivor"), F.countDistinct("key").alias("copies"))
    return h.join(g, "h").select("key", "survivor", "copies").distinct()


#: Characters that are worked on at once, at some 100 bytes each.
CHARS = 1 << 20


def _pieces(batches, *texts: str):
    """Batches cut into stretches of rows of at most CHARS characters, or one row."""
    for b in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.utf8_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHARS, "right")))
            yield b.slice(i, j - i)
            i = j


def _compared(n: int):
    """Sizes of intersection and union of the n-gram sets of two texts a row, a whole batch at a time."""

    def run(batches):
        for b in _pieces(batches, "ta", "tb"):
            rows, grams = [], []
            for c in ("ta", "tb"):
                points, offsets = code_points(b.column(c))
                at, row = gram_positions(offsets, n)
                rows.append(row)
                grams.append(gram_hashes(points, n)[at] if len(at) else np.zeros(0, np.uint64))
            side = np.repeat(np.arange(2), [len(x) for x in rows])
            row, gram = np.concatenate(rows), np.concatenate(grams)
            order = np.lexsort((side, gram, row))
            row, gram, side = row[order], gram[order], side[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
            either = np.bincount(row[new], minlength=b.num_rows)
            shared = np.bincount(row[1:][~new[1:] & (side[1:] != side[:-1])], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("ha"), b.column("hb"), pa.array(shared, pa.int32()), pa.array(either, pa.int32())], names=["ha", "hb", "shared", "either"])

    return run


#: Counters of the frequency sketch that orders the grams: 2 MB sent, whatever the number of texts; they are summed in so many blocks.
SKETCH, BLOCKS = 1 << 20, 64
#: Grams a counter of a set's own sketch, which bounds what two sets can share; the least number of counters; a counter of 255 stands for more.
CELL, CELLS, FULL = 4, 128, 255
#: Grams that a task's index holds, 16 bytes each, and increments and counters of a step of the counting.
INDEXED, STEP = 12_000_000, 1_500_000
#: Sets of at most so many grams travel whole, 8 bytes a gram, so that pairs of them are decided where they meet; bits of their bitmaps.
SHORT, BITS = 128, 512


def _gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text of a batch: (row, hash), by row and hash; the last bits of a hash make room for the row."""
    points, offsets = code_points(column)
    at, row = gram_positions(offsets, n)
    grams = gram_hashes(points, n)[at] if len(at) else np.zeros(0, np.uint64)
    bits = np.uint64(max(1, len(column).bit_length()))
    both = np.sort(row.astype(np.uint64) << np.uint64(64) - bits | grams >> bits)
    both = both[np.concatenate([np.ones(1, bool), both[1:] != both[:-1]])] if len(both) else both
    return (both >> np.uint64(64) - bits).astype(np.int64), both << bits


def _shares(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets of these sizes: what they share at least with a similar set that is not smaller, what with any similar set, and the depth."""
    either, larger = -(-size * percent // 100), -(-2 * size * percent // (100 + percent))
    return larger, either, np.minimum(either, 2 + size // 48)


def _span(percent: int) -> float:
    return 3 * np.log(100 / min(percent, 80))


def _cells(k: int, percent: int) -> int:
    """Counters of a set's sketch in a task of class k: the power of two that suits the class's middle."""
    return max(CELLS, 1 << int(np.exp(_span(percent) * (k + 0.5)) / CELL).bit_length()) if np.exp(_span(percent) * (k + 1)) * 100 / percent > SHORT else 0


def _whole_sets(column: pa.Array, n: int, short: np.ndarray) -> list[bytes]:
    """The distinct 64-bit n-grams of the short texts of a batch, nothing for the others."""
    points, offsets = code_points(column)
    at, row = gram_positions(offsets, n)
    at, row = at[short[row]], row[short[row]]
    grams = gram_hashes(points, n)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[new], grams[new]
    edges = np.searchsorted(row, np.arange(len(short) + 1))
    return [grams[i:j].tobytes() for i, j in zip(edges, edges[1:])]


def _groups(indexed: np.ndarray, percent: int) -> list[int]:
    """Tasks of each class: so many that an index stays small, and more for the cores, above all if its sets are so short that sending them again costs little."""
    most = [8 if np.exp(_span(percent) * (k + 1)) <= 100 else 2 for k in range(len(indexed))]
    held = [INDEXED // 4 if np.exp(_span(percent) * k) <= SHORT else INDEXED for k in range(len(indexed))]  # whole sets are held as well
    return [max(-(-int(x) // h), min(m, -(-int(x) // 50_000))) for x, m, h in zip(indexed, most, held)]


def _classes(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each size, and the least class of a similar set that is not larger. A class spans three steps of the similarity, so that most sets have one class to look in."""
    of = lambda x: (np.log(np.maximum(x, 1)) / _span(percent)).astype(np.int64)
    return of(size), of(-(-size * percent // 100))


def _sketched(n: int, percent: int):
    """A partition's numbers of grams a bucket in eighths of powers of two, which travel as a byte each, and of indexed grams a class."""

    def run(batches):
        total, most = np.zeros(SKETCH, np.int64), np.zeros(64, np.int64)
        for b in _pieces(batches, "t"):
            row, grams = _gram_sets(b.column("t"), n)
            total += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
            size = np.bincount(row, minlength=b.num_rows)
            larger, _, depth = _shares(size, percent)
            most += np.bincount(np.minimum(_classes(size, percent)[0], 63), size - larger + depth, minlength=64).astype(np.int64)
        parts = np.minimum(np.rint(8 * np.log2(1.0 + total)), 255).astype(np.uint8).reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS + 1), pa.int32()), pa.array([*(x.tobytes() for x in parts), most.tobytes()], pa.binary())], names=["block", "counts"])

    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            part = np.frombuffer(x, np.int64) if k == BLOCKS else np.exp2(np.frombuffer(x, np.uint8) / 8) - 1
            total[k] = total[k] + part if k in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.int64 if k == BLOCKS else np.float32).tobytes() for k, x in total.items()], pa.binary())], names=["block", "counts"])


def _signatures(counts, groups: list[int], n: int, percent: int):
    """Rows (task, probe, h, size, grams, cells, whole): every set goes to one task's index with its rarest grams, and as a probe to all that index sets it may be similar to.

    Grams are ordered by the sketch and then by themselves; they travel as 32 bits, which can only add meetings.
    """
    firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(groups)])

    def run(batches):
        known: set[int] = set()
        for b in _pieces(batches, "t"):
            names = b.column("h").to_pylist()
            fresh = [i for i, h in enumerate(names) if h not in known and not known.add(h)]
            if not fresh:
                continue
            b = b.take(pa.array(fresh))
            h = b.column("h").to_numpy(zero_copy_only=False)
            row, grams = _gram_sets(b.column("t"), n)
            size = np.bincount(row, minlength=len(h))
            starts = np.cumsum(size) - size
            often = counts.value[(grams >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
            low = np.sort(row.astype(np.uint64) << np.uint64(42) | often << np.uint64(32) | grams >> np.uint64(32)).astype(np.uint32)
            cell_of = ((grams >> np.uint64(24)) & np.uint64((1 << 20) - 1)).astype(np.int64)
            larger, either, depth = _shares(size, percent)
            own, least = (np.minimum(x, len(groups) - 1) for x in _classes(size, percent))
            whole = _whole_sets(b.column("t"), n, size <= SHORT)
            out = []
            for i in range(len(h)):
                at, end = starts[i], starts[i] + size[i]
                cells = {k: np.minimum(np.bincount(cell_of[at:end] % m, minlength=m), FULL).astype(np.uint8).tobytes() if (m := _cells(k, percent)) else b"" for k in range(least[i], own[i] + 1)}
                place = int(firsts[own[i]] + int(h[i]) % groups[own[i]])
                out.append((place, 0, i, low[at : at + size[i] - larger[i] + depth[i]].tobytes(), cells[own[i]]))
                probe = low[at : at + size[i] - either[i] + depth[i]].tobytes()
                out += [(int(t), 1, i, probe, cells[k]) for k in range(least[i], own[i] + 1) for t in range(firsts[k], firsts[k + 1])]
            at = np.array([x[2] for x in out], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array(h[at]), pa.array(size[at], pa.int32()), pa.array([x[3] for x in out], pa.binary()), pa.array([x[4] for x in out], pa.binary()), pa.array([whole[x[2]] for x in out], pa.binary())], names=["task", "probe", "h", "size", "grams", "cells", "whole"])

    return run


def _joined(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _first_of_each(h: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(h, return_index=True)[1])


class _Whole:
    """Whole short sets of a task as numbers of the index's grams, with a bitmap of BITS bits each."""

    def __init__(self, column: pa.Array, words: np.ndarray | None = None):
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        grams, row = _joined(column, np.uint64), np.repeat(np.arange(len(lengths)), lengths)
        bit, ends = (grams >> np.uint64(30)).astype(np.int64) % BITS, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.bits = np.zeros((len(lengths), BITS // 64), np.uint64)
        for i in range(0, len(lengths), 1 << 14):
            j = min(i + (1 << 14), len(lengths))
            bits = np.zeros((j - i, BITS), np.uint8)
            bits[row[ends[i] : ends[j]] - i, bit[ends[i] : ends[j]]] = 1
            self.bits[i:j] = np.packbits(bits, axis=1).view(np.uint64)
        self.lost = lengths - np.bitwise_count(self.bits).sum(1, dtype=np.int64)  # grams that share a bit with another one of the set
        self.words = np.unique(grams) if words is None else words
        at = np.searchsorted(self.words, grams)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == grams[known]
        self.grams = at[known].astype(np.uint64)
        self.edges = np.searchsorted(row[known], np.arange(len(lengths) + 1))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The grams of the sets x, with the place in x in the upper 32 bits."""
        many = self.edges[x + 1] - self.edges[x]
        at = np.arange(many.sum()) + np.repeat(self.edges[x] - np.cumsum(many) + many, many)
        return np.repeat(np.arange(len(x), dtype=np.uint64) << np.uint64(32), many) | self.grams[at]


class _Index:
    """Indexed sets of a task, and the probes that may be similar to one of them."""

    def __init__(self, batches: list[pa.RecordBatch], percent: int):
        t = pa.Table.from_batches(batches)
        t = t.take(pa.array(_first_of_each(t.column("h").to_numpy()))).combine_chunks()
        self.h, self.size = t.column("h").to_numpy(), t.column("size").to_numpy().astype(np.int64)
        self.cells = np.concatenate([_joined(c, np.uint8) for c in t.column("cells").chunks]).reshape(len(self.h), -1)
        self.depth, self.percent = _shares(self.size, percent)[2], percent
        self.whole = _Whole(pa.concat_arrays(t.column("whole").chunks))
        lengths = np.concatenate([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in t.column("grams").chunks]).astype(np.int64) // 4
        grams = np.concatenate([_joined(c, np.uint32) for c in t.column("grams").chunks])
        self.shift = np.uint32(32 - min(24, max(12, len(grams).bit_length() + 1)))
        bucket = grams >> self.shift
        self.owners = np.repeat(np.arange(len(self.h), dtype=np.uint32), lengths)[np.argsort(bucket, kind="stable")]
        self.edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(bucket, minlength=1 << 32 - int(self.shift)))])

    def met(self, b: pa.RecordBatch):
        """Rows (ha, hb, shared, either) of pairs that share enough of their rarest grams and may share enough of all; whole sets are decided, other pairs have noughts."""
        b = b.take(pa.array(_first_of_each(b.column("h").to_numpy(zero_copy_only=False))))
        h, size = b.column("h").to_numpy(zero_copy_only=False), b.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        cells, depth = _joined(b.column("cells"), np.uint8).reshape(len(h), -1), _shares(size, self.percent)[2]
        whole = _Whole(b.column("whole"), self.whole.words)
        lengths = pc.binary_length(b.column("grams")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        bucket = _joined(b.column("grams"), np.uint32) >> self.shift
        start, many = self.edges[bucket], self.edges[bucket.astype(np.int64) + 1] - self.edges[bucket]
        ends = np.cumsum(lengths)
        work = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])[ends]  # increments up to each probe
        n, least, i = len(self.h), int(min(self.depth.min(), depth.min())), 0
        dense = work[-1] * 8 > n * len(h)  # few meetings are sorted, many counted in an array of all cells
        most = STEP // n if dense else ((1 << 32) - 1) // n
        while i < len(h):
            done = work[i - 1] if i else 0
            j = max(i + 1, min(i + most, int(np.searchsorted(work, done + STEP, "right"))))
            lo, hi = ends[i] - lengths[i], ends[j - 1]
            m = many[lo:hi]
            at = np.arange(m.sum()) + np.repeat(start[lo:hi] - np.cumsum(m) + m, m)
            cell = self.owners[at] + np.repeat(np.repeat(np.arange(j - i, dtype=np.uint32), lengths[i:j]) * np.uint32(n), m)
            if dense:
                count = np.bincount(cell, minlength=(j - i) * n)
                hit = np.flatnonzero(count >= least)
                count = count[hit]
            else:
                cell.sort()
                hit = cell[: len(cell) - least + 1][cell[: len(cell) - least + 1] == cell[least - 1 :]] if len(cell) >= least else cell[:0]
                edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(hit)), bool), hit[1:] != hit[:-1]]))
                count = np.diff(np.append(edge, len(hit))) + least - 1
                hit = hit[edge].astype(np.int64)
            y, x = i + hit // n, hit % n
            nx, ny = self.size[x], size[y]
            ok = (count >= np.minimum(self.depth[x], depth[y])) & (nx * 100 >= ny * self.percent) & ((nx < ny) | ((nx == ny) & (self.h[x] < h[y])))
            x, y = x[ok], y[ok]
            short = (self.size[x] <= SHORT) & (size[y] <= SHORT)
            yield from self._decided(x[short], y[short], h, size, whole)
            yield from self._bounded(x[~short], y[~short], h, size, cells)
            i = j

    def _decided(self, x, y, h, size, whole):
        for k in range(0, len(x), 1 << 17):
            a, c = x[k : k + (1 << 17)], y[k : k + (1 << 17)]
            both = self.size[a] + size[c]
            least = -(-both * self.percent // (100 + self.percent))
            close = np.bitwise_count(self.whole.bits[a] & whole.bits[c]).sum(1, dtype=np.int64) + np.minimum(self.whole.lost[a], whole.lost[c]) >= least
            a, c, both, least = a[close], c[close], both[close], least[close]
            grams = np.sort(np.concatenate([self.whole.of(a), whole.of(c)]))
            shared = np.bincount((grams[1:][grams[1:] == grams[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))
            close = shared >= least
            yield self.h[a[close]], h[c[close]], shared[close], (both - shared)[close]

    def _bounded(self, x, y, h, size, cells):
        step = max(1, (1 << 23) // max(1, self.cells.shape[1]))
        for k in range(0, len(x), step):
            a, c = x[k : k + step], y[k : k + step]
            least = np.minimum(self.cells[a], cells[c])
            bound = least.sum(1, dtype=np.int64)
            close = (bound * 100 >= (self.size[a] + size[c] - bound) * self.percent) | (least == FULL).any(1)
            none = np.zeros(close.sum(), np.int64)
            yield self.h[a[close]], h[c[close]], none, none


def _meetings(percent: int):
    """Rows (ha, hb, n, either) of a task's pairs, and (h, h, size, size) of each indexed set; tasks come one after another, the index first."""

    def pairs(a, b, n, either):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(either, pa.int32())], names=["ha", "hb", "n", "either"])

    def run(batches):
        now, held, index = None, [], None
        for whole in batches:
            tasks = whole.column("task").to_numpy(zero_copy_only=False)
            probes = whole.column("probe").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (probes[1:] != probes[:-1])) + 1), whole.num_rows] if whole.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                b = whole.slice(lo, hi - lo)
                if tasks[lo] != now:
                    if held:
                        index = _Index(held, percent)
                        yield pairs(index.h, index.h, index.size, index.size)
                    now, held, index = tasks[lo], [], None
                if not probes[lo]:
                    held.append(b)
                    continue
                if held:
                    index = _Index(held, percent)
                    held = []
                    yield pairs(index.h, index.h, index.size, index.size)
                for a, c, n, either in index.met(b) if index else ():
                    if len(a):
                        yield pairs(a, c, n, either)
        if held:
            index = _Index(held, percent)
            yield pairs(index.h, index.h, index.size, index.size)

    return run


def similar_pairs(rows: DataFrame, key: str, text: str, n: int = 3, percent: int = 80) -> DataFrame:
    """Pairs (a, b, shared, either) of keys whose n-gram sets have Jaccard similarity of at least ``percent``.

    Exact, by prefix filtering: in one order of all grams, two sets that share s grams or more share
    at least d among the first |set| - s + d of either, for any d up to s; d grows with the sets, so that
    large ones with a few rare grams in common don't become candidates. Any order will do; rare ones
    come first by a sketch of their frequencies, of fixed size. Sets meet in tasks of alike sizes, where
    the smaller is indexed and the other looks it up; meetings are counted in arrays and never become rows.
    Short sets travel whole, are bounded by bitmaps and decided there. What longer ones can share is
    bounded by counters of all their grams, and the few pairs left are compared on the whole texts, in whole numbers. Grams are 64-bit hashes there (a set of a thousand grams
    loses one to a collision with probability 3e-14) and 50 bits or more before it (1e-9 at most). Equal texts are compared once and their keys
    attached at the end.
    """
    from ..session import cut, shuffle_partitions

    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("key"), F.col(text).alias("t")).where(F.col("key").isNotNull() & (F.length("t") >= n)).withColumn("h", F.xxhash64("t"))
    sent = base.select("t").mapInArrow(_sketched(n, percent), "block int, counts binary").repartition(shuffle_partitions(spark), "block")
    blocks = {r.block: bytes(r.counts) for r in sent.mapInArrow(_summed, "block int, counts binary").collect()}
    sketch = np.zeros(SKETCH, np.float32)  # its values become levels of a sixteenth of a power of two, below 2^10
    for k, x in blocks.items():
        if k < BLOCKS:
            sketch[k * (SKETCH // BLOCKS) : (k + 1) * (SKETCH // BLOCKS)] = np.frombuffer(x, np.float32)
    most = np.frombuffer(blocks[BLOCKS], np.int64) if BLOCKS in blocks else np.zeros(64, np.int64)
    groups = _groups(most, percent)
    signed = base.select("h", "t").mapInArrow(_signatures(spark.sparkContext.broadcast(np.minimum(np.rint(16 * np.log2(1 + sketch)), 1023).astype(np.uint16)), groups, n, percent), "task int, probe int, h long, size int, grams binary, cells binary, whole binary")
    parts = max(shuffle_partitions(spark), sum(groups))
    met = cut(signed.repartitionById(parts, F.col("task")).sortWithinPartitions("task", "probe").mapInArrow(_meetings(percent), "ha long, hb long, n int, either int"))
    cand = met.where("ha <> hb and n = 0").select("ha", "hb").distinct()
    cand = cut(cand)
    wanted = cand.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    texts = cut(base.select("h", "t").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("t").alias("t")))
    side = lambda x: texts.select(F.col("h").alias(f"h{x}"), F.col("t").alias(f"t{x}"))
    both = cand.join(side("a"), "ha").join(side("b"), "hb").mapInArrow(_compared(n), "ha long, hb long, shared int, either int")
    close = both.where(F.col("shared") * 100 >= F.col("either") * percent).select("ha", "hb", "shared", "either")
    close = close.unionByName(met.where("ha <> hb and n > 0").select("ha", "hb", F.col("n").alias("shared"), "either").distinct())
    keys = base.select("h", "key").distinct()
    sizes = met.where("ha = hb").select(F.col("ha").alias("h"), F.col("n").alias("size")).distinct()
    twice = keys.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").join(sizes, "h").select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.col("size").alias("shared"), F.col("size").alias("either"))
    out = close.unionByName(twice).join(keys.select(F.col("h").alias("ha"), F.col("key").alias("ka")), "ha").join(keys.select(F.col("h").alias("hb"), F.col("key").alias("kb")), "hb")
    out = out.where(((F.col("ha") != F.col("hb")) & (F.col("ka") != F.col("kb"))) | (F.col("ka") < F.col("kb")))
    return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "shared", "either")


def visible_aliases(rows: DataFrame, key: str, same: list[str], kind: str) -> DataFrame:
    """(kept, alias): rows that stand exactly twice with equal values of ``same`` and of two kinds; the smaller key is kept.

    Texts meet as their SHA-256, counted before the shuffle; rows with a null among ``same`` take no part.
    """
    clean = rows.where(" and ".join(f"{c} is not null" for c in same))
    g = clean.groupBy(F.sha2(F.concat_ws("\x1f", *(F.sha2(c, 256) for c in same)), 256).alias("_h")).agg(F.min(key).alias("kept"), F.max(key).alias("alias"), F.count("*").alias("n"), F.countDistinct(kind).alias("kinds"))
    return g.where("n = 2 and kinds = 2").select("kept", "alias")


#: Pairs that one task solves in the order of their keys, which are all it holds.
SOLVED = 1_000_000


def _in_order(batches):
    """Keys (key) that are rejected, of a bounded number of pairs: a key is decided when all pairs with smaller ones are."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    names = pc.unique(pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(t.column(c), value_set=names).to_numpy() for c in ("a", "b"))
    order = np.argsort(b, kind="stable")
    lost = bytearray(len(names))
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        if not lost[i]:
            lost[j] = 1
    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.flatnonzero(np.frombuffer(lost, np.uint8))))], names=["key"])


def greedy_survivors(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, kept) where keys are taken in order and one is rejected if a kept neighbour comes before it.

    ``keys``: key; ``pairs``: a, b with a < b. The pairs are made once and solved in rounds: keys without a
    smaller neighbour are kept, their neighbours rejected, and only pairs of undecided keys stay for the next
    round. The least undecided key of every component is decided in each round. As soon as no more than
    SOLVED pairs are left, one task solves them in order, so that long chains cost no more rounds.
    """
    from ..session import cut

    left = pairs = cut(pairs.select("a", "b"))
    out = pairs.select(F.col("b").alias("key")).limit(0)
    while n := left.count():
        if n <= SOLVED:
            out = out.unionByName(left.coalesce(1).mapInArrow(_in_order, f"key {dict(left.dtypes)['b']}"))
            break
        roots = left.select("a").join(left.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        lost = cut(left.join(roots, "a", "left_semi").select(F.col("b").alias("key")).distinct())
        out = out.unionByName(lost)
        left = left.join(lost.withColumnRenamed("key", "b"), "b", "left_anti").join(lost.withColumnRenamed("key", "a"), "a", "left_anti")
        left = cut(left.join(roots, "a", "left_anti").select("a", "b"))
    return keys.select("key").distinct().join(out.withColumn("x", F.lit(True)), "key", "left").select("key", F.col("x").isNull().alias("kept"))


def _window_hashes(key: str, window: int):
    """Distinct hashes of all windows of a text without its white space, a whole batch at a time."""

    def run(batches):
        for b in batches:
            points, offsets = code_points(b.column("text"))
            keep = ~np.isin(points, _BLANKS)
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[offsets]
            at, row = gram_positions(bounds, window)
            pairs = np.unique(np.stack([row.astype(np.uint64), gram_hashes(points[keep], window)[at] if len(at) else np.zeros(0, np.uint64)]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=[key, "w"])

    return run


def contaminated(rows: DataFrame, key: str, tests: DataFrame, test_key: str, window: int) -> DataFrame:
    """(key, test_key) where both texts (column text) share a run of ``window`` characters, white space ignored.

    Windows meet as 64-bit hashes; the windows of the test side are few, so that the join keeps
    only touched ones. Null texts share nothing.
    """
    cut = lambda df, k: df.select(k, "text").where(F.col("text").isNotNull()).mapInArrow(_window_hashes(k, window), f"{k} {dict(df.dtypes)[k]}, w long")
    return cut(rows, key).join(cut(tests, test_key), "w").select(key, test_key).distinct()


def rejected(rows: DataFrame, key: str, tests: DataFrame, test_key: str, window: int = 8, percent: int = 50) -> DataFrame:
    """(key, test_key, reason) of rows that must not be used beside the tests: exact, window or similar, the first that holds.

    Exact are equal texts without white space; windows are runs of ``window`` characters without white
    space; similar are 3-gram sets with a Jaccard similarity of ``percent`` or more. Similar pairs that
    share no window are found by shared grams: those of the tests, which are few, are joined with the
    rows' and counted, so that no pair is missed. Null texts and texts under three characters are left out.
    """
    squeeze = lambda df, k, name: df.select(F.col(k).alias(name), T.without_space(F.col("text")).alias(f"t_{name}")).where(F.length(f"t_{name}") >= 3)
    a, b = squeeze(rows, key, "k"), squeeze(tests, test_key, "q")
    sets = lambda df, name: with_gram_sets(df, f"t_{name}", 3)
    grams = lambda df, name: sets(df, name).select(name, F.explode("g").alias("g"))
    size = lambda df, name: sets(df, name).select(name, F.size("g").alias(f"n_{name}"))
    shared = grams(a, "k").join(grams(b, "q"), "g").groupBy("k", "q").agg(F.count("*").alias("c")).join(size(a, "k"), "k").join(size(b, "q"), "q")
    similar = shared.where(F.col("c") * 100 >= (F.col("n_k") + F.col("n_q") - F.col("c")) * percent).select("k", "q", F.lit(3).alias("r"))
    exact = a.join(b, F.col("t_k") == F.col("t_q")).select("k", "q", F.lit(1).alias("r"))
    windows = contaminated(rows.withColumnRenamed(key, "k") if key != "k" else rows, "k", tests.withColumnRenamed(test_key, "q") if test_key != "q" else tests, "q", window).select("k", "q", F.lit(2).alias("r"))
    least = exact.unionByName(windows).unionByName(similar).groupBy("k", "q").agg(F.min("r").alias("r"))
    return least.select(F.col("k").alias(key), F.col("q").alias(test_key), F.element_at(F.array(*map(F.lit, ("exact", "window", "similar"))), F.col("r")).alias("reason"))


def literal_matches(rows: DataFrame, key: str, patterns: list[tuple[int, str]]) -> DataFrame:
    """(key, pattern_id, start) of all occurrences of patterns in the column text, white space ignored.

    ``patterns`` is a bounded list that the caller holds; each task builds one automaton of it.
    Patterns without visible characters are left out.
    """
    clean = [(i, "".join(p.split())) for i, p in patterns if p and "".join(p.split())]

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        ids: dict[str, list[int]] = {}
        for i, p in clean:
            ids.setdefault(p, []).append(i)
        for p in ids:
            automaton.add_word(p, p)
        if ids:
            automaton.make_automaton()
        for b in batches:
            keys, found, starts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for end, p in automaton.iter("".join(t.split())) if t and ids else ():
                    for i in ids[p]:
                        keys.append(k)
                        found.append(i)
                        starts.append(end - len(p) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(found, pa.int64()), pa.array(starts, pa.int32())], names=[key, "pattern_id", "start"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, pattern_id long, start int")


def paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, text): the lines of the column text with visible characters, and where each begins."""

    def run(batches):
        for b in batches:
            at, starts, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                offset = 0
                for line in (t or "").splitlines(keepends=True):
                    if not line.isspace():
                        at.append(i)
                        starts.append(offset)
                        texts.append(line.rstrip("\r\n"))
                    offset += len(line)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], names=[key, "start", "text"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, start int, text string")


class _Subsequences:
    """Lengths of the longest common subsequences of a text and several short ones at once, bit by bit in one long integer.

    Every text has a stretch of bits with a free one behind it, which takes the carry.
    """

    def __init__(self, texts: list[str]):
        self.places, self.masks, self.full = [], {}, 0
        at = 0
        for t in texts:
            for i, c in enumerate(t):
                self.masks[c] = self.masks.get(c, 0) | 1 << at + i
            self.places.append((at, len(t)))
            self.full |= (1 << len(t)) - 1 << at
            at += len(t) + 1

    def lengths(self, text: str) -> list[int]:
        v, full, masks = self.full, self.full, self.masks
        for c in text:
            if u := v & masks.get(c, 0):
                v = (v + u | v - u) & full
        return [n - (v >> at & (1 << n) - 1).bit_count() for at, n in self.places]


def _counted(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Every character with how often it stood before in its row, in the order of the input; rows share as many of these as the matching of two texts can have at most."""
    order = np.lexsort((points, rows))
    p, r = points[order].astype(np.int64), rows[order]
    first = np.concatenate([np.ones(1, bool), (p[1:] != p[:-1]) | (r[1:] != r[:-1])])
    at = np.arange(len(p))
    out = np.empty(len(p), np.int64)
    out[order] = p << 32 | at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def near_paragraphs(rows: DataFrame, tests: list[tuple[int, str]], least: float = 0.8, chars: int = 60, block: int = 90) -> DataFrame:
    """(*columns of rows without text, test_id, ratio, longest): all paragraphs close to a test paragraph, white space ignored.

    Close are two paragraphs of at least ``chars`` characters with a matching-block ratio (Ratcliff and
    Obershelp, the test first) of at least ``least``, or any two that share a run of ``block`` characters.
    The reference compares only the 12 paragraphs that share most 5-grams with a test; here every pair
    is decided, equal ones too. No pair is passed over but by bounds that the ratio can't exceed: of
    lengths, then of common characters, then of the longest common subsequence. Shared runs are found by hashes
    of all runs of the tests. ``tests`` is a bounded list that the caller holds; rows take one pass without
    a shuffle, and equal texts of a batch are worked on once.
    """
    clean = [(i, c) for i, t in tests if t and len(c := "".join(t.split())) >= min(chars, block)]
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        from difflib import SequenceMatcher

        points, offsets = code_points(pa.array([t for _, t in clean], pa.string()))
        sizes = np.diff(offsets)
        marks = np.repeat(np.arange(len(clean)), sizes)
        words, at = np.unique(_counted(points, marks) if len(points) else np.zeros(0, np.int64), return_inverse=True)
        has = np.zeros((len(words) + 1, len(clean)), np.uint8)  # the last row is that of all other words
        has[at, marks] = 1
        places, owners = gram_positions(offsets, block)
        runs = gram_hashes(points, block)[places] if len(places) else np.zeros(0, np.uint64)
        order = np.argsort(runs, kind="stable")
        runs, owners = runs[order], owners[order]
        alike = sorted(range(len(clean)), key=lambda j: (len(set(clean[j][1])) * 4 > len(clean[j][1]), len(clean[j][1])))  # tests that are met together
        groups = [alike[i : i + 16] for i in range(0, len(alike), 16)]
        group_of = {j: (g, i) for g, own in enumerate(groups) for i, j in enumerate(own)}
        together = [_Subsequences([clean[j][1] for j in own]) for own in groups]

        def compared(text: str, pairs: list[tuple[int, bool]]) -> list[tuple[int, float, int]]:
            """Those of the pairs (place of a test, whether a run is shared) that are close to the text."""
            out, lengths = [], {}
            for j, shares in pairs:
                a = clean[j][1]
                if not shares:
                    g, i = group_of[j]
                    if g not in lengths:
                        lengths[g] = together[g].lengths(text)
                    if 2 * lengths[g][i] < least * (len(a) + len(text)) - 1e-9:
                        continue
                m = SequenceMatcher(None, a, text, autojunk=False)
                ratio, longest = m.ratio(), m.find_longest_match().size
                if min(len(a), len(text)) >= chars and ratio >= least or longest >= block:
                    out.append((clean[j][0], ratio, longest))
            return out

        def close(texts: list[str]) -> list[list[tuple[int, float, int]]]:
            """What each of some texts is close to."""
            points, offsets = code_points(pa.array(texts, pa.string()))
            lengths = np.diff(offsets)
            fits = (np.minimum(lengths[:, None], sizes) >= chars) & (2 * np.minimum(lengths[:, None], sizes) >= least * (lengths[:, None] + sizes) - 1e-9)
            some = np.flatnonzero(fits.any(1))
            if len(some):
                inside = np.repeat(fits.any(1), lengths)
                tokens = _counted(points[inside], np.repeat(np.arange(len(some)), lengths[some]))
                spot = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
                spot = np.where(words[spot] == tokens, spot, len(words))
                edges = np.cumsum(lengths[some]) - lengths[some]
                common = np.add.reduceat(has[spot], edges, axis=0, dtype=np.int32)
                fits[some] &= 2 * common >= least * (lengths[some][:, None] + sizes) - 1e-9
            pairs: list[dict[int, bool]] = [{} for _ in texts]
            for i, j in zip(*np.nonzero(fits)):
                pairs[i][int(j)] = False
            places, inside = gram_positions(offsets, block)
            if len(places) and len(runs):
                h = gram_hashes(points, block)[places]
                low, high = np.searchsorted(runs, h), np.searchsorted(runs, h, "right")
                for k in np.flatnonzero(high > low):
                    pairs[inside[k]] |= {int(j): True for j in owners[low[k] : high[k]]}
            return [compared(t, list(p.items())) if p else [] for t, p in zip(texts, pairs)]

        for b in batches:
            whole = ["".join(t.split()) if t else "" for t in b.column(len(names)).to_pylist()]
            texts = list(dict.fromkeys(t for t in whole if len(t) >= min(chars, block))) if clean else []
            known = {}
            start = 0
            while start < len(texts):  # so many texts that their characters by tests are some 16 million
                end, room = start + 1, (1 << 24) // len(clean) - len(texts[start])
                while end < len(texts) and len(texts[end]) <= room:
                    room -= len(texts[end])
                    end += 1
                known |= {t: f for t, f in zip(texts[start:end], close(texts[start:end])) if f}
                start = end
            out = [(i, *f) for i, t in enumerate(whole) if t in known for f in known[t]]
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(names))), pa.array([x[1] for x in out], pa.int64()), pa.array([round(x[2], 6) for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int32())], names=[*names, "test_id", "ratio", "longest"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", test_id long, ratio double, longest int")
