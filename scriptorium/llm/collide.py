"""Which keys are held by more than one owner, at a few bytes a key.

Similarity and overlap operators emit many 64-bit keys a row, nearly all of which meet no other.
Here the keys travel as packed binary blocks instead of rows: a map task sorts its keys, splits
them by leading bits and sends one block per partition; the receiving task sorts what it gets and
passes on only the members of keys with two owners or more. Those few become ordinary rows, which
Spark joins with its own handling of skew.

A key that many rows hold never gathers in one task: owners that meet inside one map task are
passed on there, and only one of them travels on, marked, to tell the other tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions

#: Keys that a map task gathers before it sends its blocks: 24 bytes each.
CHUNK_KEYS = 3_000_000
#: Keys that a receiving task is meant to hold, if their number is known.
KEYS_A_TASK = 8_000_000

PACKED = "bucket int, keys binary, owners binary, extras binary, marks binary, key bigint, owner bigint, extra bigint"
Emit = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sorted(keys: np.ndarray, *others: np.ndarray, tell: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """All arrays in the order of ``keys``; where equal keys differ in ``tell``, which comes first of the others then, also by that."""
    order = np.argsort(keys, kind="stable")
    if tell is not None and len(keys):
        k, t = keys[order], tell[order]
        if ((k[1:] == k[:-1]) & (t[1:] != t[:-1])).any():
            order = np.lexsort((tell, keys))
    return keys[order], *(x[order] for x in others)


def _runs(keys: np.ndarray, tell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in sorted ``keys`` (and ``tell``), and for each key the number of its run."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if tell is not None:
        new[1:] |= tell[1:] != tell[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _held_twice(runs: tuple[np.ndarray, np.ndarray], owners: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Whether the key of a run has two owners (or a marked one), by position."""
    starts, run = runs
    twice = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
    if marks is not None:
        twice |= np.maximum.reduceat(marks, starts).astype(bool)
    return twice[run]


def _rows(key: np.ndarray, owner: np.ndarray, extra: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), none, none, none, none, pa.array(key.view(np.int64)), pa.array(owner), pa.array(extra, pa.int64())],
        names=["bucket", "keys", "owners", "extras", "marks", "key", "owner", "extra"],
    )


def _narrow(keys: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each key; its leading bits are told by the block's number."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width])


def _widen(data: bytes, bucket: int, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    keys = out.view(np.uint64).ravel()
    return keys | np.uint64(bucket << 8 * width) if width < 8 else keys


def _send(keys: np.ndarray, owners: np.ndarray, extras: np.ndarray, buckets: int, width: int, wide: bool) -> Iterator[pa.RecordBatch]:
    owners, extras = owners.astype(np.int64, copy=False), extras.astype(np.int64 if wide else np.int32, copy=False)  # as the blocks are read
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    if width < 8:
        keys = keys & np.uint64((1 << 8 * width) - 1) | bucket << np.uint64(8 * width)
    keys, owners, extras, bucket = _sorted(keys, owners, extras, bucket, tell=extras >> 32 if wide else None)
    again = np.zeros(len(keys), bool)  # one owner's repeated entries count once
    again[1:] = (keys[1:] == keys[:-1]) & (owners[1:] == owners[:-1]) & (extras[1:] == extras[:-1])
    if again.any():
        keys, owners, extras, bucket = (x[~again] for x in (keys, owners, extras, bucket))
    runs = _runs(keys, extras >> 32 if wide else None)
    twice = _held_twice(runs, owners)
    if twice.any():
        at = np.flatnonzero(twice)
        spread = (np.arange(len(at)) * 2654435761 % buckets).astype(np.int32)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield _rows(keys[part], owners[part], extras[part], spread[i : i + 100_000])
    first = np.zeros(len(keys), bool)
    first[runs[0]] = True
    keep = ~twice | first
    keys, owners, extras, bucket, marks = keys[keep], owners[keep], extras[keep], bucket[keep], twice[keep].astype(np.uint8)
    order = np.lexsort((owners, bucket))  # equal owners side by side pack to almost nothing
    keys, owners, extras, marks, bucket = (x[order] for x in (keys, owners, extras, marks, bucket))
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    present = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    cut = lambda x: [x[edges[b] : edges[b + 1]].tobytes() for b in present]
    n = len(present)
    yield pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int32()), *(pa.array(cut(x), pa.binary()) for x in (_narrow(keys, width), owners, extras, marks)), *(pa.nulls(n, pa.int64()) for _ in range(3))],
        names=["bucket", "keys", "owners", "extras", "marks", "key", "owner", "extra"],
    )


def _pack(emit: Emit, buckets: int, chunk: int, width: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(emit(batch))
                size += len(held[-1][0])
            if size >= chunk:
                yield from _send(*map(np.concatenate, zip(*held)), buckets, width, wide)
                held, size = [], 0
        if size:
            yield from _send(*map(np.concatenate, zip(*held)), buckets, width, wide)

    return run


def _meet(width: int, wide: bool):
    """Members of keys with two owners, bucket by bucket; a task has one bucket, whose keys it holds at 24 bytes each."""

    def met(blocks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, owners, extras, marks = map(np.concatenate, blocks)
        keys, owners, extras, marks = _sorted(keys, owners, extras, marks, tell=extras >> 32 if wide else None)
        out = np.flatnonzero(_held_twice(_runs(keys, extras >> 32 if wide else None), owners, marks) & (marks == 0))
        for i in range(0, len(out), 100_000):
            at = out[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(owners[at]), pa.array(extras[at], pa.int64())], names=["key", "owner", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[list] = [[], [], [], []]
        now = None
        for batch in batches:
            plain = batch.filter(pc.is_valid(batch.column("key")))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column(c) for c in ("key", "owner", "extra")], names=["key", "owner", "extra"])
            packed = batch.filter(pc.is_valid(batch.column("keys")))
            for bucket, *data in zip(*(packed.column(c).to_pylist() for c in ("bucket", "keys", "owners", "extras", "marks"))):
                if bucket != now and blocks[0]:
                    yield from met(blocks)
                    blocks = [[], [], [], []]
                now = bucket
                blocks[0].append(_widen(data[0], bucket, width))
                for held, x, kind in zip(blocks[1:], data[1:], (np.int64, np.int64 if wide else np.int32, np.uint8)):
                    held.append(np.frombuffer(x, kind))
        if blocks[0]:
            yield from met(blocks)

    return run


def colliding(df: DataFrame, emit: Emit, chunk: int = CHUNK_KEYS, width: int = 8, wide: bool = False, most_keys: int | None = None) -> DataFrame:
    """Rows (key, owner, extra) of every key that two or more owners hold; the other keys are left out.

    ``emit`` turns a record batch of ``df`` into arrays of keys (uint64, evenly spread), owners
    (int64) and extras (int32). Repeated (key, owner) entries count as one owner. Null texts are
    the emitter's business; an empty input gives an empty result. ``width`` is the number of bytes of
    a key that travel (the block number adds leading bits): 8 keeps keys whole, fewer are for callers
    that verify what they get, to whom a chance meeting is one more candidate. With ``wide`` extras
    are int64 and their upper 32 bits belong to the key, which then has 96 bits. A caller that can
    bound the number of its keys states it in ``most_keys``; there are then at least so many
    partitions that one holds KEYS_A_TASK keys.
    """
    parts = max(shuffle_partitions(df.sparkSession), -(-(most_keys or 0) // KEYS_A_TASK))
    sent = df.mapInArrow(_pack(emit, parts, chunk, width, wide), PACKED)
    return sent.repartitionById(parts, F.col("bucket")).mapInArrow(_meet(width, wide), "key bigint, owner bigint, extra bigint")
