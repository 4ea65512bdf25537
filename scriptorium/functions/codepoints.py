"""Texts of a whole Arrow batch as one array of code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the column's texts one after another, and the n+1 offsets of the texts.

    A null counts as an empty text. No string is touched row by row.
    """
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    raw = column.buffers()
    edges = np.frombuffer(raw[1], np.int32, len(column) + 1, column.offset * 4)
    data = memoryview(raw[2])[edges[0] : edges[-1]] if raw[2] is not None and len(column) else b""
    points = np.frombuffer(str(data, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32) if len(data) else np.zeros(0, np.uint32)
    return points, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; grown by doubling and kept by the worker."""
    for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
        have = _powers.get(name, np.ones(1, np.uint64))
        while len(have) <= n:
            have = np.concatenate([have, have * np.uint64(pow(b, len(have), 1 << 64))])
        _powers[name] = have
    return _powers["up"], _powers["down"]


def gram_hashes(points: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k code points, mixed to even 64-bit words.

    Position i holds the hash of points[i:i+k]; runs that cross the end of a text must be masked
    by the caller. The rolling sums are prefix sums, so the whole batch costs a few vector steps.
    """
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power_table(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points + np.uint64(seed * 0x10001 + 0x5851F42D)) * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])


def gram_positions(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all runs of k code points inside one text, and the row of each."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(rows)) - first[rows] + offsets[:-1][rows], rows


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each of the runs points[start:end]."""
    up, down = _power_table(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points + np.uint64(seed * 0x10001 + 0x5851F42D)) * up[: len(points)], out=sums[1:])
    body = (sums[ends] - sums[starts]) * down[starts]
    return mix64(body + mix64((ends - starts).astype(np.uint64) + np.uint64(seed + 1)))


def text_hashes(points: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each text of the batch."""
    return span_hashes(points, offsets[:-1], offsets[1:], seed)


def batch(*columns: np.ndarray | pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
