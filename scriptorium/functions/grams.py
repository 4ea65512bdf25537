"""Sets of character n-grams of whole texts as sorted hashes, in vectorised Arrow passes linear in the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import code_points, gram_hashes, gram_positions, span_hashes


def with_gram_sets(rows: DataFrame, text: str, n: int, name: str = "g") -> DataFrame:
    """``rows`` without the column ``text`` but with its distinct n-grams as a sorted array of 64-bit hashes; null and short texts have none."""
    others = [c for c in rows.columns if c != text]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, offsets = code_points(b.column(len(others)))
            at, row = gram_positions(offsets, n)
            grams = gram_hashes(points, n)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
            new = np.ones(len(grams), bool)
            new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
            edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(row[new], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.ListArray.from_arrays(pa.array(edges), pa.array(grams[new]))], names=[*others, name])

    return rows.select(*others, F.col(text)).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + f", {name} array<bigint>")


_LOWER: list[np.ndarray] = []


def _lower_table() -> np.ndarray:
    """For each code point its lower-case one (the first, where there are several)."""
    if not _LOWER:
        table = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x20000):
            table[cp] = ord(chr(cp).lower()[0])
        _LOWER.append(table)
    return _LOWER[0]


def bag_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of ``text.bag`` for a whole batch of texts: row and 64-bit hash of every Han character and every run of ASCII letters and digits."""
    low = _lower_table()[points]
    han = (low >= 0x3400) & (low <= 0x9FFF)
    word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(low), bool)
    before[1:] = word[:-1] & (points[:-1] != 0x130)  # a dotted capital I leaves a mark behind it, which ends the run
    starts = np.flatnonzero(han | (word & (~before | edge[:-1])))
    after = np.ones(len(low), bool)
    after[:-1] = ~word[1:] | (points[:-1] == 0x130)
    ends = np.flatnonzero(han | (word & (after | edge[1:]))) + 1
    return np.searchsorted(offsets, starts, "right") - 1, span_hashes(low, starts, ends)
