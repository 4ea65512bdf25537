"""Near-duplicate records by meet-in-the-middle ball hashing.

A fingerprint is a word of five min-hash symbols of the text's set of character n-grams. In the metric
that counts erased symbols (one symbol changed = distance 2), the ball of radius 2 around a
fingerprint is searched from both ends: every fingerprint emits its variants within half the
radius, which are its five words with one symbol erased, and two records meet on a variant exactly
if their words differ in at most one symbol. Eleven independent words make a pair of similarity
0.8 meet with probability 1 - 4e-7 (0.737 a word), and more surely above; unrelated texts, whose
similarity is near 0.01, practically never do. The variants travel packed, only colliding ones
become rows, the pairs are deduplicated, and each pair is verified on the whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import batch, code_points, gram_hashes, gram_positions, mix64
from ..session import cut
from .collide import colliding

SYMBOLS = 5
WORDS = 11
#: Bytes of a key that travel: pairs are verified, so a chance meeting costs a check and no more.
KEY_BYTES = 5
_rng = np.random.default_rng(20_240_601)
_MULTIPLIERS = _rng.integers(1 << 62, (1 << 63) - 1, SYMBOLS * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, (1 << 63) - 1, SYMBOLS, dtype=np.uint64)


def ball_keys(points: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the erased words of every text with a gram: (key, row, number of distinct grams)."""
    hashes = gram_hashes(points, gram)
    at, rows = gram_positions(offsets, gram)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    hashes = hashes[at]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    present = rows[starts]
    order = np.lexsort((hashes, rows))
    sorted_rows, sorted_hashes = rows[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_rows[1:] != sorted_rows[:-1]) | (sorted_hashes[1:] != sorted_hashes[:-1])
    distinct = np.add.reduceat(new.astype(np.int32), starts)
    keys = np.empty((len(present), WORDS * SYMBOLS), np.uint64)
    for word in range(WORDS):
        symbols = [mix64(np.minimum.reduceat(hashes * _MULTIPLIERS[word * SYMBOLS + s], starts) + _SALTS[s]) for s in range(SYMBOLS)]
        whole = sum(symbols[1:], symbols[0])
        for s in range(SYMBOLS):
            keys[:, word * SYMBOLS + s] = mix64(whole - symbols[s] + np.uint64((word * SYMBOLS + s + 1) * 0x1000003))
    n = WORDS * SYMBOLS
    return keys.ravel(), np.repeat(present, n), np.repeat(distinct, n)


def _emitter(gram: int):
    def emit(b: pa.RecordBatch):
        points, offsets = code_points(b.column("text"))
        keys, rows, distinct = ball_keys(points, offsets, gram)
        return keys, b.column("rid").to_numpy(zero_copy_only=False)[rows], distinct

    return emit


def _jaccard(gram: int):
    def run(batches):
        for b in batches:
            pieces = [[frozenset(t[i : i + gram] for i in range(len(t) - gram + 1)) for t in b.column(c).to_pylist()] for c in ("text_a", "text_b")]
            shared = np.fromiter((len(x & y) for x, y in zip(*pieces)), np.int64, b.num_rows)
            union = np.fromiter((len(x) + len(y) for x, y in zip(*pieces)), np.int64, b.num_rows) - shared
            yield batch(b.column("rid_a"), b.column("rid_b"), shared, union, names=["rid_a", "rid_b", "shared", "either"])

    return run


def similar_texts(texts: DataFrame, threshold_percent: int = 80, gram: int = 3, rows: int | None = None) -> DataFrame:
    """Pairs (rid_a, rid_b, shared, either) of distinct texts with Jaccard similarity >= threshold.

    ``texts``: rid (a 64-bit hash of the text) and text; repeated rows, null and short texts are
    allowed and add nothing; ``rows`` is their number, if known. Each pair comes once, rid_a < rid_b. 100 * shared >= threshold * either
    is tested in whole numbers on the complete gram sets.
    """
    keys = colliding(texts.select("rid", "text"), _emitter(gram), width=KEY_BYTES, most_keys=rows and rows * WORDS * SYMBOLS)
    a, b = (keys.select("key", F.col("owner").alias(f"rid_{x}"), F.col("extra").alias(f"n_{x}")) for x in "ab")
    fits = lambda x, y: F.col(x) * 100 >= F.col(y) * threshold_percent
    pairs = a.join(b, "key").where((F.col("rid_a") < F.col("rid_b")) & fits("n_a", "n_b") & fits("n_b", "n_a")).select("rid_a", "rid_b").distinct()
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")).distinct()
    kept = texts.select("rid", "text").join(wanted, "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))
    kept = cut(kept)
    both = pairs.join(kept.select(F.col("rid").alias("rid_a"), F.col("text").alias("text_a")), "rid_a").join(kept.select(F.col("rid").alias("rid_b"), F.col("text").alias("text_b")), "rid_b")
    return both.mapInArrow(_jaccard(gram), "rid_a long, rid_b long, shared long, either long").where(F.col("shared") * 100 >= F.col("either") * threshold_percent)


def near_duplicate_units(units: DataFrame, threshold_percent: int = 80, gram: int = 3, least_chars: int = 30) -> DataFrame:
    """Pairs (unit_a, unit_b) of units of different records whose texts are nearly the same.

    ``units``: unit_id, record_id, text. Re-delivered rows count once; rows with a null unit_id,
    record_id or text and texts under ``least_chars`` take no part. The smaller id comes first.
    Identical texts are compared once, however many units hold them: similarity is found between
    distinct texts, and units are attached at the end, where every joined row is a result.
    """
    rows = units.select("unit_id", "record_id", "text").where(F.col("unit_id").isNotNull() & F.col("record_id").isNotNull() & (F.length("text") >= max(least_chars, gram)))
    rows = rows.withColumn("rid", F.xxhash64("text"))
    members = cut(rows.select("rid", "record_id", "unit_id").distinct())
    near = similar_texts(rows, threshold_percent, gram, members.count()).select("rid_a", "rid_b")
    # identical texts under several records: pairs of records first, so that no dead pair is formed
    held = members.select("rid", "record_id").distinct()
    many = held.groupBy("rid").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi")).where("lo < hi").select("rid")
    held_again = held.join(many, "rid", "left_semi")
    side = lambda df, x: df.select(F.col("rid").alias(f"rid_{x}"), F.col("record_id").alias(f"record_{x}"))
    same = side(held_again, "a").join(side(held_again, "b"), F.expr("rid_a = rid_b and record_a < record_b"))
    other = near.join(side(held, "a"), "rid_a").join(side(held, "b"), "rid_b").where("record_a <> record_b")
    linked = same.select("rid_a", "record_a", "rid_b", "record_b").unionByName(other.select("rid_a", "record_a", "rid_b", "record_b"))
    unit = lambda x: members.select(F.col("rid").alias(f"rid_{x}"), F.col("record_id").alias(f"record_{x}"), F.col("unit_id").alias(f"u_{x}"))
    out = linked.join(unit("a"), ["rid_a", "record_a"]).join(unit("b"), ["rid_b", "record_b"])
    return out.where("u_a <> u_b").select(F.least("u_a", "u_b").alias("unit_a"), F.greatest("u_a", "u_b").alias("unit_b")).distinct()


def near_duplicate_classes(units: DataFrame, threshold_percent: int = 80, gram: int = 3, least_chars: int = 30) -> DataFrame:
    """One row (unit_id, class_id, links) per unit: its class of exact copies, named by the smallest unit_id, and the class's links to other classes.

    ``units``: unit_id, text. Null ids and texts take no part; texts under ``least_chars`` have no links.
    """
    rows = units.select("unit_id", "text").where(F.col("unit_id").isNotNull() & F.col("text").isNotNull()).withColumn("rid", F.xxhash64("text"))
    members = cut(rows.select("unit_id", "rid").distinct())
    near = similar_texts(rows.where(F.length("text") >= max(least_chars, gram)), threshold_percent, gram, members.count())
    links = near.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    classes = members.groupBy("rid").agg(F.min("unit_id").alias("class_id")).join(links, "rid", "left")
    return members.join(classes, "rid").select("unit_id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
