"""Batch retrieval: BM25 and its fielded forms, dense and sparse dot products, with total orders.

Queries come as a table and are answered together, in blocks, against all rows: a block is a matrix
that goes to the tasks, and what comes back of a batch of documents is its k best a query. Scores are rounded before ranking, so that the order
of summation never decides a tie; ranks end in the document id.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.codepoints import code_points
from ..functions.grams import bag_hashes


def query_terms(queries: DataFrame, tokens=T.analyze) -> DataFrame:
    """(query_id, term, qf) of the queries (query_id, text)."""
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def postings(docs: DataFrame, tokens=T.analyze, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, dl) of documents (doc_id, text), of the ``wanted`` terms only if given."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    rows = rows.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, tokens=T.analyze) -> DataFrame:
    """One row (n, avg_dl)."""
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("dl").alias("n"), F.avg("dl").alias("avg_dl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturated(tf: Column, dl: Column, avg: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


def top_k(scored: DataFrame, k: int, by: list[str], tie: str, score: str = "score") -> DataFrame:
    """The k best rows of each group by score, ties by ``tie``, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class _Best:
    """The k best rows a query of a partition, held while its batches pass; score first, then the smaller key."""

    def __init__(self, ids, k: int):
        self.ids, self.k = np.asarray(ids, np.int64), k
        self.least = np.full(len(self.ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, keys: np.ndarray, scores: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Rows by queries; what can't be among the best any more is let go at once."""
        fits = scores >= self.least
        if allowed is not None:
            fits &= allowed
        row, query = np.nonzero(fits)
        self.held.append((query, keys[row], scores[row, query]))
        self.size += len(row)
        if self.size > 8 * self.k * max(len(self.ids), 1):
            self.cut()

    def cut(self) -> None:
        query, keys, scores = map(np.concatenate, zip(*self.held))
        order = np.lexsort((keys, -scores, query))
        query, keys, scores = query[order], keys[order], scores[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        place = np.arange(len(query)) - first[query]
        keep = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = scores[last]
        self.held = [(query[keep], keys[keep], scores[keep])]
        self.size = int(keep.sum())

    def batch(self, key_name: str) -> pa.RecordBatch:
        if self.held:
            self.cut()
        query, keys, scores = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query], pa.int64()), pa.array(keys, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", key_name, "score"])


class _TermBlock:
    """A block of queries as a term list and a (terms x queries) matrix of query frequencies.

    Rows are (id, tokens), or (id, text) for texts that are tokenised here, a whole batch at a time,
    in which case terms are the hashes of ``bag_hashes``.
    """

    def __init__(self, rows: list[tuple], texts: bool = False):
        self.ids = [r[0] for r in rows]
        self.texts = texts
        if texts:
            row, tokens = bag_hashes(*code_points(pa.array([r[1] for r in rows], pa.string())))
            self.terms, at = np.unique(tokens, return_inverse=True)
            self.matrix = np.zeros((len(self.terms), len(rows)))
            np.add.at(self.matrix, (at, row), 1)
            return
        bags = [Counter(r[1] or ()) for r in rows]
        self.terms = sorted(set().union(*bags)) if bags else []
        at = {t: i for i, t in enumerate(self.terms)}
        self.matrix = np.zeros((len(self.terms), len(rows)))
        for q, bag in enumerate(bags):
            for t, n in bag.items():
                self.matrix[at[t], q] = n

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of token lists, or of texts: row, term and frequency of the known terms, and the numbers of tokens."""
        if self.texts:
            row, tokens = bag_hashes(*code_points(column))
            lengths = np.bincount(row, minlength=len(column))
            known = np.minimum(np.searchsorted(self.terms, tokens), max(len(self.terms) - 1, 0))
            keep = self.terms[known] == tokens if len(self.terms) else np.zeros(len(tokens), bool)
        else:
            offsets = column.offsets.to_numpy()
            values = pc.index_in(column.values, value_set=pa.array(self.terms, pa.string()))
            known = pc.fill_null(values, -1).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            lengths = np.diff(offsets)
            row = np.repeat(np.arange(len(lengths)), lengths)
            keep = known >= 0
        pair, tf = np.unique(row[keep] * max(len(self.terms), 1) + known[keep], return_counts=True)
        return pair // max(len(self.terms), 1), pair % max(len(self.terms), 1), tf, lengths


def _statistics(block: _TermBlock, fields: list[str]):
    """Partial sums of a partition as rows (name, value): document frequencies, rows and field lengths."""

    def run(batches):
        df, lengths, n = np.zeros(len(block.terms), np.int64), np.zeros(len(fields), np.int64), 0
        for b in batches:
            inside = b.filter(pc.fill_null(b.column("in_population"), False))
            seen = []
            for i, f in enumerate(fields):
                row, term, _, length = block.counts(inside.column(f))
                seen.append(row * max(len(block.terms), 1) + term)
                lengths[i] += length.sum()
            n += inside.num_rows
            df += np.bincount(np.unique(np.concatenate(seen)).astype(np.int64) % max(len(block.terms), 1), minlength=len(block.terms))[: len(block.terms)] if seen and len(block.terms) else 0
        names = [*(f"t{i}" for i in np.flatnonzero(df)), *(f"l{i}" for i in range(len(fields))), "n"]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*df[df > 0], *lengths, n], pa.int64())], names=["name", "value"])

    return run


def _block_bm25(block: _TermBlock, fields: list[str], weights: list[float], average: list[float], idfs: np.ndarray, k: int, k1: float, b: float, step: int = 512):
    """Scores of all rows of a partition against the block, of which the k best a query leave the partition."""

    def run(batches):
        best = _Best(block.ids, k)
        for batch in batches:
            batch = batch.filter(pc.fill_null(batch.column("in_role"), False))
            if not batch.num_rows or not len(block.terms):
                continue
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = [block.counts(batch.column(f)) for f in fields]
            scores = np.empty((len(keys), len(block.ids)))
            for lo in range(0, len(keys), step):
                hi = min(lo + step, len(keys))
                x = np.zeros((hi - lo, len(block.terms)))
                for (row, term, tf, length), w, a in zip(found, weights, average):
                    s, e = np.searchsorted(row, [lo, hi])
                    norm = 1 - b + b * length[row[s:e]] / (a or 1.0)
                    x[row[s:e] - lo, term[s:e]] += w * tf[s:e] / norm
                scores[lo:hi] = (x * (k1 + 1) / (x + k1) * idfs) @ block.matrix
            scores = np.round(scores, 9)
            best.offer(keys, scores, scores > 0)
        yield best.batch("doc_id")

    return run


def bm25_fields(docs: DataFrame, queries: DataFrame, weights: dict[str, float], k: int = 10, k1: float = 1.2, b: float = 0.75, tokens=T.bag, population: Column | None = None, role: Column | None = None, block: int = 1000) -> DataFrame:
    """BM25F hits (query_id, doc_id, score, rank): field frequencies, normalised by field length and weighted, are summed before saturation.

    The document frequency counts rows with the term in any field, also in one of weight 0. With
    ``population`` the statistics come from its rows only, and ``role`` masks candidates: the mask is
    not the statistic. Queries, a stated set with whole-number ids, are taken in blocks of ``block``.
    A block takes two passes over the documents and no shuffle of postings: the first sums statistics
    of the block's terms (a few numbers a task), the second multiplies batches of documents with the
    block's term matrix and passes on the k best of each batch. Null ids and texts take no part.
    """
    fields = list(weights)
    texts = tokens is T.bag  # tokenised in the pass itself, not handed over token by token
    analysed = (lambda c: c) if texts else tokens
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), *(analysed(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)),
        (F.lit(True) if population is None else population).alias("in_population"), (F.lit(True) if role is None else role).alias("in_role"),
    )
    names = [f"f{i}" for i in range(len(fields))]
    parts = []
    held: list[tuple] = []

    def answer() -> None:
        terms = _TermBlock(held, texts)
        sums = {r["name"]: r["value"] for r in rows.mapInArrow(_statistics(terms, names), "name string, value long").groupBy("name").agg(F.sum("value").alias("value")).collect()}
        n = sums.get("n", 0)
        df = np.array([sums.get(f"t{i}", 0) for i in range(len(terms.terms))], float)
        idfs = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
        average = [sums.get(f"l{i}", 0) / n if n else 0.0 for i in range(len(fields))]
        parts.append(rows.mapInArrow(_block_bm25(terms, names, [weights[f] for f in fields], average, idfs, k, k1, b), "query_id long, doc_id long, score double"))

    for r in queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long"), analysed(F.col("text")).alias("toks")).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            answer()
            held = []
    if held:
        answer()
    if not parts:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"], "doc_id")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, tokens=T.bag, population: Column | None = None, role: Column | None = None) -> DataFrame:
    """BM25 hits (query_id, doc_id, score, rank): BM25F over the one field text, which is the same formula."""
    return bm25_fields(docs.where(F.col("text").isNotNull()), queries, {"text": 1.0}, k, k1, b, tokens, population, role)


def _channel_statistics(blocks: dict[str, _TermBlock], physical: list[tuple[str, str]]):
    """Partial sums of a partition as rows (name, value): for every physical field its document frequencies, rows and lengths."""

    def run(batches):
        df = {i: np.zeros(len(blocks[c].terms), np.int64) for i, (c, _) in enumerate(physical)}
        sums = np.zeros((len(physical), 2), np.int64)
        for b in batches:
            for i, (c, f) in enumerate(physical):
                _, term, _, lengths = blocks[c].counts(pc.fill_null(b.column(f"f{i}"), pa.scalar([], b.column(f"f{i}").type)))
                df[i] += np.bincount(term.astype(np.int64), minlength=len(df[i]))[: len(df[i])]
                sums[i] += (b.num_rows - b.column(f"f{i}").null_count, lengths.sum())
        names = [f"t {i} {t}" for i in df for t in np.flatnonzero(df[i])] + [f"{w} {i}" for i in df for w in "nl"]
        values = [int(df[i][t]) for i in df for t in np.flatnonzero(df[i])] + [int(sums[i][j]) for i in df for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.int64())], names=["name", "value"])

    return run


def _channel_scores(blocks: dict[str, _TermBlock], physical: list[tuple[str, str]], boosts: list[float], averages: list[float], idfs: list[np.ndarray], k: int, k1: float, b: float, step: int = 512):
    """Scores of all rows of a partition, summed over the physical fields; the k best a query leave the partition."""
    asked = {c: np.minimum(block.matrix, 1) for c, block in blocks.items()}
    ids = next(iter(blocks.values())).ids

    def run(batches):
        best = _Best(ids, k)
        for batch in batches:
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            scores = np.zeros((len(keys), len(ids)))
            for i, (c, _) in enumerate(physical):
                row, term, tf, lengths = blocks[c].counts(pc.fill_null(batch.column(f"f{i}"), pa.scalar([], batch.column(f"f{i}").type)))
                norm = k1 * (1 - b + b * lengths[row] / (averages[i] or 1.0))
                value = boosts[i] * idfs[i][term] * (tf * (k1 + 1) / (tf + norm)) if len(term) else np.zeros(0)
                for lo in range(0, len(keys), step):
                    hi = min(lo + step, len(keys))
                    s, e = np.searchsorted(row, [lo, hi])
                    if e > s:
                        x = np.zeros((hi - lo, len(blocks[c].terms)))
                        x[row[s:e] - lo, term[s:e]] = value[s:e]
                        scores[lo:hi] += x @ asked[c]
            best.offer(keys, np.round(scores, 9), scores > 5e-10)
        yield best.batch("doc_id")

    return run


def bm25_channels(docs: DataFrame, queries: DataFrame, fields: dict[str, float], channels: dict[str, tuple[float, object]], k: int = 10, k1: float = 1.2, b: float = 0.75, block: int = 500) -> DataFrame:
    """Physical fields = fields x analyzers, each with its own statistics; unique query terms, scores added.

    The boost of a physical field is the product of its field's and its analyzer's weight; rows in which
    a field is null are no rows of its statistics. A block of questions takes two passes over the
    documents, as in ``bm25_fields``, whatever the number of physical fields.
    """
    physical = [(c, f) for c in channels for f in fields]
    boosts = [channels[c][0] * fields[f] for c, f in physical]
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), *(channels[c][1](F.col(f)).alias(f"f{i}") for i, (c, f) in enumerate(physical)))
    parts = []
    held: list = []

    def answer() -> None:
        blocks = {c: _TermBlock([(r[0], r[1 + j]) for r in held]) for j, c in enumerate(channels)}
        sums = {r["name"]: r["value"] for r in rows.mapInArrow(_channel_statistics(blocks, physical), "name string, value long").groupBy("name").agg(F.sum("value").alias("value")).collect()}
        idfs, averages = [], []
        for i, (c, _) in enumerate(physical):
            n = sums.get(f"n {i}", 0)
            df = np.array([sums.get(f"t {i} {t}", 0) for t in range(len(blocks[c].terms))], float)
            idfs.append(np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0))
            averages.append(sums.get(f"l {i}", 0) / n if n else 0.0)
        parts.append(rows.mapInArrow(_channel_scores(blocks, physical, boosts, averages, idfs, k, k1, b), "query_id long, doc_id long, score double"))

    for r in queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long"), *(tokens(F.col("text")).alias(c) for c, (_, tokens) in channels.items())).toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            answer()
            held = []
    if held:
        answer()
    if not parts:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"], "doc_id")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _block_search(ids, groups, matrix, k: int, decimals: int, earlier: bool = False, owner: int | None = None):
    """Scores of a partition's vectors against the block; ``owner`` is the number of vectors of one owner, whose best counts."""

    def run(batches):
        best = _Best(ids, k)
        for batch in batches:
            keys = batch.column("vec_id").to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = np.round(flat.reshape(len(keys), -1) @ matrix.T, decimals)
            allowed = keys[:, None] < ids[None, :] if earlier else keys[:, None] != ids[None, :]
            if groups is not None:
                allowed &= batch.column("group").to_numpy(zero_copy_only=False)[:, None] != groups[None, :]
            if owner is not None:  # the windows of an owner may lie in several batches and partitions: the rest is done by window_max
                keys = keys // owner
                order = np.argsort(keys, kind="stable")
                starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
                scores = np.maximum.reduceat(np.where(allowed, scores, -np.inf)[order], starts)
                keys, allowed = keys[order[starts]], np.isfinite(scores)
            best.offer(keys, scores, allowed)
        yield best.batch("vec_id")

    return run


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2000, decimals: int = 6, earlier: bool = False, exclude: str | None = None, owner: int | None = None) -> DataFrame:
    """Exact cosine hits (query_id, vec_id, score, rank) of unit vectors against all rows, own id left out.

    ``queries`` is a stated set; it goes to the executors in blocks of ``block`` vectors (a bounded
    size), every row of ``vectors`` is scored by one matrix product a batch, a partition passes on
    only its k best, and the final ranking sees partitions x k rows a query. With ``earlier`` only ids
    below the query's own count, and with ``exclude``, a whole-number column, only rows whose value is
    another than the query's, both before any cut at k. With ``owner`` the ids are windows of owners,
    ``owner`` windows each: vec_id is then the owner's number and an owner scores as its best window.
    """
    group = (F.lit(None) if exclude is None else F.col(exclude)).cast("long").alias("group")

    def blocks():
        held = []
        for r in queries.select("vec_id", "embedding", group).where("vec_id is not null and embedding is not null").toLocalIterator():
            held.append(r)
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held

    parts = []
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", group).where("vec_id is not null and embedding is not null" + ("" if exclude is None else " and group is not null"))
    for held in blocks():
        ids, matrix = np.array([r[0] for r in held]), np.array([r[1] for r in held], np.float64)
        groups = None if exclude is None else np.array([-1 if r[2] is None else r[2] for r in held])
        parts.append(rows.mapInArrow(_block_search(ids, groups, matrix, k, decimals, earlier, owner), "query_id long, vec_id long, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    hits = reduce(DataFrame.unionByName, parts)
    if owner is not None:
        hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_k(hits, k, ["query_id"], "vec_id")


def window_max(hits: DataFrame, owner: str, k: int) -> DataFrame:
    """Hits of windows turned into hits of their owners: the best window counts (query_id, owner, score, rank)."""
    best = hits.groupBy("query_id", owner).agg(F.max("score").alias("score"))
    return top_k(best, k, ["query_id"], owner)


def sparse_top_k(weights: DataFrame, query_weights: DataFrame, k: int = 10) -> DataFrame:
    """Sparse dot hits over (doc_id, term, w) and (query_id, term, w): shared terms only, positive scores only."""
    q = query_weights.select("query_id", "term", F.col("w").alias("wq"))
    scored = weights.join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("score")).where("score > 0")
    return top_k(scored, k, ["query_id"], "doc_id")


def _block_sparse(block: _TermBlock, k: int, step: int = 512):
    def run(batches):
        width = len(block.terms)
        best = _Best(block.ids, k)
        for batch in batches:
            if not batch.num_rows or not width:
                continue
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            terms, weights = batch.column("terms"), batch.column("weights")
            known = pc.fill_null(pc.index_in(terms.flatten(), value_set=pa.array(block.terms, pa.string())), -1).to_numpy(zero_copy_only=False)
            w = weights.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            keep = known >= 0
            row, known, w = row[keep], known[keep], w[keep]
            scores = np.empty((len(keys), len(block.ids)))
            for lo in range(0, len(keys), step):
                hi = min(lo + step, len(keys))
                s, e = np.searchsorted(row, [lo, hi])
                x = np.bincount((row[s:e] - lo) * width + known[s:e], w[s:e], (hi - lo) * width).reshape(hi - lo, width)
                scores[lo:hi] = x @ block.matrix
            scores = np.round(scores, 9)
            best.offer(keys, scores, scores > 0)
        yield best.batch("doc_id")

    return run


def _block_bags(block: _TermBlock, k: int, step: int = 512):
    """Sparse dot products of bags of words, weighed by frequency over the root of the length, with the block."""

    def run(batches):
        width = len(block.terms)
        best = _Best(block.ids, k)
        for batch in batches:
            if not batch.num_rows or not width:
                continue
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, term, tf, lengths = block.counts(batch.column("text"))
            w = tf / np.sqrt(lengths[row])
            scores = np.empty((len(keys), len(block.ids)))
            for lo in range(0, len(keys), step):
                hi = min(lo + step, len(keys))
                s, e = np.searchsorted(row, [lo, hi])
                x = np.zeros((hi - lo, width))
                x[row[s:e] - lo, term[s:e]] = w[s:e]
                scores[lo:hi] = x @ block.matrix
            best.offer(keys, np.round(scores, 9), scores > 5e-10)
        yield best.batch("doc_id")

    return run


def bag_sparse_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, block: int = 1000) -> DataFrame:
    """Sparse dot hits (query_id, doc_id, score, rank) of texts as bags of words with weights tf / sqrt(length) against questions.

    ``docs``: doc_id, text; ``queries``: query_id, text. Each block of questions takes one pass over the
    texts, which are tokenised in it. Null ids and texts take no part.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    held: list[tuple] = []
    parts = []
    for r in queries.where("query_id is not null").select(F.col("query_id").cast("long"), "text").toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            parts.append(rows.mapInArrow(_block_bags(_TermBlock(held, True), k), "query_id long, doc_id long, score double"))
            held = []
    if held:
        parts.append(rows.mapInArrow(_block_bags(_TermBlock(held, True), k), "query_id long, doc_id long, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"], "doc_id")


def sparse_rows_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 1000) -> DataFrame:
    """Sparse dot hits of rows (doc_id, terms, weights: arrays of one length) against queries (query_id, terms).

    The block form of ``sparse_top_k``: weights of a repeated term add up, query terms weigh by their
    number, only positive scores count, and each batch of rows passes on its k best a query.
    """
    rows = rows.where("doc_id is not null and terms is not null and weights is not null").select(F.col("doc_id").cast("long"), "terms", F.col("weights").cast("array<double>"))
    held: list[tuple] = []
    parts = []
    for r in queries.where("query_id is not null").select(F.col("query_id").cast("long"), "terms").toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            parts.append(rows.mapInArrow(_block_sparse(_TermBlock(held), k), "query_id long, doc_id long, score double"))
            held = []
    if held:
        parts.append(rows.mapInArrow(_block_sparse(_TermBlock(held), k), "query_id long, doc_id long, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"], "doc_id")


def bound_rankings(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, state) of two rankings (query_id, key, rank): bound, keys differ, or ranks not 1 to n (of the second)."""
    a = first.select("query_id", "key").withColumn("a", F.lit(1))
    b = second.select("query_id", "key", F.col("rank").alias("r")).withColumn("b", F.lit(1))
    n = a.join(b, ["query_id", "key"], "full").groupBy("query_id").agg(F.count("a").alias("left_n"), F.count("b").alias("right_n"), F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.countDistinct("r").alias("ranks"))
    return n.select("query_id", F.when(F.expr("both <> left_n or both <> right_n"), "keys differ").when(F.expr("lo <> 1 or hi <> right_n or ranks <> right_n"), "ranks not 1 to n").otherwise("bound").alias("state"))


def strongest(encoded: DataFrame) -> DataFrame:
    """(doc_id, term, w) with the largest positive weight of a term in a document."""
    return encoded.where("w > 0").groupBy("doc_id", "term").agg(F.max("w").alias("w"))
