"""Documents cut into token-bounded pieces, with greedy packing at two sizes and exact offsets.

A document is one row and is cut where it lies, in one Arrow pass without a shuffle; what is greedy
by nature (each cut depends on the last) is the small function inside. Texts are tokenised once and
measured on the positions of their tokens. Vocabulary and sizes are parameters. Offsets are code points and pieces cover the text exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import Characters, Ruler, Tokens

CHARACTERS = Characters()

# Sentence ends, and the sizes (target, hard limit) in tokens of the two grains.
_END = re.compile("[。！？!?]+[”’」』）)\"]*|\\n+|(?<=[a-z0-9])[.]+[”\"')]*(?=\\s)")
PROFILES = {"micro": (240, 384), "macro": (720, 1024)}


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences; the last is the end of the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


def _split(start: int, stop: int, ends: list[int], limit: int, ruler: Ruler) -> list[tuple[int, int]]:
    out = []
    while start < stop:
        far = ruler.longest(start, stop, limit)
        best = far
        if far < stop:
            i = bisect_right(ends, far) - 1
            if i >= 0 and ends[i] > start:
                best = ends[i]
        out.append((start, best))
        start = best
    return out


def split_long(text: str, limit: int, tokens: Tokens | Characters = CHARACTERS) -> list[tuple[int, int]]:
    """Greedy pieces (start, end): the longest prefix within ``limit`` tokens, backed off to its last sentence end.

    Tokens are those of the whole text and belong to the piece in which they start. A piece without a
    sentence end is cut hard; at least one character is always taken.
    """
    return _split(0, len(text), sentence_ends(text), limit, tokens.ruler(text))


def pack(text: str, target: int, hard: int, tokens: Tokens | Characters = CHARACTERS, ruler: Ruler | None = None) -> list[tuple[int, int]]:
    """Sentences packed into pieces that close at ``target`` and never pass ``hard`` tokens.

    A piece ends before a heading line (unless it is headings only so far) and before a sentence that no
    longer fits; a sentence too long for itself is split. A last piece under a third of the target that
    does not begin with a heading is merged back if it fits. A heading line is a scope of its own text,
    so that pieces never join what stands before it with what stands after. A ``ruler`` of the text that
    the caller holds is used instead of ``tokens``.
    """
    ruler = ruler or tokens.ruler(text)
    ends = sentence_ends(text)
    units: list[tuple[int, int]] = []
    start = 0
    for end in ends:
        if end > start:
            units += _split(start, end, [], hard, ruler) if ruler.count(start, end) > hard else [(start, end)]
            start = end
    out: list[tuple[int, int]] = []
    open_at: int | None = None
    headings_only = False
    for s, e in units:
        heading = text[s] == "#"
        if open_at is not None and ((heading and not headings_only) or ruler.count(open_at, e) > hard):
            out.append((open_at, s))
            open_at = None
        headings_only = heading and (open_at is None or headings_only)
        open_at = s if open_at is None else open_at
        if ruler.count(open_at, e) >= target:
            out.append((open_at, e))
            open_at = None
    if open_at is not None:
        tail = (open_at, len(text))
        if out and ruler.count(*tail) < target // 3 and ruler.count(out[-1][0], tail[1]) <= hard and text[tail[0]] != "#":
            tail = (out.pop()[0], tail[1])
        out.append(tail)
    return out


def token_windows(text: str, limit: int, tokens: Tokens | Characters = CHARACTERS) -> list[tuple[int, int]]:
    """Contiguous windows (start, end), each the longest with at most ``limit`` tokens."""
    ruler = tokens.ruler(text)
    return _split(0, len(text), [], limit, ruler)


def structured_lines(lines: list[str], limit: int) -> list[list[tuple[int, int, int]]]:
    """Whole lines packed into fragments of at most ``limit`` characters, line feeds counted; only a line too long for itself is cut.

    Each fragment is a list of (line, start, end).
    """
    out: list[list[tuple[int, int, int]]] = []
    held: list[tuple[int, int, int]] = []
    size = 0
    for i, line in enumerate(lines):
        need = len(line) + (1 if held else 0)
        if held and size + need > limit:
            out.append(held)
            held, size, need = [], 0, len(line)
        if need > limit:
            out += [[(i, s, min(s + limit, len(line)))] for s in range(0, len(line), limit)]
            continue
        held.append((i, 0, len(line)))
        size += need
    return out + [held] if held else out


def newline_split(text: str, window: int = 8000) -> list[tuple[int, int]]:
    """Windows cut at the last line feed of their second half, or hard where there is none."""
    out, start = [], 0
    while len(text) - start > window:
        at = text.rfind("\n", start + window // 2, start + window)
        end = at + 1 if at >= 0 else start + window
        out.append((start, end))
        start = end
    out.append((start, len(text)))
    return out


def greedy_batches(sizes: list[int], most: int, count: int | None = None) -> list[int]:
    """Batch number of each item: sequential, closed when the next would pass ``most`` (or ``count`` items)."""
    out, batch, total, n = [], 0, 0, 0
    for size in sizes:
        if n and (total + size > most or count is not None and n >= count):
            batch, total, n = batch + 1, 0, 0
        out.append(batch)
        total += size
        n += 1
    return out


def padded_batches(lengths: list[int], budget: int, cap: int) -> list[int]:
    """Batch numbers in the given order for items sorted by length: grow while longest x items fits the budget."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    out, batch, n = [0] * len(lengths), 0, 0
    for i in order:
        if n and (lengths[i] * (n + 1) > budget or n >= cap):
            batch, n = batch + 1, 0
        out[i] = batch
        n += 1
    return out


def pieces(docs: DataFrame, cut: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """(doc_id, piece_no, start, end, text) of documents (doc_id, text) under a cutting function; null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, starts, ends, texts = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for i, (s, e) in enumerate(cut(text) if text else []):
                    ids.append(doc_id)
                    no.append(i)
                    starts.append(s)
                    ends.append(e)
                    texts.append(text[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (no, starts, ends)), pa.array(texts, pa.string())], names=["doc_id", "piece_no", "start", "end", "text"])

    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, 'doc_id long, piece_no int, start int, end int, text string')


def chunks(docs: DataFrame, profiles: dict[str, tuple[int, int]] = PROFILES, tokens: Tokens | Characters = CHARACTERS) -> DataFrame:
    """Chunks of several grains (chunk_id, doc_id, start, end, text, granularities): equal pieces of two grains are one row.

    A text is tokenised once for all grains and its chunks are merged where it lies, so that nothing is
    shuffled. Null ids and texts and empty texts give none.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends, texts, grains = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ruler = held.value.ruler(text)
                found: dict[tuple[int, int], list[str]] = {}
                for name, (target, hard) in sorted(profiles.items()):
                    for span in pack(text, target, hard, ruler=ruler):
                        found.setdefault(span, []).append(name)
                for (s, e), names in found.items():
                    ids.append(doc_id)
                    starts.append(s)
                    ends.append(e)
                    texts.append(text[s:e])
                    grains.append(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string()), pa.array(grains, pa.list_(pa.string()))], names=["doc_id", "start", "end", "text", "granularities"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text <> ''")
    cut = rows.mapInArrow(run, "doc_id long, start int, end int, text string, granularities array<string>")
    return cut.select(F.sha2(F.concat_ws("\x1f", "doc_id", "start", "end", "text"), 256).alias("chunk_id"), "doc_id", "start", "end", "text", "granularities")


def fold_aliases(rows: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """Rows of equal (label, text): the smallest key is kept (key, aliases, n); the others are its number and list.

    The list of a text that a third of all rows share would not fit a task, so it is cut into
    pages of 1,000 aliases: (key, page, aliases).
    """
    h = rows.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(label), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("h"))
    first = h.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    others = h.join(first, "h").where("key <> first")
    paged = others.withColumn("page", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / 1000)).cast("int"))
    return paged.groupBy(F.col("first").alias("key"), "page").agg(F.sort_array(F.collect_list("key")).alias("aliases"))


def unit_levels(units: DataFrame, cap: int) -> DataFrame:
    """The coarsest level (record, section, unit) at which (record, section, unit, size) rows fit ``cap`` together."""
    by_section = units.groupBy("record", "section").agg(F.sum("size").alias("section_size"))
    by_record = by_section.groupBy("record").agg(F.sum("section_size").alias("record_size"))
    rows = units.join(by_section, ["record", "section"]).join(by_record, "record")
    level = F.when(F.col("record_size") <= cap, "record").when(F.col("section_size") <= cap, "section").otherwise("unit")
    pack_id = F.when(F.col("record_size") <= cap, F.col("record")).when(F.col("section_size") <= cap, F.concat_ws("/", "record", "section")).otherwise(F.concat_ws("/", "record", "section", "unit"))
    return rows.select("record", "section", "unit", "size", level.alias("level"), pack_id.alias("pack"), (F.col("size") > cap).alias("oversize"))
