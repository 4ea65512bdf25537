"""Text analysis as Column expressions: tokens, n-grams, segments, fragments, citations, hashes.

Everything here stays in the JVM; what needs full Unicode tables is in ``unicode.py``. Positions are
0-based code points, spans are half-open. A null text gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{3400}-\x{9fff}]"
HAN_WIDE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}]"


def analyze(text: Column) -> Column:
    """Lower-case tokens: every Han character in order, then every run of ASCII letters and digits."""
    low = F.lower(text)
    return F.concat(F.regexp_extract_all(low, F.lit(f"({HAN})"), F.lit(1)), F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))


def bag(text: Column) -> Column:
    """The tokens of ``analyze`` in text order, found in one pass; for counting, where order is no matter."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({HAN}|[a-z0-9]+)"), F.lit(1))


def char_ngrams(text: Column, n: int) -> Column:
    """All n-grams of characters in order; none for a shorter text. For short texts: a substring costs its offset (whole texts: ``grams``)."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def distinct_ngrams(text: Column, n: int) -> Column:
    return F.array_distinct(char_ngrams(text, n))


def _bigrams(run: Column) -> Column:
    return char_ngrams(run, 2)


def analyze_with_bigrams(text: Column) -> Column:
    """``analyze`` with the bigrams of adjacent Han characters after the single ones."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"({HAN}+)"), F.lit(1))
    return F.concat(F.regexp_extract_all(low, F.lit(f"({HAN})"), F.lit(1)), F.flatten(F.transform(runs, _bigrams)), F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))


def runs(text: Column) -> Column:
    """Maximal runs of Han (all planes) or of other letters and digits, in text order."""
    return F.regexp_extract_all(text, F.lit(f"({HAN_WIDE}+|[\\p{{L}}\\p{{N}}&&[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{20000}}-\\x{{323af}}]]+)"), F.lit(1))


def han_channels(text: Column) -> tuple[Column, Column]:
    """Unigram and bigram channels of the runs: Han runs give characters or overlapping bigrams, others themselves."""
    found = runs(text)
    is_han = lambda r: r.rlike(f"^{HAN_WIDE}")
    one = F.flatten(F.transform(found, lambda r: F.when(is_han(r), char_ngrams(r, 1)).otherwise(F.array(F.lower(r)))))
    two = F.flatten(F.transform(found, lambda r: F.when(is_han(r), char_ngrams(r, 2)).otherwise(F.array(F.lower(r)))))
    return one, two


def dictionary_words(text: Column, words: list[str]) -> Column:
    """Lower-case words found by a dictionary, the longest first; other Han characters and runs of ASCII letters and digits stand alone."""
    known = "|".join(sorted((re.escape(w.lower()) for w in words), key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(text), F.lit(f"({known + '|' if known else ''}[a-z0-9]+|{HAN})"), F.lit(1))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def collapsed(text: Column) -> Column:
    """Lower-case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences with their end marks and closing quotes; line breaks end a sentence. Lossless: they concatenate to the text."""
    return F.regexp_extract_all(text, F.lit("([^。！？!?\n]*(?:[。！？!?]+[”’」』）)\"]*|\n|$))"), F.lit(1))


def with_offsets(parts: Column) -> Column:
    """Array of (part, start, end) with running offsets over consecutive parts."""
    start = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(parts, lambda x, i: F.struct(x.alias("part"), start(i).alias("start"), (start(i) + F.length(x)).alias("end")))


def fragments(text: Column, size: int = 1200) -> Column:
    """Windows of ``size`` characters as (index, count, start, text); one empty fragment for an empty text."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("index"), count.alias("count"), (i * size).alias("start"), F.substring(text, i * size + 1, size).alias("text")))


def citations(text: Column) -> Column:
    """Numbers of [E7]-like citations, zeros in front dropped, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[E0*(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def content_id(url: Column) -> Column:
    """The number in a relative link /ys/obc/content/<n>/detail, else null."""
    found = F.regexp_extract(url, r"^/ys/obc/content/(\d+)/detail(?:[?#].*)?$", 1)
    return F.when(found != "", found)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
