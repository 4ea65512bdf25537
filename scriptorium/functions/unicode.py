"""Normalisations that need Unicode tables, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

_SPACE = re.compile(r"\s+")


@pandas_udf(StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    """NFKC, white space collapsed and trimmed, case-folded; null stays null."""
    return texts.map(lambda t: _SPACE.sub(" ", unicodedata.normalize("NFKC", t)).strip().casefold(), na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def alnum_runs(texts: pd.Series) -> pd.Series:
    """Maximal runs of Han characters or of other alphanumeric ones, by the full Unicode definition, case-folded."""

    def split(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out: list[str] = []
        kind = ""
        for c in text:
            p = ord(c)
            now = "han" if 0x3400 <= p <= 0x4DBF or 0x4E00 <= p <= 0x9FFF or 0xF900 <= p <= 0xFAFF or 0x20000 <= p <= 0x323AF else "word" if c.isalnum() else ""
            if now and now == kind:
                out[-1] += c
            elif now:
                out.append(c)
            kind = now
        return [x if len(x) and "㐀" <= x[0] <= "鿿" else x.casefold() for x in out]

    return texts.map(split)
