"""Ordered decision rules, selectors and grammars over rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

Rule = tuple[Column, str, str]


def first_match(rules: list[Rule], decision: str, reason: str) -> Column:
    """A struct (decision, reason) of the first rule (condition, decision, reason) that holds, else of the default; unknown conditions don't hold."""
    answer = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    (condition, d, r), *rest = rules
    chain = F.when(F.coalesce(condition, F.lit(False)), answer(d, r))
    for condition, d, r in rest:
        chain = chain.when(F.coalesce(condition, F.lit(False)), answer(d, r))
    return chain.otherwise(answer(decision, reason))


def selector(values: dict[str, list[str]], prefixes: dict[str, list[str]] | None = None, arrays: dict[str, list[str]] | None = None) -> Column:
    """Whether a row passes a selector: any of the values of a column, and that for all columns; empty lists pass.

    ``prefixes`` are of columns that must begin with one of them, ``arrays`` of columns that must share an element.
    """
    parts = [F.coalesce(F.col(c).isin(vs), F.lit(False)) for c, vs in values.items() if vs]
    parts += [reduce(lambda a, b: a | b, (F.coalesce(F.col(c).startswith(p), F.lit(False)) for p in ps)) for c, ps in (prefixes or {}).items() if ps]
    parts += [F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, vs))), F.lit(False)) for c, vs in (arrays or {}).items() if vs]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def all_parts_match(parts: Column, patterns: list[str]) -> Column:
    """Whether there are parts with visible characters and each of them matches one of the patterns as a whole."""
    shown = F.filter(F.transform(parts, F.trim), lambda x: x != "")
    return (F.size(shown) > 0) & F.forall(shown, lambda x: x.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"))


#: Characters that a name in a list of quantities can't hold, besides digits.
NOT_IN_NAMES = "*×\n。！？；：:"
MOST_NAME = 40


def quantities(text: str) -> bool:
    """Whether a text is a list of quantities, (name [*×] number)+ with names of 1 to 40 characters, in linear time.

    All ways to read the text are followed at once: which name lengths are possible is one integer of
    40 bits, the other states are flags. Blanks may stand before a name, around the sign and after a
    number, and they may belong to a name as well.
    """
    lengths, before, sign, after, whole, point, fraction, between = 0, True, False, False, False, False, False, False
    full = (1 << MOST_NAME) - 1
    for c in text:
        digit, blank = c.isdecimal(), c.isspace()
        in_name = not digit and c not in NOT_IN_NAMES
        between |= whole or fraction
        start = before or between
        operator = sign or bool(lengths)
        lengths, before, sign, after, whole, point, fraction, between = (
            ((lengths << 1) | (1 if start else 0)) & full if in_name else 0,
            start and blank,
            operator and blank,
            (operator and c in "*×") or (after and blank),
            (after or whole) and digit,
            whole and c == ".",
            (point or fraction) and digit,
            between and blank,
        )
        if not (lengths or before or sign or after or whole or point or fraction or between):
            return False
    return whole or fraction or between


@pandas_udf(BooleanType())
def is_quantity_list(texts: pd.Series) -> pd.Series:
    """``quantities`` of a column; null stays null."""
    return texts.map(quantities, na_action="ignore").astype(object)
