"""One form for texts that look the same.

Texts are read as code-point arrays, a whole Arrow batch at a time. A table gather replaces each
code point by its one-form: width variants, compatibility ideographs and radicals, letters of the
same shape and kinds of space go to one representative, composed letters are expanded through
offsets, invisible characters vanish. Runs of marks are then put in canonical order and composed
with their letters, all with vector operations and no string call per row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import batch, code_points, text_hashes
from ..session import cut
from .compose import compose, expand, table_of

# Letters of the same shape, look-alike first, Latin letter second.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ғ": "F",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "ո": "n", "ս": "u", "ց": "g", "հ": "h", "զ": "q", "ա": "w", "ɡ": "g", "ǀ": "l", "ꓲ": "I", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓳ": "O", "ꓴ": "U",
}
# Radicals of the supplement that have the shape of an ideograph but no decomposition.
RADICALS = {"⺁": "厂", "⺈": "刀", "⺌": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺓": "幺", "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺣": "灬", "⺤": "爫", "⺦": "丬", "⺨": "犭", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺷": "羊", "⺸": "羊", "⺹": "耂", "⺻": "聿", "⺼": "肉", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻲": "龟"}
# Punctuation of the same shape.
MARKS = {"‐": "-", "‑": "-", "․": ".", "‧": "·", "･": "·", "∶": ":", "꞉": ":"}
#: Decomposition tags whose expansion looks like the character itself.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<small>"}
_SPACES = {0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000}
_FILLERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _expand(cp: int) -> tuple[int, ...]:
    """The one-form of one code point: none for invisible ones, several for composed letters."""
    c = chr(cp)
    if cp in _SPACES:
        return (0x20,)
    if cp in _FILLERS or (unicodedata.category(c) == "Cf" and not 0x600 <= cp <= 0x605):
        return ()
    for table in (LOOKALIKES, RADICALS, MARKS):
        if c in table:
            return tuple(map(ord, table[c]))
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return (cp,)
    tag = parts.pop(0) if parts[0][0] == "<" else ""
    single = tag == "<compat>" and len(parts) == 1 and 0x2E80 <= cp <= 0x2FDF
    if tag in _SAME_LOOK or not tag or single:
        return tuple(y for x in parts for y in _expand(int(x, 16)))
    return (cp,)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Expansions of all code points: offsets and flat values."""
    special = {9: [0x20]}
    for cp in (*range(0x80, 0x4E00), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x30000), *range(0xE0000, 0xE0200)):
        form = _expand(cp)
        if form != (cp,):
            special[cp] = list(form)
    return table_of(special)


def one_form(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points and offsets of the texts in their one form."""
    return compose(*expand(points, offsets, *tables()))


def _encode(points: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts as an Arrow column."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[bounds]
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _normalise(batches):
    for b in batches:
        text = b.column("text")
        out, bounds = one_form(*code_points(text))
        encoded = _encode(out, bounds)
        yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(pc.is_valid(text), encoded, None)], names=[*b.schema.names, "one_form"])


def to_one_form(df: DataFrame) -> DataFrame:
    """``df`` (with a column text) and the column one_form; null stays null, empty stays empty.

    A column one_form that ``df`` already has is replaced.
    """
    from pyspark.sql.types import StringType, StructType

    df = df.drop("one_form")
    schema = StructType([*df.schema.fields]).add("one_form", StringType())
    return df.mapInArrow(_normalise, schema)


def _looks(batches):
    for b in batches:
        points, offsets = code_points(b.column("text"))
        out, bounds = one_form(points, offsets)
        yield batch(b.column("origin"), b.column("item_key"), text_hashes(out, bounds).view(np.int64), text_hashes(out, bounds, 1).view(np.int64), text_hashes(points, offsets).view(np.int64), names=["origin", "item_key", "look", "look2", "form"])


def same_look_pairs(records: DataFrame) -> DataFrame:
    """Pairs (origin, key_a, key_b) of records of one origin whose texts look the same but differ in code points.

    ``records``: origin, item_key, text. Rows of one key count once; null keys and null texts take no
    part (an empty text looks like one of invisible characters only). Looks are compared as 128-bit
    hashes of the one form. Distinct spellings of a look are paired first and keys attached last, so
    that a text copied to a third of all rows forms no pair with itself.
    """
    rows = records.select("origin", "item_key", "text").where(F.col("item_key").isNotNull() & F.col("text").isNotNull())
    forms = cut(rows.mapInArrow(_looks, "origin string, item_key string, look long, look2 long, form long").distinct())
    look = ["origin", "look", "look2"]
    several = forms.groupBy(*look).agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo < hi").select(*look)
    members = cut(forms.join(several, look, "left_semi"))
    spelt = members.select(*look, "form").distinct()
    pairs = spelt.withColumnRenamed("form", "form_a").join(spelt.withColumnRenamed("form", "form_b"), look).where("form_a < form_b")
    side = lambda x: members.select(*look, F.col("form").alias(f"form_{x}"), F.col("item_key").alias(f"k_{x}"))
    out = pairs.join(side("a"), [*look, "form_a"]).join(side("b"), [*look, "form_b"]).where("k_a <> k_b")
    return out.select("origin", F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b")).distinct()
