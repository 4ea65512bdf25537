"""Spans, looks, near-duplicates and leaks against brute force on small fixtures."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.functions.codepoints import code_points
from scriptorium.llm import leaks, looks, neardup, spans
from scriptorium.llm.collide import colliding
from scriptorium.llm.compose import compose, mark_tables

LONG = "灰狼与海螺在雾岸寨" * 4000


def words(rng, n):
    return "".join(rng.choice("山川河海日月星辰风雨雷电花草树木金银铜铁") for _ in range(n))


def brute_spans(rows, least):
    by = defaultdict(dict)
    for o, k, t in rows:
        if k is not None and t is not None:
            by[o][k] = t
    out = set()
    for o, texts in by.items():
        seen = defaultdict(set)
        for k, t in texts.items():
            for i in range(len(t) - least + 1):
                seen[t[i : i + least]].add(k)
        for k, t in texts.items():
            mark = [False] * (len(t) + 1)
            for i in range(len(t) - least + 1):
                if len(seen[t[i : i + least]]) > 1:
                    mark[i : i + least] = [True] * least
            i = 0
            while i < len(t):
                j = i
                while mark[j]:
                    j += 1
                if j > i:
                    out.add((o, k, i, j))
                i = j + 1
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [words(rng, rng.randint(30, 90)) for _ in range(12)]
    rows = []
    for i in range(60):
        t = words(rng, rng.randint(0, 40)) + rng.choice(pool)[rng.randint(0, 9) :] + words(rng, rng.randint(0, 30)) + rng.choice(pool)
        rows.append((rng.choice(["unit", "quote"]), f"k{i:02d}", t))
    rows += [("unit", "null", None), ("unit", None, pool[0]), ("unit", "empty", ""), ("unit", "k00", rows[0][2]), ("quote", "short", "短"), ("unit", "copy", rows[1][2]), ("quote", "emoji", "😀" * 50), ("quote", "emoji2", "x" + "😀" * 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "origin string, item_key string, text string, rid int")
    got = [tuple(r) for r in spans.shared_spans(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_spans(rows, 40)


def test_shared_spans_of_an_empty_table_and_of_long_texts(spark):
    empty = spark.createDataFrame([], "origin string, item_key string, text string")
    assert spans.shared_spans(empty).count() == 0
    df = spark.createDataFrame([("u", "a", LONG), ("u", "b", LONG + "尾")], "origin string, item_key string, text string")
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == {("u", "a", 0, len(LONG)), ("u", "b", 0, len(LONG))}
    amounts = {r.item_key: (r.n_chars, r.shared_chars) for r in spans.shared_amount(df).collect()}
    assert amounts == {"a": (len(LONG), len(LONG)), "b": (len(LONG) + 1, len(LONG))}


def test_repeated_lines_keep_the_earliest(spark):
    a, b = "这一行足够长可以比较一下吧", "第二行也是足够长的一行文字"
    df = spark.createDataFrame([(2, f"{a}\n短\n{a}", 0), (1, f"{b}\n{a}", 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, line_no int")
    got = {tuple(r) for r in spans.repeated_lines(df).collect()}
    assert got == {(2, 0, 0, len(a), 1), (2, 2, len(a) + 3, 2 * len(a) + 3, 1)}


def test_one_form_of_each_kind_of_variant():
    same = ["É1 ab 谷一", "É1 ab​ ⾕⼀", "É１ ａｂ 谷一﻿", "Е́­1 аb 谷一"]
    points, offsets = looks.one_form(*code_points(pa.array(same)))
    forms = {bytes(points[offsets[i] : offsets[i + 1]].astype(np.uint32)) for i in range(len(same))}
    assert len(forms) == 1
    different = ["ab", "aB", "áb", "a6", "ab.", ""]
    points, offsets = looks.one_form(*code_points(pa.array(different)))
    assert len({bytes(points[offsets[i] : offsets[i + 1]]) for i in range(len(different))}) == len(different)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x2FF) | st.sampled_from("̧̣́̈谷山"), max_size=12), min_size=1, max_size=6))
def test_marks_compose_as_in_unicode(texts):
    points, offsets = looks.one_form(*code_points(pa.array(texts)))
    for i, t in enumerate(texts):
        mine = "".join(map(chr, points[offsets[i] : offsets[i + 1]]))
        expected = unicodedata.normalize("NFC", "".join(chr(x) for c in t for x in looks._expand(ord(c))))
        assert mine == expected


def test_same_look_pairs(spark):
    rows = [("unit", "a", "É谷"), ("unit", "b", "É谷"), ("unit", "c", "É谷"), ("unit", "d", "é谷"), ("quote", "e", "É⾕"), ("unit", "b", "É谷"), ("unit", None, "É⾕"), ("unit", "n", None), ("unit", "x", ""), ("unit", "y", "​")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "origin string, item_key string, text string, look string")
    assert {tuple(r) for r in looks.same_look_pairs(df).collect()} == {("unit", "a", "b"), ("unit", "b", "c"), ("unit", "x", "y")}
    assert looks.same_look_pairs(df.limit(0)).count() == 0
    forms = {r.item_key: r.one_form for r in looks.to_one_form(df).collect()}
    assert forms["n"] is None and forms["x"] == "" == forms["y"] and forms["e"] == "É谷"


def jaccard(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return 100 * len(x & y) >= 80 * len(x | y)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        base = words(rng, rng.randint(28, 120))
        rows.append((f"u{i:03d}a", f"r{rng.randint(0, 4)}", base))
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("甲乙丙丁")
        rows.append((f"u{i:03d}b", f"r{rng.randint(0, 4)}", "".join(t)))
    rows += [("x1", "r1", LONG), ("x2", "r2", LONG[:-9]), ("x3", None, LONG), (None, "r1", LONG), ("x5", "r1", None), ("x6", "r2", ""), rows[0]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "unit_id string, record_id string, text string, rid long")
    good = sorted({r for r in rows if None not in r and len(r[2]) >= 30})
    true = {(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1 :] if a[1] != b[1] and a[0] != b[0] and jaccard(a[2], b[2])}
    got = [tuple(r) for r in neardup.near_duplicate_units(df).collect()]
    assert len(got) == len(set(got)) and set(got) == true
    classes = {r.unit_id: r for r in neardup.near_duplicate_classes(df).collect()}
    assert set(classes) == {r[0] for r in rows if r[0] is not None and r[2] is not None}
    assert neardup.near_duplicate_units(df.limit(0)).count() == 0


def test_a_hot_key_is_found_across_tasks(spark):
    """Half of all texts share one word; the packed exchange must lose none of them."""

    def emit(b):
        n = b.num_rows
        ids = b.column("id").to_numpy()
        keys = np.where(ids % 2 == 0, np.uint64(7), ids.astype(np.uint64) << np.uint64(20))
        return keys, ids.astype(np.int64), np.zeros(n, np.int32)

    for chunk, width in ((500, 8), (100_000, 5)):
        got = colliding(spark.range(0, 20_000, 1, 6), emit, chunk, width)
        assert sorted(r.owner for r in got.collect()) == list(range(0, 20_000, 2))


def test_leaks(spark):
    rng = random.Random(9)
    item = "".join(words(rng, 30) + "，" for _ in range(8))
    a, b = item[:60], item[120:190]
    docs = [(1, "前言 " + a.replace("，", " ​。\n") + "后记"), (2, words(rng, 300)), (3, b + words(rng, 50) + a), (4, None), (5, ""), (None, item), (6, item[:38]), (3, b + "重复")]
    items = [(10, item), (11, words(rng, 200)), (12, None), (13, "短"), (14, "The Old Harbor Of Seven Lanterns Stood Silent Before The Siege")]
    docs.append((7, "the ｏｌｄ harbor of seven lanterns stood silent before the siege ended"))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.leaked_items(d, i).collect()}
    assert set(got) == {(1, 10), (3, 10), (7, 14)}
    assert got[(7, 14)].coverage == 1.0
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i, filter_bits=64).collect()} == set(got)  # a filter that lets everything through
    assert leaks.leaked_items(d, i.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), i).count() == 0


def test_colliding_keys_carry_their_extras(spark):
    def emit(b):
        ids = b.column("id").to_numpy()
        return (ids // 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), ids.astype(np.int64), ids * 3  # extras as int64

    for chunk, width in ((700, 8), (50_000, 5)):
        got = {(r.owner, r.extra) for r in colliding(spark.range(0, 9001, 1, 5), emit, chunk, width).collect()}
        assert got == {(i, 3 * i) for i in range(9000)}
    assert colliding(spark.range(0), emit).count() == 0


def test_wide_extras_are_part_of_the_key(spark):
    """Equal 64-bit keys whose further bits differ are different keys."""

    def emit(b):
        ids = b.column("id").to_numpy().astype(np.int64)
        return np.full(len(ids), 77, np.uint64), ids, (ids // 3) << 32 | ids

    for chunk in (50, 10_000):
        got = {(r.owner, r.extra & 0xFFFFFFFF) for r in colliding(spark.range(0, 1000, 1, 4), emit, chunk, wide=True).collect()}
        assert got == {(i, i) for i in range(999)}


def test_shared_lines_and_parts_of_them(spark):
    """Whole lines, copies beyond the two kept owners, parts of a removed line, and a line beside its own part in one record."""
    rng = random.Random(8)
    line = words(rng, 70)
    rows = [("u", f"k{i}", words(rng, 30) + "\n " + line + " \n" + words(rng, 20)) for i in range(6)]
    rows += [("u", "part", words(rng, 9) + line[5:60]), ("u", "both", line + "\n" + words(rng, 5) + line[10:58]), ("q", "alone", line), ("u", "short", line[:39]), ("u", "crlf", "\r\n" + line + "\r\n")]
    df = spark.createDataFrame(rows, "origin string, item_key string, text string").repartition(4)
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == brute_spans(rows, 40)


def _nfc_cases(rng):
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    seconds = [chr(c) for c in np.flatnonzero(mark_tables()[3])]
    letters = [*map(chr, range(0x20, 0x250)), *(list(map(chr, range(0x1100, 0x1113))) * 6), *map(chr, range(0xAC00, 0xAC40)), *map(chr, range(0x900, 0xE00)), *map(chr, range(0x3040, 0x3100))]
    pools = [letters, letters, marks, seconds, ["a", "c", "\u0301", "\u0308", "\u0327", "\u0346"]]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 10))) for _ in range(60)]


def test_composition_is_that_of_unicode_for_all_classes_and_jamo():
    rng = random.Random(4)
    for _ in range(60):
        texts = _nfc_cases(rng) + ["a\u0346\u0301", "\u00e1\u0346", "c\u0308\u0301", "\u1100\u1161\u11a8", "\uac00\u11a8", "\u0301a"]
        points, offsets = compose(*code_points(pa.array([unicodedata.normalize("NFD", t) for t in texts])))
        for i, t in enumerate(texts):
            assert "".join(map(chr, points[offsets[i] : offsets[i + 1]])) == unicodedata.normalize("NFC", t)


def test_blocked_marks_and_syllables_in_pairs(spark):
    rows = [("u", "a", "a\u0346\u0301"), ("u", "b", "\u00e1\u0346"), ("u", "c", "\uac00"), ("u", "d", "\u1100\u1161"), ("u", "e", "\u1112\u1161\u11ab"), ("u", "f", "\ud55c")]
    df = spark.createDataFrame(rows, "origin string, item_key string, text string")
    assert {tuple(r) for r in looks.same_look_pairs(df).collect()} == {("u", "c", "d"), ("u", "e", "f")}


def test_rows_of_a_batch_do_not_change_each_other(spark):
    """Leaks, looks, spans, near-duplicates and personal data of permuted and differently batched rows are the same."""
    from scriptorium.llm import personal

    model = personal.trained(300)
    rng = random.Random(10)
    item = "The \ufb01nal of\ufb01ce report about the harbor lantern weighs 10\u338f and one \u00bd of it is gone"
    docs = [(1, "see: " + item.lower() + " end"), (2, "Caf" + "e\u0301 " + words(rng, 200)), (3, "the final office report about the harbor lantern weighs 10kg"), (4, "")]
    docs += [(i, words(rng, 150) + " 电话：13900001234") for i in range(10, 40)]
    docs += [(i + 100, t[:-2] + "丁") for i, t in docs[-15:]]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    seen = set()
    for seed, size in ((0, 1), (1, 10_000), (2, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        random.Random(seed).shuffle(docs)
        d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
        records = d.selectExpr("'o' as origin", "cast(doc_id as string) as item_key", "text")
        units = d.selectExpr("cast(doc_id as string) as unit_id", "cast(doc_id % 7 as string) as record_id", "text")
        tables = (leaks.leaked_items(d, items), looks.to_one_form(records), spans.shared_spans(records), neardup.near_duplicate_units(units), personal.personal_spans(d, model))
        found = [sorted(map(tuple, x.collect())) for x in tables]
        assert all(found)
        seen.add(repr(found))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert len(seen) == 1 and "(1, 7" in seen.pop()


def test_tiles_of_repetitive_texts():
    import time

    one = np.full(8000, 97, np.uint32)
    began = time.time()
    assert leaks.tile(one, one[:5000], 40)[0][2] == 5000
    dashes = np.tile(np.arange(50, 90, dtype=np.uint32), 200)
    assert sum(t[2] for t in leaks.tile(dashes, dashes[7:4000], 40)) == 3993
    assert time.time() - began < 3


def greedy(doc, item, least):
    """Greedy string tiling by the letter: longest unmarked match, leftmost in the document, then in the item."""
    used_d, used_i, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_d.update(range(i, i + n))
        used_i.update(range(j, j + n))
        out += n


def test_tiles_equal_greedy_tiling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        doc, item = (rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint32) for _ in "ab")
        tiles = leaks.tile(doc, item, 3)
        assert all((doc[i : i + n] == item[j : j + n]).all() and n >= 3 for i, j, n in tiles)
        assert sum(n for *_, n in tiles) == greedy(doc.tolist(), item.tolist(), 3)


def test_tiling_finds_reordered_passages():
    rng = np.random.default_rng(1)
    item = rng.integers(100, 5000, 300).astype(np.uint32)
    doc = np.concatenate([item[200:300], rng.integers(9000, 9999, 20).astype(np.uint32), item[0:150]])
    assert sorted((i, j, n) for i, j, n in leaks.tile(doc, item, 40)) == [(0, 200, 100), (120, 0, 150)]
    assert leaks.tile(item[:39], item, 40) == []


@pytest.mark.parametrize("n", [0, 39, 40, 41])
def test_tiles_at_the_limit(n):
    item = np.arange(1000, 1000 + n, dtype=np.uint32)
    assert sum(t[2] for t in leaks.tile(item, item, 40)) == (n if n >= 40 else 0)
