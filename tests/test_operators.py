"""Core operators on tiny hand-made cases, dirty input and invariants."""

import json
import random

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.operators import assembly, chunking, dedupe, fusion, graphs, intervals, search, shapes, statistics

FETCH = "content_key string, ok boolean, http_status int, body string, fetched_at timestamp, tie long"


def page(modules, key="p1", retcode=0):
    return json.dumps({"retcode": retcode, "data": {"page": {"id": key, "modules": modules}}})


def test_page_nodes_of_dirty_fetches(spark):
    import datetime as dt

    t = lambda i: dt.datetime(2025, 1, i)
    whole = [{"id": "m0", "components": [None, {"component_id": "x", "data": None}, {"component_id": "y", "a/b": {"components": [{"deep": 1}]}}]}, None, {"id": "m2"}]
    rows = [
        ("k1", True, 200, page(whole), t(1)), ("k1", True, 200, page([{"late": 1}])[:-4], t(3)), ("k1", True, 200, page([{}], retcode=-1), t(4)), ("k1", False, 500, page([{}]), t(5)), ("k1", None, 200, page([{}]), t(6)),
        ("k2", True, 200, page([{"n": 1}], key=77), t(1)), ("k2", True, 200, page([{"n": 2}], key=77), None), ("k3", True, 200, page([{}], key=None), t(1)), ("k4", True, 200, None, t(1)), (None, True, 200, page([{}]), t(1)),
        ("k5", True, 200, "[1, 2]", t(1)), ("k6", True, 200, json.dumps({"retcode": 0, "data": None}), t(1)), ("k7", True, 200, page([[{"nested": 1}]], key="p7"), t(1)),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], FETCH)
    got = {(r.root_id, r.parent_pointer, r.pointer) for r in shapes.page_nodes(df).collect()}
    assert got == {
        ("p1", "/data/page", "/data/page/modules/0"), ("p1", "/data/page", "/data/page/modules/2"), ("p1", "/data/page/modules/0", "/data/page/modules/0/components/1"),
        ("p1", "/data/page/modules/0", "/data/page/modules/0/components/2"), ("p1", "/data/page/modules/0/components/2/a~1b", "/data/page/modules/0/components/2/a~1b/components/0"), ("77", "/data/page", "/data/page/modules/0"),
    }
    typed = shapes.subtype_table(shapes.page_nodes(df), "components")
    assert {r.component_id for r in typed.collect()} == {"x", "y", None} and "deep" in typed.columns
    assert shapes.page_nodes(df.limit(0)).count() == 0


def test_lineage_of_dirty_records(spark):
    lin = "struct<parsed_json_pointer:string, raw_refs:array<struct<json_pointer:string>>>"
    schema = f"record_id string, built_at timestamp, lineage {lin}, sections array<struct<lineage:{lin}, component_contexts:array<struct<lineage:{lin}>>, units:array<struct<lineage:{lin}>>>>, newest int"
    import datetime as dt

    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    ref = lambda *p: [None if x == "!" else (x,) for x in p]
    rows = [
        ("r1", a, ("/old", ref("/x")), None, 0), ("r1", b, ("", ref("", None, "!")), [None, (("/s", ref("/t", "/t")), None, [None, (None,), (("/u", None),), (("/v", ref("/w")),)])], 0), ("r1", b, ("", ref("")), None, 0),
        ("r2", None, (None, ref("/x")), [], 0), (None, b, ("/p", ref("/q")), None, 0), ("r3", None, ("/p", ref("/q")), None, 0),
    ]
    got = {tuple(r) for r in shapes.lineage_links(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("r1", "", ""), ("r1", "/s", "/t"), ("r1", "/v", "/w"), ("r3", "/p", "/q")}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab 。！\n#字", max_size=300), st.integers(5, 60))
def test_pieces_cover_the_text(text, size):
    for spans in (chunking.split_long(text, size), chunking.pack(text, size, size + 20), chunking.newline_split(text, size)):
        if text:
            assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(e - s <= size for s, e in chunking.split_long(text, size))
    assert all(e - s <= size + 20 for s, e in chunking.pack(text, size, size + 20))


def test_packing_rules():
    assert chunking.pack("一。二。三。", 4, 6) == [(0, 4), (4, 6)]
    assert chunking.pack("甲甲。\n# 头\n乙。", 100, 200)[1][0] == 4
    assert chunking.greedy_batches([5, 6, 20, 1, 1], 10) == [0, 1, 2, 3, 3]
    assert chunking.padded_batches([9, 1, 2, 8], 10, 3) == [2, 0, 0, 1]


def test_chunks_and_aliases(spark):
    df = spark.createDataFrame([(1, "短文。"), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.chunks(df).collect()
    assert [(r.doc_id, r.granularities) for r in rows] == [(1, ["macro", "micro"])]
    a = spark.createDataFrame([(3, "x", "t"), (1, "x", "t"), (2, None, "t"), (5, "x", "t")], "k long, l string, t string")
    assert [(r.key, r.aliases) for r in chunking.fold_aliases(a, "k", "l", "t").collect()] == [(1, [3, 5])]


def test_intervals_equal_marking(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, s, s + rng.randint(-1, 9)) for i in range(60) for s in [rng.randint(0, 90)]] + [("a", 99, None, 4), (None, 100, 1, 3)]
    df = spark.createDataFrame(rows, "k string, id int, start int, end int")
    marked = {}
    for k, _, s, e in rows:
        if k and s is not None:
            for i in range(s, e):
                marked.setdefault(k, {}).setdefault(i, 0)
                marked[k][i] += 1
    got = {r.k: (r.single, r.covered) for r in intervals.union_length(df, ["k"]).collect()}
    assert all(got[k] == (sum(m.values()), len(m)) for k, m in marked.items())
    pairs = {(r.k, r.a, r.b, r.shared) for r in intervals.overlaps(df, ["k"], "id", cell=4).collect()}
    assert pairs == {(p[0], p[1], q[1], min(p[3], q[3]) - max(p[2], q[2])) for p in rows for q in rows if p[0] and p[0] == q[0] and None not in p + q and p[1] < q[1] and max(p[2], q[2]) < min(p[3], q[3])}
    lengths = spark.createDataFrame([("a", 100), ("c", 5)], "k string, length int")
    left = sum(r.end - r.start for r in intervals.gaps(df, lengths, ["k"]).where("k = 'a'").collect())
    assert left == 100 - len([i for i in marked["a"] if i < 100])
    assert [(r.start, r.end) for r in intervals.gaps(df, lengths, ["k"]).where("k = 'c'").collect()] == [(0, 5)]


def test_distribution_indexes(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, 7)] + [("b", 3), ("a", None)], "g string, v int")
    r = {x.g: x for x in statistics.distribution(df, ["g"], "v").collect()}
    assert (r["a"].n, r["a"].min, r["a"].p50, r["a"].p90, r["a"].max, r["a"].total) == (5, 1, 5, 7, 9, 23) and r["b"].p99 == 3


def test_graph_functions():
    nodes, edges = list("abcde"), [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "b"), ("d", "y")]
    assert graphs.display_order(nodes, edges, "a") == (["a", "b", "c", "d", "e"], False)
    assert graphs.reach(nodes, edges, "a") == set("abcd")
    assert graphs.components(nodes, edges) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    assert graphs.diagnostics(nodes, edges, "a") == ["dangling edge", "missing parent", "orphan", "several parents"]
    assert graphs.diagnostics(["a", "b"], [("a", "b"), ("b", "a")], None) == ["cycle", "root missing"]
    assert graphs.guards(nodes, edges, "a", {"a": {"1"}, "b": {"2"}, "c": {"3"}})["d"] == {"1"}
    assert graphs.diagnostics([], [], "") == ["no nodes", "root empty"]
    assert graphs.bounded_walk(["a"], [("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d")], hops=2) == (["a", "b", "c"], False)
    assert graphs.bounded_walk(["a"], [("1", "a", "b"), ("2", "a", "c")], most_nodes=2) == (["a", "b"], True)


def test_reachability_rounds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "y")], "a string, b string")
    got = graphs.reachable(e, spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r.hops) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_fusion_reranks_inside_a_granularity(spark):
    hits = spark.createDataFrame([(1, "x", "micro", "a", 1), (1, "x", "macro", "a", 1), (1, "x", "micro", "b", 2), (1, "y", "macro", "c", 1), (1, "y", "macro", "c", 1)], "query_id int, channel string, granularity string, key string, rank int")
    got = {r.key: r.rank for r in fusion.fuse_routes(hits, {"x": 1, "y": 1}).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    bad = {(r.channel, r.problem) for r in fusion.contract_violations(spark.createDataFrame([(1, "x", "g", "a", 1), (1, "x", "g", "b", 1), (1, "y", "g", "a", 2)], hits.schema)).collect()}
    assert bad == {("x", "position taken twice"), ("y", "positions not contiguous")}


def test_deferral_needs_a_main_cover(spark):
    ranked = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("abcd")], "query_id int, key string, rank int")
    covers = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "by string, key string")
    got = {r.key: (r.main, r.final_rank, r.disposition) for r in fusion.defer_covered(ranked, covers, 3).collect()}
    assert got == {"a": (True, 1, "selected"), "c": (True, 2, "selected"), "d": (True, 3, "selected"), "b": (False, 4, "outside")}


def test_mmr_prefers_the_different(spark):
    rows = [(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.5, [1.0, 0.0]), (1, "c", 0.45, [0.0, 1.0]), (1, "d", 0.0, [0.6, 0.8])]
    got = fusion.mmr(spark.createDataFrame(rows, "query_id int, key string, score double, embedding array<double>"), keep=3)
    assert [r.key for r in got.orderBy("pick").collect()] == ["a", "c", "b"]


def test_search_of_tiny_corpora(spark):
    docs = spark.createDataFrame([(1, "red fox fox"), (2, "blue fox"), (3, None), (None, "fox"), (4, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "fox"), (2, "none"), (3, None), (4, "red red")], "query_id int, text string")
    got = [(r.query_id, r.doc_id, r.rank) for r in search.bm25(docs, q).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (4, 1, 1)]
    v = spark.createDataFrame([(i, [float(i == j) for j in range(3)], "x") for i in range(3)] + [(9, [1.0, 0.0, 0.0], "x"), (None, None, "x")], "vec_id long, embedding array<float>, score string")
    got = search.dense_top_k(v, v.where("vec_id in (0, 9)"), 2, block=1)
    assert {(r.query_id, r.vec_id, r.rank) for r in got.collect()} == {(0, 9, 1), (0, 1, 2), (9, 0, 1), (9, 1, 2)}


def test_survivors_follow_the_order(spark):
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "a string, b string")
    got = {r.key for r in dedupe.greedy_survivors(keys, pairs).where("kept").collect()}
    assert got == {"a", "c", "e", "f"}


def test_short_sets_index_few_grams():
    larger, either, depth = dedupe._shares(np.arange(1, 80), 50)
    assert (depth >= 1).all() and (depth <= either).all() and (either <= larger).all()
    assert 26 - larger[25] + depth[25] <= 13 and 26 - either[25] + depth[25] <= 16


def test_survivors_make_the_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    chain = [(k, k + 1) for k in range(12)]
    pairs = spark.createDataFrame(chain, "a int, b int").mapInArrow(seen, "a int, b int")
    got = {r.key for r in dedupe.greedy_survivors(spark.range(13).selectExpr("int(id) key"), pairs).where("kept").collect()}
    assert got == set(range(0, 13, 2))
    assert made.value <= 2 * len(chain)  # a checkpoint may make them twice


def test_survivors_of_a_chain_take_few_jobs(spark):
    sc = spark.sparkContext
    chain = [(f"k{k:02}", f"k{k + 1:02}") for k in range(30)]
    keys = spark.createDataFrame([(f"k{k:02}",) for k in range(31)], "key string")
    sc.setJobGroup("chain", "chain")
    got = {r.key for r in dedupe.greedy_survivors(keys, spark.createDataFrame(chain, "a string, b string")).where("kept").collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"k{k:02}" for k in range(0, 31, 2)}
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) <= 12


def test_survivors_in_rounds_and_in_order_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b}
    kept = []
    for k in range(60):
        kept += [k] if not any((a, k) in pairs for a in kept) else []
    for most in (1_000_000, 40, 0):
        monkeypatch.setattr(dedupe, "SOLVED", most)
        got = dedupe.greedy_survivors(spark.range(60).selectExpr("int(id) key"), spark.createDataFrame(sorted(pairs), "a int, b int").repartition(3))
        assert sorted(r.key for r in got.where("kept").collect()) == kept


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 30)))
        rows += [(2 * i, t), (2 * i + 1, t[: rng.randint(1, len(t))] + "x")]
    rows += [(900, rows[0][1]), (901, None), (902, "")]
    sets = {k: {t[j : j + 3] for j in range(len(t) - 2)} for k, t in rows if t and len(t) >= 3}
    true = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    got = dedupe.similar_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 3, 60)
    assert {(r.a, r.b) for r in got.collect()} == true


def _near_texts(rng: random.Random, lengths: list[int]) -> list[tuple[int, str]]:
    """Texts over many characters, each with two copies changed at random places."""
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(n))
    rows = []
    for n in lengths:
        t = word(n)
        for share in (0, 0.03, 0.12):
            rows.append((len(rows), "".join(word(1) if rng.random() < share else c for c in t)))
    return rows


def test_similar_pairs_of_many_sizes_equal_brute_force(spark):
    rows = _near_texts(random.Random(10), [3 + i % 37 for i in range(120)] + list(range(100, 180, 2)) + [400, 900])
    sets = {k: {t[j : j + 3] for j in range(len(t) - 2)} for k, t in rows}
    shared = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    for percent in (50, 80):
        true = {(a, b, n, len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}
        got = dedupe.similar_pairs(spark.createDataFrame(rows, "id int, text string").repartition(5), "id", "text", 3, percent)
        assert {tuple(r) for r in got.collect()} == true and len(true) > 100


def test_short_sets_are_decided_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "_compared", lambda n: lambda batches: (b.select([0, 1]).slice(0, 0) for b in batches if b.num_rows and 1 / 0))
    rows = _near_texts(random.Random(11), [20 + i % 15 for i in range(40)])
    assert dedupe.similar_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 3, 50).count() >= 40


def _shuffled(spark, make) -> tuple[list, int]:
    """Rows of a query and the bytes it wrote to shuffles."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    rows = make().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, written() - before


def test_similar_long_texts_cost_few_shuffled_bytes(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t[:-20]) for i, t in enumerate(texts[:20])]
    got, sent = _shuffled(spark, lambda: dedupe.similar_pairs(spark.createDataFrame(rows, "id int, text string").repartition(4), "id", "text", 3, 80))
    assert {(r.a, r.b) for r in got} == {(i, 1000 + i) for i in range(20)}
    assert sent < 10 * sum(len(t) for _, t in rows)


def test_admission_goes_on_after_a_miss(spark):
    c = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 40), (1, "d", 4, 500)], "query_id int, key string, rank int, size long")
    got = {r.key: r.reason for r in assembly.admit(c, total=100, each=200).collect()}
    assert got == {"a": "admitted", "b": "no room", "c": "admitted", "d": "too large"}


def test_near_paragraphs_are_all_found(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    tests = [(i, word(150)) for i in range(4)] + [(9, None), (10, ""), (11, "short")]
    change = lambda t, step: "".join("#" if i % step == 3 else c for i, c in enumerate("".join(t.split())))
    near = [change(tests[i % 4][1], rng.choice((3, 5, 7, 40))) for i in range(60)] + [tests[0][1]] * 30
    blocks = [word(400) + tests[1][1][:n] + word(400) for n in (80, 130, 150)]
    lines = [*near, *blocks, word(150), tests[2][1][:50], "", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "key int, text string").repartition(3)
    want = set()
    for k, t in enumerate(lines):
        for i, p in tests:
            a, b = "".join((p or "").split()), "".join((t or "").split())
            m = SequenceMatcher(None, a, b, autojunk=False)
            if min(len(a), len(b)) >= 60 and m.ratio() >= 0.8 or m.find_longest_match().size >= 90:
                want.add((k, i, round(m.ratio(), 6), m.find_longest_match().size))
    assert sum(i == 0 for _, i, _, _ in want) > 40 and any(r < 0.8 for _, _, r, _ in want)
    assert {tuple(r) for r in dedupe.near_paragraphs(rows, tests).collect()} == want
    assert dedupe.near_paragraphs(rows, []).count() == 0


def test_paragraphs_keep_their_offsets(spark):
    df = spark.createDataFrame([(1, "一\r\n\n  \nzwei "), (2, None)], "k int, text string")
    assert [tuple(r) for r in dedupe.paragraphs(df, "k").collect()] == [(1, 0, "一"), (1, 7, "zwei ")]


def test_walks_go_on_to_their_end(spark):
    import pytest

    e = spark.createDataFrame([(i, i + 1) for i in range(22)], "a int, b int").coalesce(1)
    start = spark.createDataFrame([(0,)], "node int")
    assert {(r.node, r.hops) for r in graphs.reachable(e, start).collect()} == {(i, i) for i in range(23)}
    assert graphs.reachable(e, start, 2).count() == 3
    with pytest.raises(ValueError):
        graphs.reachable(e, start, most_rounds=3)
    links = [(i, i - 1 if i % 100 else None) for i in range(250)] + [(900, 901), (901, 900), (902, 901)]
    df = spark.createDataFrame(links, "node int, back int")
    assert {(r.node, r.hops) for r in graphs.chain_places(df).collect()} == {(i, i % 100) for i in range(250)}
    with pytest.raises(ValueError):
        graphs.chain_places(df, 3)
    with pytest.raises(ValueError):
        graphs.chain_places(df.union(df.limit(1)))


def test_variants_are_told_apart_at_any_depth():
    a, b = ({"k": {"x": {"y": v}}, "n": 1} for v in (1, "1"))
    assert shapes.state(a) != shapes.state(b) and shapes.state([a]) != shapes.state([b])
    assert shapes.state(a) == shapes.state({"n": 2.5, "k": {"x": {"y": 7}}})
    deep = {}
    for _ in range(5000):
        deep = {"d": [deep]}
    assert shapes.state(deep).startswith("{d:[{#")
    (node,) = shapes.nodes_of({"modules": [{"tags": ["a", 1], "empty": [], "rows": [{}], "t": "x"}]}, frozenset(["modules"]))
    assert dict(node["fields"]) == {"tags": '["a",1]', "empty": "[]", "t": "x"}


def test_contained_hits_are_covered(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "e"), (2, "b"), (2, "d")], "query_id int, key string")
    texts = spark.createDataFrame([("a", "one two three"), ("b", "two"), ("c", "two"), ("d", "two three"), ("e", None)], "key string, text string")
    got = {(r.by, r.key) for r in fusion.containment(hits, texts).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b"), ("d", "b")}


def test_variants_in_typed_tables(spark):
    import datetime as dt
    import json

    page = lambda i, mods: json.dumps({"retcode": 0, "data": {"page": {"id": i, "modules": mods}}})
    day = dt.datetime(2025, 1, 1)
    mods = [{"id": "a", "n": 1, "flag": True, "tags": ["x", 2]}, {"id": 7, "rest": "r", "ID": "upper", "pointer": "p"}, {"id": None, "n": 2.5, "components": [{"k": 1}]}, None, {}]
    rows = [("c", True, 200, page(5, mods), day), ("c", True, 200, page(5, []), dt.datetime(2024, 1, 1)), ("d", True, 200, page(None, mods), day), ("e", True, 200, "{", day), (None, True, 200, page(6, mods), day)]
    nodes = shapes.routed(shapes.page_nodes(spark.createDataFrame(rows, "content_key string, ok boolean, http_status int, body string, fetched_at timestamp")))
    catalog = {(r.array_name, r.key): (r.kind, r.n, r.common) for r in shapes.key_catalog(nodes).collect()}
    assert catalog[("modules", "id")] == ("mixed", 3, False) and catalog[("modules", "n")] == ("number", 2, False) and catalog[("components", "k")] == ("number", 1, True)
    t = {r.position: r.asDict() for r in shapes.subtype_table(nodes, "modules").collect()}
    assert set(t) == {0, 1, 2, 4} and t[0]["n"] == 1.0 and t[0]["flag"] is True and t[0]["tags"] == ["x", "2"] and t[2]["n"] == 2.5 and t[1]["ID"] == "upper" and "id_value" in t[1]
    assert t[1]["pointer"] == "/data/page/modules/1" and t[1]["pointer_value"] == "p" and t[1]["rest_value"] == "r" and len({c.lower() for c in t[1]}) == len(t[1])
    one = shapes.subtype_table(nodes, "modules", shape=t[0]["shape"])
    assert one.count() == 1 and set(one.columns) == {*shapes.LINKS, "id", "n", "flag", "tags", "rest"}
    common = shapes.subtype_table(nodes, "modules", common=True)
    assert set(common.columns) == {*shapes.LINKS, "rest"} and common.count() == 4
    assert shapes.subtype_table(nodes, "tab").count() == 0


def test_states_of_typed_columns(spark):
    df = spark.createDataFrame([((None, ["a", None]),), ((1, []),), ((2, None),), (None,)], "x struct<n:int, a:array<string>>")
    got = [r[0] for r in df.select(shapes.state_of(df["x"], df.schema["x"].dataType)).collect()]
    assert got == ["{a:[null|string],n:null}", "{a:[],n:number}", "{a:null,n:number}", "null"]
