"""Markup, rules, tokens, sources and selections on small hand-made cases."""

import gzip
import hashlib
import json
import random
import re

import pytest

from scriptorium.functions.grams import with_gram_sets
from scriptorium.functions.tokens import Characters, Tokens
from scriptorium.operators import assembly, chunking, dedupe, fusion, intervals, markup, rules, search
from scriptorium.sources import sealed


def test_visible_text_links_and_entries():
    got = markup.rich_text("<p>Hello <b>wor&amp;ld</b><br>x</p><script>no</script><div>a  b<p>c</p></div><a href='/x'>l</a><img src=u><i data-entry-id=7>e</i>&#33;")
    assert got == {"text": "Hello wor&ld\nx\na b\nc\nle!", "links": ["/x"], "media": ["u"], "entries": ["7"]}
    assert markup.rich_text("")["text"] == "" and markup.rich_text("</p>open <b>never closed")["text"] == "open never closed"
    assert len(markup.rich_text("<div>" * 3000 + "deep")["text"]) == 4


def test_blocks_in_order():
    got = [(b["kind"], b["parent_no"], b["text"]) for b in markup.blocks("loose <b>x</b><h2>T</h2><ul><li>one</li></ul><blockquote><p>q</p></blockquote><hr><div>d<p>e</p>f</div>")]
    assert got == [("paragraph", None, "loose x"), ("heading", None, "T"), ("list", None, ""), ("item", 2, ""), ("paragraph", 3, "one"), ("quote", None, ""), ("paragraph", 5, "q"), ("separator", None, ""), ("group", None, ""), ("paragraph", 8, "d"), ("paragraph", 8, "e"), ("paragraph", 8, "f")]
    assert markup.blocks("a<i>b</i><a href=x>c</a>")[0]["marks"] == ["emphasis 1 2", "link 2 3"] and markup.blocks("") == []


def test_table_grid():
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><th>d</th></tr><tr><td rowspan=x>e</td></tr></table><table><tr><td rowspan=0>z</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>"
    got = [(c["table_no"], c["row"], c["column"], c["text"], c["problem"]) for c in markup.table_cells(html)]
    assert got == [(0, 0, 0, "a", None), (0, 0, 1, "b", None), (0, 1, 1, "c", None), (0, 1, 2, "d", None), (0, 2, 0, "e", "rowspan"), (1, 0, 0, "z", None), (1, 0, 1, "1", None), (1, 1, 1, "2", None), (1, 2, 1, "3", None)]


def test_layout_edits_replay():
    text = "<p>one</p><div>two<br/>three</div >x"
    status, edits = markup.layout_edits(text)
    assert status == "projected" and markup.apply_edits(text, edits) == "one\ntwo\nthreex"
    assert markup.layout_edits("<p>a<b>x</p></b>") == ("preserved", []) and markup.layout_edits("a < b") == ("identity", []) and markup.layout_edits("<table>x</table>") == ("preserved", []) and markup.layout_edits("<p></p>") == ("preserved", [])
    with pytest.raises(ValueError):
        markup.apply_edits("abc", [(2, 1, "")])


def test_quantity_lists_equal_the_regular_expression():
    pattern = re.compile(r"(?:\s*[^\d*×\n。！？；：:]{1,40}\s*[*×]\s*\d+(?:\.\d+)?\s*)+")
    rng = random.Random(1)
    for _ in range(20_000):
        s = "".join(rng.choice("ab *×1.\n 2：") for _ in range(rng.randint(0, 14)))
        assert rules.quantities(s) == bool(pattern.fullmatch(s)), s
    assert rules.quantities("甲" * 40 + "×1") and not rules.quantities("甲" * 41 + "×1") and not rules.quantities("a*1 " * 5000 + "b")


def test_first_matching_rule_and_selector(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "x", ["a"]), (2, None, None), (3, "yz", ["b", "c"])], "k int, t string, tags array<string>")
    got = {r.k: (r.x.decision, r.x.reason) for r in df.select("k", rules.first_match([(F.col("t") == "x", "in", "one"), (F.col("k") > 0, "out", "two")], "rest", "none").alias("x")).collect()}
    assert got == {1: ("in", "one"), 2: ("out", "two"), 3: ("out", "two")}
    picked = lambda **kw: {r.k for r in df.where(rules.selector(**kw)).collect()}
    assert picked(values={"t": ["x", "yz"]}) == {1, 3} and picked(values={}, prefixes={"t": ["y"]}) == {3} and picked(values={}, arrays={"tags": ["a", "c"]}) == {1, 3} and picked(values={"t": []}) == {1, 2, 3}


def test_token_rulers():
    tokens, text = Tokens(), "灰狼 met the wolf。第二句 is here. 😀 ende"
    ruler = tokens.ruler(text)
    assert ruler.count(0, len(text)) == tokens(text)
    for limit in (1, 3, 7):
        spans = chunking.token_windows(text, limit, tokens)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(ruler.count(s, e) <= limit or e - s == 1 for s, e in spans)
    long = "这是一句话。" * 300
    assert all(tokens.ruler(long).count(s, e) <= 384 for s, e in chunking.pack(long, 240, 384, tokens))
    assert chunking.split_long("", 5, Characters()) == [] and chunking.split_long("abc", 2) == [(0, 2), (2, 3)]


def test_structured_lines_are_cut_only_if_too_long():
    got = chunking.structured_lines(["aa", "bbb", "c" * 12, "", "d"], 6)
    assert got == [[(0, 0, 2), (1, 0, 3)], [(2, 0, 6)], [(2, 6, 12)], [(3, 0, 0), (4, 0, 1)]]
    assert chunking.structured_lines([], 6) == []


def test_pointers_and_paths(spark):
    value = json.loads('{"a/b": {"~": [10, {"x": null}]}, "": 1}')
    assert sealed.pointer_get(value, "/a~1b/~0/1/x") is None and sealed.pointer_get(value, "/") == 1 and sealed.pointer_get(value, "") is value
    for bad in ("/a~1b/~0/2", "/a~1b/~0/01", "/zz"):
        with pytest.raises(KeyError):
            sealed.pointer_get(value, bad)
    df = spark.createDataFrame([(1, '{"b": [true, " x "], "a": {"n": 1.50, "e": "  ", "z": null}}'), (2, "{"), (3, None)], "k int, body string")
    assert [tuple(r) for r in sealed.scalar_paths(df, "k", "body").orderBy("k", "place").collect()] == [(1, 0, "/a/n", "1.50"), (1, 1, "/b/0", "true"), (1, 2, "/b/1", "x")]


def test_runs_receipts_and_accounted_scans(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    for name, body in (("a.json", b"{}"), ("b.json", b"[1]"), ("c.json", b"x"), ("d.json", b"y")):
        (folder / name).write_bytes(body)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a.json", digest(b"{}"), True, 200), ("b.json", "00", True, 200), ("c.json", digest(b"x"), False, 500), ("e.json", digest(b""), True, 200)], "file string, sha256 string, ok boolean, status int")
    assert {r.file: r.state for r in sealed.read_run(spark, str(folder), manifest).collect()} == {"a.json": "good", "b.json": "digest differs", "c.json": "failed", "d.json": "unlisted", "e.json": "missing"}
    before = spark.createDataFrame(sealed.file_bindings(spark, str(folder)).collect())
    (folder / "a.json").write_bytes(b"{ }")
    (folder / "d.json").unlink()
    (folder / "new.json").write_bytes(b"n")
    assert {r.file: r.change for r in sealed.changed_bindings(before, sealed.file_bindings(spark, str(folder))).collect()} == {"a.json": "changed", "d.json": "removed", "new.json": "added"}
    path = str(tmp_path / "rows.jsonl.gz")
    with gzip.open(path, "wt") as f:
        f.write('{"k": 1}\n{"k": 2}\n')
    assert sealed.read_accounted(spark, path, "k int", 2).count() == 2
    with pytest.raises(ValueError):
        sealed.read_accounted(spark, path, "k int", 3)


def test_disjoint_selection_equals_the_sequential_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"k{i}", rng.randint(1, 12), rng.randint(1, 12)) for i in range(300)] + [(None, "n", 1, 2)]
    df = spark.createDataFrame(rows, "s string, k string, x int, y int")
    want, used = {}, set()
    for s in "ab":
        ordered = sorted((hashlib.sha256(f"seed:{s}:{r[1]}".encode()).hexdigest(), r) for r in rows if r[0] == s)
        taken = 0
        for _, r in ordered:
            if taken >= 4:
                want[r[1]] = "quota full"
            elif {r[2], r[3]} & used:
                want[r[1]] = "source used"
            else:
                want[r[1]], taken = "selected", taken + 1
                used |= {r[2], r[3]}
    for page in (2, 1000):
        assert {r.k: r.disposition for r in fusion.disjoint_selection(df, "s", "k", ("x", "y"), "seed", 4, page).collect()} == want


def test_matched_controls_equal_the_greedy_choice(spark):
    rng = random.Random(5)
    anchors = [("g", i, rng.randint(0, 60)) for i in range(6)]
    controls = [("g", 100 + i, rng.randint(0, 60)) for i in range(80)] + [("other", 500, 3)]
    left, want = [(c[2], c[1]) for c in controls if c[0] == "g"], {}
    for _, a, size in anchors:
        best = min(left, key=lambda c: (abs(c[0] - size), c[1]))
        left.remove(best)
        want[a] = (best[1], abs(best[0] - size))
    a, c = spark.createDataFrame(anchors, "s string, a long, n long"), spark.createDataFrame(controls, "s string, c long, n long")
    assert {r.a: (r.c, r.distance) for r in fusion.matched(a, c, "s", "a", "c", "n").collect()} == want
    few = fusion.matched(a, c.limit(2), "s", "a", "c", "n").collect()
    assert len(few) == 2 and fusion.matched(a.limit(0), c, "s", "a", "c", "n").count() == 0


def test_gram_sets_and_similar_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    rows = [(i, t[: rng.randint(50, 60)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))) for i, t in enumerate(base * 4)] + [(90, None), (91, ""), (92, "ab"), (93, base[0]), (94, base[0])]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    sizes = {r.id: len(r.g) for r in with_gram_sets(df, "text", 3).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if t else set()
    assert sizes == {i: len(grams(t)) for i, t in rows}
    want = {(a[0], b[0], len(grams(a[1]) & grams(b[1]))) for a in rows for b in rows if a[0] < b[0] and grams(a[1]) and grams(b[1]) and 100 * len(grams(a[1]) & grams(b[1])) >= 80 * len(grams(a[1]) | grams(b[1]))}
    assert {(r.a, r.b, r.shared) for r in dedupe.similar_pairs(df, "id", "text", 3, 80).collect()} == want


def test_long_chains_of_survivors(spark):
    keys = spark.range(0, 45).withColumnRenamed("id", "key")
    pairs = keys.where("key < 44").selectExpr("key as a", "key + 1 as b")
    assert {r.key: r.kept for r in dedupe.greedy_survivors(keys, pairs).collect()} == {i: i % 2 == 0 for i in range(45)}


def test_shared_length_counts_once(spark):
    rows = [("c1", "u", 0, 100), ("c1", "u", 50, 120), ("c2", "u", 90, 95), ("c2", "u", 80, 130), ("c3", "v", 0, 9), ("c2", "u", 5, 5)]
    df = spark.createDataFrame(rows, "o string, unit string, start int, end int")
    assert [tuple(r) for r in intervals.shared_length(df, ["unit"], "o", cell=16).collect()] == [("c1", "c2", 40)]


def test_best_rows_of_a_partition_do_not_depend_on_batches():
    import numpy as np

    rng = np.random.default_rng(2)
    keys, scores = np.arange(500), np.round(rng.random((500, 3)), 1)  # many ties
    want = [(q, k, scores[k, q]) for q in range(3) for k in sorted(keys, key=lambda k: (-scores[k, q], k))[:7]]
    for step in (1, 13, 500):
        best = search._Best([0, 1, 2], 7)
        for at in range(0, 500, step):
            best.offer(keys[at : at + step], scores[at : at + step])
        b = best.batch("doc_id")
        assert list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())) == want
    assert search._Best([5], 3).batch("doc_id").num_rows == 0


def test_packed_rows(spark):
    df = spark.createDataFrame([("o", 2, 5), ("o", 1, 4), ("o", 3, 3), ("p", 1, 99)], "owner string, i int, n int")
    got = {(r.owner, r.i): r.batch for r in assembly.packed(df, "owner", ["i"], "n", 8, None).collect()}
    assert got == {("o", 1): 0, ("o", 2): 1, ("o", 3): 1, ("p", 1): 0}


def test_fetching_with_retries(spark):
    import http.server
    import threading

    from scriptorium.sources import http as source

    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = seen[self.path] = seen.get(self.path, 0) + 1
            code = {"/ok": 200, "/gone": 404, "/busy": 200 if n > 2 else 429, "/down": 503}[self.path]
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(base + p,) for p in ("/ok", "/ok", "/gone", "/busy", "/down")] + [(None,)], "url string")
    got = {r.url[len(base) :]: (r.status, r.attempts, bytes(r.body)) for r in source.fetch(df, attempts=3, first=0.01).collect()}
    server.shutdown()
    assert got == {"/ok": (200, 1, b"/ok"), "/gone": (404, 1, b"/gone"), "/busy": (200, 3, b"/busy"), "/down": (503, 3, b"/down")}


def test_waiting_times():
    from scriptorium.sources.http import wait_before

    assert wait_before(1, 200, None, 0, 0) is None and wait_before(1, 404, None, 0, 0) is None
    assert wait_before(1, 429, "7", 0, 0) == 7 and wait_before(1, 429, "700", 0, 0) == 60 and wait_before(3, 503, None, 0, 0.5) == 6 and wait_before(9, None, None, 0, 0.9) == 60
    assert wait_before(1, 429, "Thu, 01 Jan 1970 00:00:30 GMT", 10, 0) == 20 and wait_before(2, 429, "soon", 0, 0) == 2
