"""Conversations, defects, mixing and personal data on small fixtures."""

import datetime as dt
import math
import random

from scriptorium.llm import chats, mixing, pairs, personal

TURNS = "id string, session string, sequence long, cancelled int, question string, kind string"
MESSAGES = "id string, session string, turn string, role string, body string, created_at timestamp, turn_no int"


def test_conversations_keep_only_whole_sessions(spark):
    turns = [
        ("t2", "ok", 9, 0), ("t1", "ok", 3, 0), ("t1", "ok", 3, 0), ("t3", "ok", 1, 1), ("b1", "blank", 4, 0), ("s1", "second", 5, 0), ("r1", "role", 6, 0),
        ("o1", "other", 7, 0), ("g1", "ghost", 8, 0), ("c1", "gone", 10, 1), ("n1", "noanswer", 11, 0), ("z1", None, 12, 0), (None, "ok2", 13, 0), ("m1", "nullnames", 14, None),
    ]
    said = [
        ("1", None, "t1", " User", "hi"), ("2", "ok", "t1", "AI", "yes"), ("2", "ok", "t1", "AI", "yes"), ("3", "ok", "t2", "human", "q"), ("4", "ok", "t2", "model", "a"), ("5", "ok", "t3", "user", "x"),
        ("6", "blank", "b1", "user", "q"), ("7", "blank", "b1", "assistant", "​ \n"), ("8", None, "s1", "user", "q"), ("9", None, "s1", "user", ""), ("10", None, "s1", "ai", "a"),
        ("11", None, "r1", "user", "q"), ("12", None, "r1", "ai", "a"), ("13", None, "r1", "???", "a"), ("14", "elsewhere", "o1", "user", "q"), ("15", None, "o1", "ai", "a"),
        ("16", None, "g1", "user", "q"), ("17", None, "g1", "ai", "a"), ("18", "ghost", "nowhere", "user", "q"), ("19", None, "c1", "user", "q"), ("20", None, "n1", "user", "q"),
        ("21", None, "m1", "user", "q"), ("22", None, "m1", "Assistant", "a"), ("23", None, None, None, None), (None, "ok", "t1", "user", "lost"),
    ]
    t = spark.createDataFrame([(*r, "q", "k") for r in turns], TURNS)
    m = spark.createDataFrame([(*r, None, 1) for r in said], MESSAGES)
    got = [tuple(r) for r in chats.conversations(t, m).orderBy("session", "ord").collect()]
    assert got == [("nullnames", 1, "21", "user"), ("nullnames", 2, "22", "assistant"), ("ok", 1, "1", "user"), ("ok", 2, "2", "assistant"), ("ok", 3, "3", "user"), ("ok", 4, "4", "assistant")]
    assert chats.conversations(t.limit(0), m).count() == 0
    assert chats.conversations(t, m.limit(0)).count() == 0


def test_positions_of_a_huge_channel(spark):
    """One channel over many partitions, with an outlier and ties: positions go on across their edges."""
    rows = spark.range(5000).selectExpr("'hot' as g", "case when id = 17 then 1000000000 else id * 7 % 5000 div 3 end as o", "id").repartition(5)
    got = {r.id: r.ord for r in chats.sessions(rows, "g", ["o", "id"]).collect()}
    want = sorted((10**9 if i == 17 else i * 7 % 5000 // 3, i) for i in range(5000))
    assert got == {i: n + 1 for n, (_, i) in enumerate(want)}


def test_sessions_by_pauses(spark):
    day = dt.datetime(2025, 1, 1)
    rows = []
    for s in range(6):
        for i in range(8):
            rows.append(("c", day + dt.timedelta(hours=s * 5, seconds=i * 20), f"{s}-{i}", "user" if i % 2 == 0 or s == 3 else "??" if i == 3 else "ai", 0))
    rows += [("c", None, "x", "user", 0), (None, day, "y", "user", 0), rows[3]]
    df = spark.createDataFrame(rows, "channel string, ts timestamp, id string, role string, kind int").repartition(3)
    got = chats.sessionize(df).collect()
    assert {r.session_no for r in got} == {1, 2, 3, 5, 6} and len(got) == 40
    assert all(r.role == ("user" if int(r.id[-1]) % 2 == 0 else "assistant") and r.ord == int(r.id[-1]) + 1 for r in got)
    assert chats.sessionize(df.limit(0)).count() == 0
    assert chats.sessionize(df.where("id = '0-0' or id = '0-1'")).count() == 2  # one pause: nothing to tell apart, no cut


def test_calibrated_gap_parts_short_from_long_pauses(spark):
    rng = random.Random(3)
    t, rows = dt.datetime(2025, 1, 1), []
    for i in range(400):
        t += dt.timedelta(seconds=rng.uniform(86_400, 200_000) if i % 20 == 0 else rng.uniform(5, 600))
        rows.append(("c", t, f"{i:03d}"))
    gap = chats.calibrated_gap(spark.createDataFrame(rows, "channel string, ts timestamp, id string")).first().gap_s
    assert 600 <= gap < 86_400


def test_votes_name_each_defect():
    q = "雾岸寨的灰狼是谁铭记的？"
    good = "那460座灰狼沉入雾岸寨。谁还记得它？没有人。 [E3]"
    yes = lambda d, *a: pairs.votes(*a)[d][:1] == "+"
    assert yes("empty", q, "​ \n", "completed", None, False) and not yes("empty", q, good, None, None, False)
    for answer in (q, "您问的是：" + q, q + "\n" + q, q.upper()[:-1] + "……", "“" + q + "”"):
        assert yes("echo", q, answer, "completed", "completed", False), answer
    assert not yes("echo", q, q + good, None, None, False)
    assert yes("refusal", q, "很抱歉，这个问题我不能回答，请换一个问题。", "completed", None, False)
    assert yes("refusal", "Who?", "Sorry, I can't help with that request. Please try a different question.", "completed", None, False)
    assert not yes("refusal", q, "甲对乙说“抱歉，我无法帮你”，随后离开。" + good, None, None, False)
    assert yes("wrong_language", q, "No harbor was bitter enough until Wynora opened it.", None, None, False)
    assert not yes("wrong_language", "用英语回答：" + q, "No harbor was bitter enough until Wynora opened it.", None, None, False)
    assert yes("wrong_language", "Who sealed the urn near Ostric?", "しずかなてがみとかがみが、とうだいをみつめたのです。", None, None, False)
    for answer in ("那460座灰狼沉入雾岸", "甲说：“那460座，“", "Every grim tower in Kar (", "那460座灰狼（"):
        assert yes("truncated", q, answer, "completed", "completed", False), answer
    assert not yes("truncated", q, "要点如下：\n- 灰狼\n* 海螺", "completed", None, False) and not yes("truncated", q, good, "incomplete", "incomplete", False)


def _events(turn, text, status="completed", attempt=1, kind="output_text"):
    part = [(kind, text)] if text is not None else None
    item = ("i", "message", "assistant", "final_answer", status, part)
    return [(turn, attempt, 0, "response.output_item.done", 0, item, None), (turn, attempt, 1, "response.completed", None, None, ("r", "m", status, None))]


EVENTS = "turn string, attempt int, event_no int, type string, output_index int, item struct<id string, type string, role string, phase string, status string, content array<struct<type string, text string>>>, response struct<id string, model string, status string, usage struct<input_tokens bigint>>"


def test_defects_end_to_end(spark):
    rng = random.Random(2)
    nouns = "灰狼 海螺 祭坛 风车 经文".split()
    turns, events, true = [], [], {}
    for i in range(300):
        noun = rng.choice(nouns)
        q, t = f"雾岸寨的{noun}{i}是谁铭记的？", f"t{i}"
        turns.append((t, "s", i, 0, q, "k"))
        good = f"那{i}座{noun}沉入雾岸寨，只余匠人。没有人知道{noun}去了哪里。"
        kind = rng.choice([None] * 15 + ["empty", "echo", "refusal", "wrong_language", "truncated"])
        answer = {None: good, "empty": " \n", "echo": q, "refusal": "抱歉，我无法协助处理这个请求。", "wrong_language": f"No tower was bitter enough until Wynora opened number {i}.", "truncated": good[:14]}[kind]
        events += _events(t, "旧的答案。", attempt=1) + _events(t, answer, "incomplete" if kind == "truncated" and i % 2 else "completed", attempt=2)
        if kind:
            true[t] = kind
    events += _events("lonely", None) + events[:6] + [(None, 1, 0, "x", None, None, None), ("odd", None, None, None, None, None, None)]
    true |= {"lonely": "empty", "odd": "empty"}
    t, e = spark.createDataFrame(turns, TURNS), spark.createDataFrame(events, EVENTS)
    got = {r.turn: r.defect for r in pairs.main_defect(t, e).collect()}
    assert got == true
    assert pairs.main_defect(t, e.limit(0)).count() == 0
    assert {r.defect for r in pairs.main_defect(t.limit(0), e).collect()} >= {"empty"}


def test_label_model_finds_the_rare_class():
    rng = random.Random(1)
    counts: dict[str, int] = {}
    truth = {}
    for i in range(4000):
        y = rng.random() < 0.04
        v = "".join("+" if rng.random() < (p if y else 1 - p) else "-" for p in (0.97, 0.9, 0.85))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, [0, 0])[y] += 1
    model = pairs.LabelModel(counts)
    assert abs(model.prior - 0.04) < 0.02 and model.posterior("+++") > 0.9 and model.posterior("---") < 0.01


def test_cutoffs_are_validated_on_the_sample(spark):
    """The labelled sample, judged by models fitted to its own votes: precision and recall at the validated cutoffs."""
    from scriptorium.llm.pairs_sample import sample_pairs

    polled = [(pairs.votes(q, a, s, None, False), labels) for q, a, s, labels in sample_pairs()]
    models = {}
    for d in pairs.DEFECTS:
        counts = {}
        for v, _ in polled:
            if v[d]:
                counts[v[d]] = counts.get(v[d], 0) + 1
        models[d] = pairs.LabelModel(counts)
    cutoffs = pairs.validated_cutoffs(models)
    for d in pairs.DEFECTS:
        found = {i for i, (v, _) in enumerate(polled) if v[d] and models[d].posterior(v[d]) > cutoffs[d]}
        true = {i for i, (_, labels) in enumerate(polled) if d in labels}
        assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.8 * len(found), (d, len(found), len(true), len(found & true))
    assert pairs.best_cutoff([(0.1, False), (0.4, True), (0.9, True)]) == 0.25 and pairs.best_cutoff([]) == 0.5


def test_languages():
    for text, code in (
        ("Der Turm ist nicht weit von der Stadt.", "de"), ("La tour se trouve près de la ville et elle est ancienne.", "fr"), ("La torre está en el norte y es muy antigua.", "es"),
        ("The tower stands near the town.", "en"), ("Ravska Theseth Nevorn", "latin"), ("Башня стоит у города", "ru"), ("탑은 도시 옆에 있습니다", "ko"), ("塔在城市旁边", "zh"), ("塔は町のそばにあります", "ja"), ("!?", ""),
    ):
        assert pairs.language(text) == code, text


def test_mixing_plans():
    tokens, weights, limits = {"a": 1000, "b": 100, "c": 0}, {"a": 1.0, "b": 1.0, "c": 2.0}, {"a": 2, "b": 4, "c": 9}
    total, t, shares = mixing.plan_shares(tokens, weights, limits)
    assert total == 800 and t == 1.0 and shares == {"a": 0.5, "b": 0.5}
    total, t, shares = mixing.plan_shares(tokens, weights, limits, 1600)
    assert total == 1600 and 0 < t < 1 and math.isclose(1600 * shares["b"], 400, rel_tol=1e-6) and 1600 * shares["a"] <= 2000
    total, t, shares = mixing.plan_shares(tokens, weights, limits, 10**6)  # lowered to what natural shares allow
    assert total == 2200 and 0 < t < 1 and total * shares["b"] <= 400.001 and total * shares["a"] <= 2000
    assert mixing.plan_shares({}, weights, limits) == (0, 1.0, {})
    a, p = mixing.entropy_shares({"x": 900.0, "y": 100.0}, 0.6)
    assert 0 < a < 1 and math.isclose(-sum(v * math.log(v) for v in p.values()), 0.6, abs_tol=1e-6)


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, "a" if i % 10 else "b", "字" * rng.randint(5, 60), 0) for i in range(3000)]
    docs += [(9001, None, "无", 0), (9002, "other", "别", 0), (None, "a", "缺", 0), (9003, "a", None, 0), (9004, "b", "", 0), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 3), ("none", 1.0, 3), ("off", None, None), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    sizes = mixing.token_sizes(d, len)
    out, report = mixing.mix(sizes, targets, block_rows=100)
    rows = {r.source: r for r in report.collect()}
    assert abs(rows["a"].reached_share - 0.75) < 0.005 and abs(rows["b"].reached_share - 0.25) < 0.005 and rows["none"].mixed_tokens == 0
    copies = {r.doc_id: r.copies for r in out.collect()}
    assert max(copies.values()) <= 3 and 9001 not in copies and 9002 not in copies
    assert sum(copies.values()) == mixing.in_order(out).count()
    full = {r.source: r for r in mixing.mix(sizes, targets.where("source <> 'none'").replace({"a": "b", "b": "a"}, subset=["source"]), "available", block_rows=100)[1].collect() if r.documents}
    assert 0 < full["a"].temperature < 1 and full["a"].most_copies <= 3 and full["b"].most_copies <= 2
    assert abs(sum(r.mixed_tokens for r in full.values()) - sum(r.available_tokens for r in full.values())) < 200
    even = {r.source: r for r in mixing.entropy_report(sizes, targets).collect()}
    assert set(even) == {"a", "b"} and 0 < even["a"].exponent < 1
    assert mixing.mix(sizes.limit(0), targets)[0].count() == 0 and mixing.mix(sizes, targets.limit(0))[0].count() == 0


def test_tokenizer_counts():
    count = mixing.token_counter()
    assert count("") == 0 and 1 <= count("hello world") <= 4


def _quality(model, lines):
    by = {k: [0, 0, 0] for k in personal.KINDS}
    for text, gold in lines:
        got = set(model.find(text))
        for k in personal.KINDS:
            a, b = {x for x in got if x[0] == k}, {x for x in gold if x[0] == k}
            by[k] = [by[k][0] + len(a), by[k][1] + len(b), by[k][2] + len(a & b)]
    return {k: (both / max(found, 1), both / max(true, 1)) for k, (found, true, both) in by.items()}


def test_personal_data_on_withheld_shapes():
    """Trained without the sentence shapes of odd numbers, labelled fields and signatures aside, and measured on those."""
    from scriptorium.llm.personal_sample import SHAPES, sample_lines

    known, held = ({lang: [i for i in range(n) if i % 2 == odd] for lang, n in SHAPES.items()} for odd in (0, 1))
    model = personal.train(sample_lines(4000, 5, known))
    quality = _quality(model, sample_lines(800, 78, held, plain=False))
    for kind, (precision, recall) in quality.items():
        assert precision > 0.85 and recall > (0.6 if kind == "NAME" else 0.9), quality


def test_names_without_any_hint():
    model = personal.trained()
    for text, kind, value in (
        ("My colleague Jonathan Brightwater said hello.", "NAME", "Jonathan Brightwater"), ("昨天我和张伟一起吃饭。", "NAME", "张伟"), ("Thanks to Anna Schmidt for the review.", "NAME", "Anna Schmidt"),
        ("名前は田中太郎です", "NAME", "田中太郎"), ("Call 020 7946 0958 today", "PHONE", "020 7946 0958"), ("He lives at 221B Baker Street, London.", "ADDRESS", "221B Baker Street, London"),
    ):
        assert [(k, text[s:e]) for k, s, e in model.find(text)] == [(kind, value)], text
    for text in ("订单号 266562479706139326 已归档。", "Version 3.14.159, checksum 682cd18c06798288, Item 123456789.", "斯尔克与拉萨娅悄悄离开山谷。", "After Thornvale crossed the river, Bramonia guarded the gate."):
        assert model.find(text) == [], text


def test_names_are_proposed_everywhere():
    """Names of any form, far from contact data and words that announce a name."""
    far = "海面无风。\n" * 60
    for name in ("赵璟", "欧阳墅", "闻筠衡", "Bramonia Thornvale", "佐藤翔太"):
        text = f"{far}昨夜{name} 走过石桥。\n{far}"
        assert (len(far) + 2, len(far) + 2 + len(name), "NAME") in {x[:3] for x in personal.proposals(text)}, name


def test_personal_data_in_tables(spark):
    rows = [(1, "我叫温砚衡，有疑问请打 +86 13200009418 找我。", "k"), (2, None, "k"), (3, "", "k"), (None, "找 a@b.example", "k"), (4, "订单流水 266562479706139326 已归档。", "k"), (5, "😀邮箱：Tor.Bra(at)mail.example.org。" + "海" * 50_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {tuple(r) for r in personal.personal_spans(df).collect()}
    assert got == {(1, "NAME", 2, 5), (1, "PHONE", 12, 27), (5, "EMAIL", 4, 31)}
    clean = {r.doc_id: r.clean_text for r in personal.redacted(df).collect()}
    assert clean[1] == "我叫[NAME]，有疑问请打 [PHONE] 找我。" and clean[2] is None and clean[3] == ""
    assert personal.personal_spans(df.limit(0)).count() == 0


def test_decoding_equals_enumeration():
    rng = random.Random(6)
    model = personal.Model()
    for _ in range(200):
        spans = [(s, s + rng.randint(1, 5), "X", ()) for s in (rng.randint(0, 12) for _ in range(rng.randint(0, 7)))]
        scores = [rng.uniform(-1, 3) for _ in spans]
        best = 0.0
        for mask in range(1 << len(spans)):
            chosen = sorted(spans[i][:2] for i in range(len(spans)) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(scores[i] for i in range(len(spans)) if mask >> i & 1))
        assert math.isclose(sum(scores[i] for i in model.decode(spans, scores)), best, abs_tol=1e-9)
