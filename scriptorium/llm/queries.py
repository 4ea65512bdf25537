"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def units(spark: SparkSession, d: str) -> DataFrame:
    """Story units as (unit_id, record_id, text)."""
    return table(spark, d, "p05_story_rus").select(
        "unit_id", F.col("source.canonical_address.record_id").alias("record_id"), F.col("retrieval_visible_text").alias("text")
    )


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Card quotes as (evidence_id, text)."""
    return table(spark, d, "card_semantic_cases").select(F.explode("quotes").alias("q")).select("q.evidence_id", "q.text")


# ---- SQL of queries that other engines can answer by brute force ----------------------------------

_PASSAGES = """
    ps AS (SELECT DISTINCT 'unit' AS origin, unit_id AS k, retrieval_visible_text AS t FROM p05_story_rus WHERE unit_id IS NOT NULL AND retrieval_visible_text IS NOT NULL
          UNION SELECT DISTINCT 'quote', q.evidence_id, q.text FROM (SELECT unnest(quotes) AS q FROM card_semantic_cases) WHERE q.evidence_id IS NOT NULL AND q.text IS NOT NULL)
"""
_SHARED = f"""
    WITH {_PASSAGES}, wi AS (SELECT origin, k, i, substr(t, i + 1, 40) AS w FROM (SELECT origin, k, t, unnest(range(length(t) - 39)) AS i FROM ps WHERE length(t) >= 40)),
    sh AS (SELECT origin, w FROM wi GROUP BY origin, w HAVING count(DISTINCT k) > 1), hi AS (SELECT DISTINCT origin, k, i FROM wi JOIN sh USING (origin, w)),
    nw AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY origin, k ORDER BY i) <= 40 THEN 0 ELSE 1 END AS n FROM hi), ru AS (SELECT *, sum(n) OVER (PARTITION BY origin, k ORDER BY i) AS run FROM nw),
    sp AS (SELECT origin, k AS item_key, min(i) AS span_start, max(i) + 40 AS span_end FROM ru GROUP BY origin, k, run)
"""
_SETS = """
    un AS (SELECT DISTINCT unit_id, source.canonical_address.record_id AS record_id, retrieval_visible_text AS t FROM p05_story_rus WHERE unit_id IS NOT NULL AND retrieval_visible_text IS NOT NULL AND length(retrieval_visible_text) >= 30),
    dt AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT t FROM un)), gr AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM dt), sz AS (SELECT id, count(*) AS n FROM gr GROUP BY id),
    co AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM gr x JOIN gr y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
    nr AS (SELECT a, b FROM co JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c))
"""


def _form_sql(c: str) -> str:
    """The one form of a text as SQL can say it: a table of single letters, invisible ones dropped, composition by the engine."""
    import unicodedata

    from .looks import tables

    edges, flat = tables()
    one, gone = {"\t": " "}, []
    for cp in (*range(0x80, 0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x30000), *range(0xE0000, 0xE0200)):
        form = unicodedata.normalize("NFC", "".join(map(chr, flat[edges[cp] : edges[cp + 1]])))
        if not form:
            gone.append(chr(cp))
        elif len(form) == 1 and form != chr(cp):
            one[chr(cp)] = form
    quote = lambda s: s.replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({c}), '{quote(''.join(one) + ''.join(gone))}', '{quote(''.join(one.values()))}'))"


_KEPT = r"regexp_replace(lower(translate(nfc_normalize({c}), '{a}', '{b}')), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _kept_sql(c: str) -> str:
    """Letters and digits of a text in one case and width, as SQL can say it."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return _KEPT.format(c=c, a=wide.replace("'", "''"), b="".join(chr(ord(x) - 0xFEE0) for x in wide).replace("'", "''"))


@_register("p6_found", f"WITH {_SETS}, me AS (SELECT id, unit_id, record_id FROM un JOIN dt USING (t) WHERE record_id IS NOT NULL), pa AS (SELECT x.unit_id AS u, y.unit_id AS v FROM (SELECT a, b FROM nr UNION ALL SELECT id, id FROM dt) JOIN me x ON x.id = a JOIN me y ON y.id = b WHERE x.record_id <> y.record_id) SELECT DISTINCT least(u, v) AS unit_a, greatest(u, v) AS unit_b FROM pa WHERE u <> v")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .neardup import near_duplicate_units

    return near_duplicate_units(units(spark, d))


@_register("p6_classes", f"WITH {_SETS}, al AS (SELECT DISTINCT unit_id, retrieval_visible_text AS t FROM p05_story_rus WHERE unit_id IS NOT NULL AND retrieval_visible_text IS NOT NULL), li AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM nr UNION ALL SELECT b FROM nr) GROUP BY id) SELECT al.unit_id, min(al.unit_id) OVER (PARTITION BY al.t) AS class_id, coalesce(li.n, 0) AS links FROM al LEFT JOIN dt ON dt.t = al.t LEFT JOIN li ON li.id = dt.id")
def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    from .neardup import near_duplicate_classes

    return near_duplicate_classes(units(spark, d))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """Units and quotes as (origin, item_key, text)."""
    return units(spark, d).select(F.lit("unit").alias("origin"), F.col("unit_id").alias("item_key"), "text").unionByName(
        quotes(spark, d).select(F.lit("quote").alias("origin"), F.col("evidence_id").alias("item_key"), "text")
    )


@_register("p3_found", _SHARED + "SELECT origin, item_key, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end FROM sp")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .spans import shared_spans

    return shared_spans(_passages(spark, d))


@_register("p3_amount", _SHARED + "SELECT p.origin, p.k AS item_key, CAST(max(length(p.t)) AS INTEGER) AS n_chars, CAST(coalesce(any_value(s.c), 0) AS BIGINT) AS shared_chars, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS spans FROM ps p LEFT JOIN (SELECT origin, item_key, sum(span_end - span_start) AS c, count(*) AS n FROM sp GROUP BY ALL) s ON s.origin = p.origin AND s.item_key = p.k GROUP BY p.origin, p.k")
def p3_amount(spark: SparkSession, d: str) -> DataFrame:
    from .spans import shared_amount

    return shared_amount(_passages(spark, d))


@_register(
    "p3_lines",
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL),
    e AS (SELECT doc_id, parts, unnest(range(len(parts))) AS line_no FROM l),
    x AS (SELECT doc_id, line_no, parts[line_no + 1] AS line,
                 coalesce(list_sum(list_transform(parts[1:line_no], lambda p: length(p) + 1)), 0) AS span_start FROM e),
    t AS (SELECT doc_id, line_no, span_start, span_start + length(line) AS span_end, trim(line, ' ') AS unit FROM x WHERE length(trim(line, ' ')) >= 12),
    f AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY unit ORDER BY doc_id, line_no))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, first_doc_id FROM f WHERE n > 1
    """,
)
def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    from .spans import repeated_lines

    return repeated_lines(table(spark, d, "documents").select("doc_id", "text"))


@_register("p5_found", f"WITH {_PASSAGES}, fo AS (SELECT origin, k, t, {_form_sql('t')} AS f FROM ps) SELECT DISTINCT least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b FROM fo a JOIN fo b ON a.origin = b.origin AND a.f = b.f AND a.t < b.t AND a.k <> b.k")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .looks import same_look_pairs

    return same_look_pairs(_passages(spark, d)).select("key_a", "key_b")


@_register("p5_forms", f"SELECT DISTINCT origin, item_key, {_form_sql('t')} AS one_form FROM (SELECT 'unit' AS origin, unit_id AS item_key, retrieval_visible_text AS t FROM p05_story_rus UNION ALL SELECT 'quote', q.evidence_id, q.text FROM (SELECT unnest(quotes) AS q FROM card_semantic_cases))")
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    from .looks import to_one_form

    return to_one_form(_passages(spark, d)).select("origin", "item_key", "one_form").distinct()


@_register("p7_found", f"WITH dc AS (SELECT doc_id, {_kept_sql('text')} AS t FROM documents WHERE doc_id IS NOT NULL), it AS (SELECT item_id, {_kept_sql('text')} AS t FROM eval_items WHERE item_id IS NOT NULL), wi AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 38), lambda i: substr(t, i, 40))) AS w FROM it WHERE length(t) >= 40), wd AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 38), lambda i: substr(t, i, 40))) AS w FROM dc WHERE length(t) >= 40) SELECT DISTINCT doc_id, item_id FROM wd JOIN wi USING (w)")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .leaks import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@_register("p7_coverage")
def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tiles, covered characters and coverage of each leaked item in each document."""
    from .leaks import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@_register("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from .personal import personal_spans

    return personal_spans(table(spark, d, "documents"))


@_register("p9_redacted")
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    from .personal import redacted

    return redacted(table(spark, d, "documents"))


_VISIBLE_RE2 = r"[^\s\pZ\p{Cc}\p{Cf}\x{34f}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{2800}\x{fe00}-\x{fe0f}]"


@_register(
    "p1_found",
    rf"""
    WITH t AS (SELECT id, any_value(session) AS session, any_value(sequence) AS sequence, any_value(cancelled) AS cancelled FROM turns WHERE id IS NOT NULL GROUP BY id),
    m AS (SELECT id, any_value(session) AS named, any_value(turn) AS turn, any_value(role) AS role, any_value(body) AS body FROM chat_messages WHERE id IS NOT NULL GROUP BY id),
    r AS (SELECT id, named, turn, coalesce(regexp_matches(body, '{_VISIBLE_RE2}'), false) AS shown,
        CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'prompter') THEN 'user'
             WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot', 'gpt', 'chatbot') THEN 'assistant' END AS kind FROM m),
    live AS (SELECT * FROM t WHERE coalesce(cancelled, 0) = 0 AND session IS NOT NULL),
    judged AS (SELECT l.session, l.id, l.sequence,
        count(CASE WHEN kind = 'user' THEN 1 END) = 1 AND count(CASE WHEN kind = 'assistant' THEN 1 END) = 1
        AND count(CASE WHEN kind = 'user' AND shown THEN 1 END) = 1 AND count(CASE WHEN kind = 'assistant' AND shown THEN 1 END) = 1
        AND count(CASE WHEN r.id IS NOT NULL AND kind IS NULL THEN 1 END) = 0
        AND count(CASE WHEN named <> l.session THEN 1 END) = 0 AS good
        FROM live l LEFT JOIN r ON r.turn = l.id GROUP BY l.session, l.id, l.sequence),
    kept AS (SELECT session FROM judged GROUP BY session HAVING bool_and(good)
        EXCEPT SELECT named FROM r WHERE named IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.id = r.turn))
    SELECT l.session, CAST(row_number() OVER (PARTITION BY l.session ORDER BY l.sequence, CASE WHEN kind = 'user' THEN 0 ELSE 1 END) AS INTEGER) AS ord, r.id AS message_id
    FROM live l JOIN r ON r.turn = l.id WHERE l.session IN (SELECT session FROM kept)
    """,
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .chats import conversations

    return conversations(table(spark, d, "turns"), table(spark, d, "chat_messages")).select("session", "ord", "message_id")


_SAID = """
    m AS (SELECT session AS channel, id, min({'t': created_at, 'r': role}) AS x FROM chat_messages WHERE session IS NOT NULL AND created_at IS NOT NULL AND id IS NOT NULL GROUP BY session, id),
    k AS (SELECT channel, id, x.t AS ts, CASE WHEN lower(trim(x.r)) IN ('user', 'human', 'customer', 'prompter') THEN 'user' WHEN lower(trim(x.r)) IN ('assistant', 'ai', 'model', 'bot', 'gpt', 'chatbot') THEN 'assistant' END AS kind FROM m),
    p AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS pause FROM k WINDOW w AS (PARTITION BY channel ORDER BY ts, id)),
    h AS (SELECT CAST(floor(round(4 * log2(1 + greatest(pause, 0.0)), 9)) AS BIGINT) AS b, count(*) AS n FROM p WHERE pause IS NOT NULL GROUP BY 1),
    c AS (SELECT b, sum(n) OVER (ORDER BY b) AS w0, sum(n * b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS w, sum(n * b) OVER () AS s FROM h),
    v AS (SELECT b, round(w0::DOUBLE * (w - w0)::DOUBLE * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 6) AS v FROM c WHERE w0 < w),
    g AS (SELECT pow(2.0, (arg_max(b, {'v': v, 'b': -b}) + 1) / 4.0) - 1 AS gap_s FROM v),
    n AS (SELECT p.*, sum(CASE WHEN pause IS NULL OR pause > gap_s THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts, id) AS session_no FROM p, g),
    z AS (SELECT channel, CAST(session_no AS INTEGER) AS session_no, CAST(row_number() OVER w AS INTEGER) AS ord, id, kind, lag(kind) OVER w AS a, lead(kind) OVER w AS b FROM n WINDOW w AS (PARTITION BY channel, session_no ORDER BY ts, id)),
    y AS (SELECT channel, session_no, ord, id, coalesce(kind, CASE WHEN a <> b THEN NULL WHEN coalesce(a, b) = 'user' THEN 'assistant' WHEN coalesce(a, b) = 'assistant' THEN 'user' END) AS role FROM z)
"""


@_register("p1_sessionized", f"WITH {_SAID} SELECT * FROM y QUALIFY bool_or(role = 'user') OVER (PARTITION BY channel, session_no) AND bool_or(role = 'assistant') OVER (PARTITION BY channel, session_no)")
def p1_sessionized(spark: SparkSession, d: str) -> DataFrame:
    """Sessions cut at calibrated pauses, where no turn table tells them."""
    from .chats import sessionize

    m = table(spark, d, "chat_messages")
    return sessionize(m.select(F.col("session").alias("channel"), F.col("created_at").alias("ts"), "id", "role"))


@_register("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .pairs import main_defect

    return main_defect(table(spark, d, "turns"), table(spark, d, "p05_responses_multimessage"))


@_register("p2_labels")
def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every label of a pair with its posterior."""
    from .pairs import defects

    return defects(table(spark, d, "turns"), table(spark, d, "p05_responses_multimessage")).select("turn", "defect", F.round("posterior", 6).alias("posterior"))


@_register("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import mixed_documents

    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@_register("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    from .mixing import mixed_documents

    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@_register("p8_full_mix")
def p8_full_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as all targeted sources together: the exponent is bisected to the repetition limits."""
    from .mixing import mixed_documents

    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), "available")[0]


@_register("p8_full_shares")
def p8_full_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source of p8_full_mix, with the exponent reached."""
    from .mixing import mixed_documents

    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), "available")[1]


@_register("p8_entropy_shares")
def p8_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all sources by an exponent bisected to the entropy of the target weights."""
    from .mixing import entropy_report, token_sizes

    return entropy_report(token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))
