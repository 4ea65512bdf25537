"""Queries of projections, selectors and decision rules over units, quotes and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..session import table
from .registry import register

_UNITS = """
    r AS (SELECT * FROM canonical_records WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY built_at DESC NULLS LAST) = 1),
    rs AS (SELECT record_id, record_metadata.name AS record_name, unnest(sections) AS s, unnest(range(len(sections))) AS section_no FROM r),
    ru AS (SELECT record_id, record_name, section_no, s.source_metadata.name AS section_name, unnest(s.units) AS u, unnest(range(len(s.units))) AS unit_no FROM rs),
    units AS (SELECT record_id, record_name, CAST(section_no AS INTEGER) AS section_no, section_name, CAST(unit_no AS INTEGER) AS unit_no, u.unit_id AS unit_id, u.kind AS kind, u.parent_component_key AS component, u.value.normalized_text AS text, u.value.raw AS raw, u.value.groups AS groups
              FROM ru WHERE u IS NOT NULL)
"""


def keep_first(sql_list: str) -> str:
    """SQL of a list without repeats in the order of first occurrence."""
    return f"list_filter({sql_list}, lambda x, i: list_position({sql_list}, x) = i)"


PLACE = ["record_id", "section_no", "unit_no"]


def units(spark: SparkSession, d: str) -> DataFrame:
    """The units of the latest build of every record with their place and names; null units are left out but counted."""
    c = table(spark, d, "canonical_records").where("record_id is not null")
    r = c.groupBy("record_id").agg(F.max_by(F.struct("record_metadata", "sections"), F.coalesce(F.col("built_at"), F.lit("0001-01-01").cast("timestamp"))).alias("r"))
    s = r.select("record_id", F.col("r.record_metadata.name").alias("record_name"), F.posexplode("r.sections").alias("section_no", "s"))
    u = s.select("record_id", "record_name", "section_no", F.col("s.source_metadata.name").alias("section_name"), F.posexplode("s.units").alias("unit_no", "u")).where("u is not null")
    value = F.col("u.value")
    return u.select("record_id", "record_name", "section_no", "section_name", "unit_no", "u.unit_id", "u.kind", F.col("u.parent_component_key").alias("component"), value["normalized_text"].alias("text"), value["raw"].alias("raw"), value["groups"].alias("groups"))


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@register("view_selected_units", f"WITH {_UNITS} SELECT record_id, section_no, unit_no, kind FROM units WHERE kind IN ('rich_text', 'dialogue_graph') AND (starts_with(component, 'content:1500001') OR starts_with(component, 'content:15000')) AND section_name IS NOT NULL")
def view_selected_units(spark: SparkSession, d: str) -> DataFrame:
    """A selector: any of the kinds, any of the component prefixes, and both at once."""
    u = units(spark, d).where("section_name is not null")
    return u.where(rules.selector({"kind": ["rich_text", "dialogue_graph"], "section_name": []}, {"component": ["content:1500001", "content:15000"]})).select(*PLACE, "kind")


@register(
    "view_text_values",
    f"""WITH {_UNITS}, g AS (SELECT record_id, section_no, unit_no, unnest(groups) AS g, unnest(range(len(groups))) AS gi FROM units),
    n AS (SELECT record_id, section_no, unit_no, gi, unnest(g.nodes) AS n, unnest(range(len(g.nodes))) AS ni FROM g WHERE g IS NOT NULL)
    SELECT record_id, section_no, unit_no, '/normalized_text' AS pointer, text AS value FROM units WHERE text IS NOT NULL UNION ALL SELECT record_id, section_no, unit_no, '/raw', raw FROM units WHERE raw IS NOT NULL
    UNION ALL SELECT record_id, section_no, unit_no, '/groups/' || gi || '/nodes/' || ni || '/dialogue', n.dialogue FROM n WHERE n.dialogue IS NOT NULL""",
)
def view_text_values(spark: SparkSession, d: str) -> DataFrame:
    """The text values a unit owns, with their pointers inside the unit."""
    u = units(spark, d)
    own = u.select(*PLACE, F.explode(F.array(F.struct(F.lit("/normalized_text").alias("pointer"), F.col("text").alias("value")), F.struct(F.lit("/raw").alias("pointer"), F.col("raw").alias("value")))).alias("v"))
    g = u.select(*PLACE, F.posexplode("groups").alias("gi", "g")).select(*PLACE, "gi", F.posexplode("g.nodes").alias("ni", "n"))
    said = g.select(*PLACE, F.struct(F.format_string("/groups/%d/nodes/%d/dialogue", "gi", "ni").alias("pointer"), F.col("n.dialogue").alias("value")).alias("v"))
    return own.unionByName(said).select(*PLACE, "v.pointer", "v.value").where("value is not null")


@register(
    "rule_admission",
    rf"""WITH {_UNITS} SELECT record_id, section_no, unit_no, CASE WHEN kind IS NULL THEN 'review' WHEN kind = 'dialogue_graph' THEN 'include' WHEN kind = 'structured_observation' AND raw IS NULL THEN 'exclude' WHEN kind = 'structured_observation' THEN 'context'
    WHEN text IS NULL OR trim(text) = '' THEN 'exclude' WHEN section_name IS NULL THEN 'review' WHEN regexp_matches(text, '^\s*#') THEN 'context' ELSE 'include' END AS decision,
    CASE WHEN kind IS NULL THEN 'kind unknown' WHEN kind = 'dialogue_graph' THEN 'dialogue' WHEN kind = 'structured_observation' AND raw IS NULL THEN 'no payload' WHEN kind = 'structured_observation' THEN 'structured payload'
    WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN section_name IS NULL THEN 'section unknown' WHEN regexp_matches(text, '^\s*#') THEN 'heading' ELSE 'conservative text' END AS reason FROM units""",
)
def rule_admission(spark: SparkSession, d: str) -> DataFrame:
    """Ordered admission rules of units: the first that holds decides; unknown text stays in."""
    k = F.col("kind")
    structured = k == "structured_observation"
    decided = rules.first_match(
        [
            (k.isNull(), "review", "kind unknown"), (k == "dialogue_graph", "include", "dialogue"), (structured & F.col("raw").isNull(), "exclude", "no payload"), (structured, "context", "structured payload"),
            (F.col("text").isNull() | (F.trim("text") == ""), "exclude", "empty"), (F.col("section_name").isNull(), "review", "section unknown"), (F.col("text").rlike(r"^\s*#"), "context", "heading"),
        ],
        "include", "conservative text",
    )
    return units(spark, d).select(*PLACE, decided.alias("x")).select(*PLACE, "x.*")


_LEAF = r"""CASE WHEN {t} IS NULL OR trim({t}) = '' THEN 'null' WHEN regexp_matches({t}, '^[\s\-—_.…/]+$') THEN 'placeholder' WHEN regexp_matches({t}, '^[\s\d.,:%/+-]+$') THEN 'numeric' WHEN {t} = {l} THEN 'repeated label'
    WHEN regexp_matches({t}, '^\s*(?:https?://|//)\S+\s*$') THEN 'address' WHEN regexp_matches({t}, '^\s*(?:编者按|注|编辑|更新)[：:]') THEN 'editorial' ELSE 'keep' END"""


@register("rule_leaf_lines", f"WITH l AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS line_no, {_LEAF.format(t='line', l='title')} AS leaf FROM l")
def rule_leaf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Overrides at the level of leaves (here lines): placeholders, numbers only, repeated labels, addresses, editorial lines."""
    line = F.col("line")
    decided = rules.first_match(
        [
            (line.isNull() | (F.trim(line) == ""), "null", ""), (line.rlike(r"^[\s\-—_.…/]+$"), "placeholder", ""), (line.rlike(r"^[\s\d.,:%/+-]+$"), "numeric", ""), (line == F.col("title"), "repeated label", ""),
            (line.rlike(r"^\s*(?:https?://|//)\S+\s*$"), "address", ""), (line.rlike(r"^\s*(?:编者按|注|编辑|更新)[：:]"), "editorial", ""),
        ],
        "keep", "",
    )
    rows = table(spark, d, "documents").select("doc_id", "title", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", decided["decision"].alias("leaf"))


_TEMPLATES = (r"谁还记得[^，。\n]{1,40}？", r"[^，。\n]{1,40}(?:吗|呢)？", r"(?:Who|What|Where|Why|When|Explain|How)[^\n]{1,200}[?.]", r"[^，。\n]{1,40}(?:为什么|是谁|在哪)[^。\n]{0,40}？")


@register("rule_templates", r"SELECT DISTINCT id, len(s) > 0 AND len(list_filter(s, lambda x: NOT regexp_full_match(x, '" + "|".join(f"(?:{t})" for t in _TEMPLATES) + r"'))) = 0 AS templated FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(question, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM turns WHERE question IS NOT NULL)")
def rule_templates(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose every line is one of a finite set of templates as a whole."""
    t = table(spark, d, "turns").where("question is not null")
    return t.select("id", rules.all_parts_match(F.split("question", "\n+", -1), list(_TEMPLATES)).alias("templated")).distinct()


_QUANTITY = r"^(?:\s*[^\d*×\n。！？；：:]{1,40}\s*[*×]\s*\d+(?:\.\d+)?\s*)+$"
_PARTS = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' × ' WHEN 1 THEN '*' WHEN 2 THEN ': ' ELSE ' *' END, p_size, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_brand, '×') ELSE '' END)"


@register("rule_quantities", f"SELECT p_partkey, regexp_matches(replace(replace({_PARTS}, '#', ' '), '-', ' '), '{_QUANTITY}') AS complete FROM part")
def rule_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Which lists of parts with numbers are complete lists of quantities, by a machine that follows all readings at once."""
    p = table(spark, d, "part")
    text = F.expr(_PARTS)
    return p.select("p_partkey", rules.is_quantity_list(F.translate(text, "#-", "  ")).alias("complete"))


@register("rule_table_kind", "WITH h AS (SELECT n_regionkey, list_sort(list(DISTINCT substr(n_name, 1, 1))) AS labels FROM nation GROUP BY n_regionkey) SELECT n_regionkey, CASE WHEN len(list_filter(labels, lambda x: NOT list_contains(['A', 'E', 'I', 'J', 'C', 'V'], x))) = 0 THEN 'mechanical' WHEN list_has_any(labels, ['F', 'G', 'R']) THEN 'mixed' ELSE 'content' END AS kind FROM h")
def rule_table_kind(spark: SparkSession, d: str) -> DataFrame:
    """Tables judged by their header labels: all of a set of labels, some of another, or neither."""
    h = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_set(F.substring("n_name", 1, 1)).alias("labels"))
    lit = lambda xs: F.array(*map(F.lit, xs))
    kind = F.when(F.size(F.array_except("labels", lit("AEIJCV"))) == 0, "mechanical").when(F.arrays_overlap("labels", lit("FGR")), "mixed").otherwise("content")
    return h.select("n_regionkey", kind.alias("kind"))


@register(
    "view_section_fields",
    f"""WITH {_UNITS} SELECT record_id, section_no, any_value(record_name) AS title, coalesce(array_to_string({keep_first("list(section_name ORDER BY unit_no) FILTER (WHERE section_name IS NOT NULL)")}, ' / '), '') AS headings,
    coalesce(array_to_string({keep_first("list(kind ORDER BY unit_no) FILTER (WHERE kind IS NOT NULL)")}, ' / '), '') AS field_labels, coalesce(array_to_string(list(text ORDER BY unit_no) FILTER (WHERE text IS NOT NULL), chr(10)), '') AS body,
    coalesce(array_to_string({keep_first("list(component ORDER BY unit_no) FILTER (WHERE component IS NOT NULL)")}, ' '), '') AS context FROM units GROUP BY record_id, section_no""",
)
def view_section_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a section: title, headings, labels, body and context, each without repeats and in order."""
    ordered = F.array_sort(F.collect_list(F.struct("unit_no", "section_name", "kind", "text", "component")))
    g = units(spark, d).groupBy("record_id", "section_no").agg(F.first("record_name").alias("title"), ordered.alias("x"))
    unique = lambda c: F.array_distinct(F.array_compact(F.col(f"x.{c}")))
    return g.select("record_id", "section_no", "title", F.array_join(unique("section_name"), " / ").alias("headings"), F.array_join(unique("kind"), " / ").alias("field_labels"), F.array_join(F.array_compact(F.col("x.text")), "\n").alias("body"), F.array_join(unique("component"), " ").alias("context"))


@register("view_unit_fields", f"WITH {_UNITS} SELECT record_id, section_no, unit_no, {strip_sql("coalesce(record_name, '')")} AS title, {strip_sql("coalesce(section_name, '')")} AS section, {strip_sql("coalesce(groups[1].nodes[1].option, '')")} AS speaker, {strip_sql("coalesce(text, raw, groups[1].nodes[1].dialogue, '')")} AS text FROM units")
def view_unit_fields(spark: SparkSession, d: str) -> DataFrame:
    """Title, section, speaker and visible text of a unit, stripped."""
    first = F.try_element_at(F.try_element_at(F.col("groups"), F.lit(1))["nodes"], F.lit(1))
    text = lambda *cs: stripped(F.coalesce(*cs, F.lit("")))
    return units(spark, d).select(*PLACE, text(F.col("record_name")).alias("title"), text(F.col("section_name")).alias("section"), text(first["option"]).alias("speaker"), text(F.col("text"), F.col("raw"), first["dialogue"]).alias("text"))


_ARMS = f"""WITH {_UNITS}, g AS (SELECT record_id, section_no, unit_no, unnest(groups) AS g, unnest(range(len(groups))) AS gi FROM units),
    n AS (SELECT record_id, section_no, unit_no, gi, unnest(g.nodes) AS n FROM g WHERE g IS NOT NULL), e AS (SELECT record_id, section_no, unit_no, gi, unnest(g.edges) AS e FROM g WHERE g IS NOT NULL),
    lone AS (SELECT n.* FROM n WHERE n.n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE (e.record_id, e.section_no, e.unit_no, e.gi) = (n.record_id, n.section_no, n.unit_no, n.gi) AND (e.e.parent_id = n.n.source_id OR e.e.child_id = n.n.source_id))),
    a AS (SELECT 'naked' AS arm, record_id, section_no, unit_no, text AS body FROM units WHERE text <> '' UNION ALL SELECT 'contextualised', record_id, section_no, unit_no, concat_ws(chr(10), record_name, section_name, text) FROM units WHERE text <> ''
    UNION ALL SELECT 'structured', record_id, section_no, unit_no, '/raw' || chr(9) || raw FROM units WHERE raw <> '' UNION ALL SELECT 'dialogue', record_id, section_no, unit_no, coalesce(n.dialogue, '') FROM lone)"""


@register("view_arms", f"{_ARMS} SELECT arm, record_id, section_no, unit_no, body FROM a")
def view_arms(spark: SparkSession, d: str) -> DataFrame:
    """Representations of units by arm: the text alone, with its titles, structured as path and value, and isolated dialogue nodes (edges are ``g6_edge_documents``)."""
    u = units(spark, d)
    arm = lambda name, rows, body: rows.select(F.lit(name).alias("arm"), *PLACE, body.alias("body"))
    texts, raws = u.where("text <> ''"), u.where("raw <> ''")
    g = u.select(*PLACE, F.explode("groups").alias("g"))
    ends = F.flatten(F.array(F.coalesce("g.edges.parent_id", F.array()), F.coalesce("g.edges.child_id", F.array())))
    lone = g.select(*PLACE, ends.alias("ends"), F.explode("g.nodes").alias("n")).where(F.col("n").isNotNull() & ~F.coalesce(F.array_contains("ends", F.col("n.source_id")), F.lit(False)))
    return arm("naked", texts, F.col("text")).unionByName(arm("contextualised", texts, F.concat_ws("\n", "record_name", "section_name", "text"))).unionByName(arm("structured", raws, F.concat(F.lit("/raw\t"), F.col("raw")))).unionByName(arm("dialogue", lone, F.coalesce("n.dialogue", F.lit(""))))


@register("view_covering_units", "WITH q AS (SELECT DISTINCT evidence_id, unit_id, kind, section FROM (SELECT unnest(quotes, recursive := true) FROM card_semantic_cases)), u AS (SELECT DISTINCT unit_id, source.canonical_address.canonical_unit_kind AS kind, source.canonical_address.section_ordinal AS section FROM p05_story_rus) SELECT DISTINCT q.evidence_id, u.unit_id FROM q JOIN u ON q.unit_id = u.unit_id AND (q.kind IS NULL OR q.kind = u.kind) AND (q.section IS NULL OR q.section = u.section)")
def view_covering_units(spark: SparkSession, d: str) -> DataFrame:
    """Units that cover the location of a quote: the record's key equal, kind and section equal where the location names them; text is never looked at."""
    q = table(spark, d, "card_semantic_cases").select(F.explode("quotes").alias("q")).select("q.evidence_id", "q.unit_id", F.col("q.kind").alias("k"), F.col("q.section").alias("s")).distinct()
    a = F.col("source.canonical_address")
    u = table(spark, d, "p05_story_rus").select("unit_id", a["canonical_unit_kind"].alias("kind"), a["section_ordinal"].alias("section")).distinct()
    named = lambda wanted, has: wanted.isNull() | (wanted == has)
    return q.join(u, "unit_id").where(named(F.col("k"), F.col("kind")) & named(F.col("s"), F.col("section"))).select("evidence_id", "unit_id").distinct()


@register("rule_source_category", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), 'forum|post|letter') OR regexp_matches(coalesce(title, ''), '攻略|解析') THEN 'secondary' WHEN source IN ('voice_lines', 'quest_transcript') THEN 'observer' WHEN source IN ('wiki_page', 'notice') THEN 'catalog' ELSE 'unknown' END AS category FROM documents")
def rule_source_category(spark: SparkSession, d: str) -> DataFrame:
    """Documents screened by patterns of source and title."""
    s, t = F.coalesce("source", F.lit("")), F.coalesce("title", F.lit(""))
    word = rules.first_match([(s.rlike("forum|post|letter") | t.rlike("攻略|解析"), "secondary", ""), (s.isin("voice_lines", "quest_transcript"), "observer", ""), (s.isin("wiki_page", "notice"), "catalog", "")], "unknown", "")
    return table(spark, d, "documents").select("doc_id", word["decision"].alias("category"))


@register("rule_evidence_policy", "SELECT DISTINCT unit_id, CASE WHEN kind = 'dialogue_graph' THEN 'dialogue' WHEN kind = 'structured_observation' AND regexp_matches(t, '[0-9]{2}') THEN 'mechanics' WHEN scope = 'direct_raw' AND kind = 'rich_text' THEN 'story' WHEN kind = 'rich_text' THEN 'readable' WHEN p LIKE '/%' THEN 'selector path' ELSE 'unknown' END AS policy FROM (SELECT unit_id, source.canonical_address.canonical_unit_kind AS kind, retrieval_visible_text AS t, source.lineage.evidence_scope AS scope, source.canonical_address.parsed_json_pointer AS p FROM p05_story_rus)")
def rule_evidence_policy(spark: SparkSession, d: str) -> DataFrame:
    """What a unit may be used as evidence for, from its kind, scope and path."""
    a, scope = F.col("source.canonical_address"), F.col("source.lineage.evidence_scope")
    kind = a["canonical_unit_kind"]
    rows = [(kind == "dialogue_graph", "dialogue", ""), ((kind == "structured_observation") & F.col("retrieval_visible_text").rlike("[0-9]{2}"), "mechanics", ""), ((scope == "direct_raw") & (kind == "rich_text"), "story", ""), (kind == "rich_text", "readable", ""), (a["parsed_json_pointer"].like("/%"), "selector path", "")]
    return table(spark, d, "p05_story_rus").select("unit_id", rules.first_match(rows, "unknown", "")["decision"].alias("policy")).distinct()


@register("rule_grade", "WITH m AS (SELECT DISTINCT id, turn, role, body FROM chat_messages), g AS (SELECT turn, count(*) AS n, count(CASE WHEN trim(body) <> '' THEN 1 END) AS full_n, count(DISTINCT lower(trim(role))) AS roles FROM m GROUP BY turn) SELECT turn, CASE WHEN turn IS NULL THEN 'U' WHEN full_n = 0 THEN 'D' WHEN full_n < n THEN 'C' WHEN roles = 2 AND n = 2 THEN 'A' ELSE 'B' END AS grade FROM g")
def rule_grade(spark: SparkSession, d: str) -> DataFrame:
    """A conservative grade of turns by what is missing first."""
    g = table(spark, d, "chat_messages").select("id", "turn", "role", "body").distinct().groupBy("turn").agg(F.count("*").alias("n"), F.count_if(F.trim("body") != "").alias("full_n"), F.countDistinct(F.lower(F.trim("role"))).alias("roles"))
    return g.select("turn", rules.first_match([(F.col("turn").isNull(), "U", ""), (F.col("full_n") == 0, "D", ""), (F.col("full_n") < F.col("n"), "C", ""), ((F.col("roles") == 2) & (F.col("n") == 2), "A", "")], "B", "")["decision"].alias("grade"))


@register("x5_body_policy", "SELECT DISTINCT unit_id, CASE WHEN kind IS NULL THEN 'kind' WHEN t IS NULL OR trim(t) = '' THEN 'empty' WHEN section IS NULL THEN 'section' WHEN regexp_matches(t, '^\\s*[#*-]') THEN 'layout' WHEN length(t) < 55 THEN 'short' ELSE 'body' END AS reason FROM (SELECT unit_id, source.canonical_address.canonical_unit_kind AS kind, retrieval_visible_text AS t, source.canonical_address.section_ordinal AS section FROM p05_story_rus)")
def x5_body_policy(spark: SparkSession, d: str) -> DataFrame:
    """Ordered reasons to leave a unit out of the research body."""
    a, t = F.col("source.canonical_address"), F.col("retrieval_visible_text")
    rows = [(a["canonical_unit_kind"].isNull(), "kind", ""), (t.isNull() | (F.trim(t) == ""), "empty", ""), (a["section_ordinal"].isNull(), "section", ""), (t.rlike(r"^\s*[#*-]"), "layout", ""), (F.length(t) < 55, "short", "")]
    return table(spark, d, "p05_story_rus").select("unit_id", rules.first_match(rows, "body", "")["decision"].alias("reason")).distinct()


@register("x18_reuse_decision", "WITH e AS (SELECT DISTINCT ON (turn, attempt, event_no) * FROM p05_responses_multimessage), a AS (SELECT turn, attempt, count(response.id) AS raw, count(CASE WHEN response.status = 'completed' THEN 1 END) AS done, count(CASE WHEN type = 'response.output_item.done' THEN 1 END) AS items FROM e GROUP BY turn, attempt) SELECT turn, attempt, CASE WHEN raw = 0 AND items = 0 THEN 'call' WHEN done = 0 AND items > 0 THEN 'reparse' WHEN done > 0 AND items = 0 THEN 'call' WHEN done > 1 THEN 'review' ELSE 'reuse' END AS decision, CASE WHEN raw = 0 AND items = 0 THEN 'nothing stored' WHEN done = 0 AND items > 0 THEN 'not closed' WHEN done > 0 AND items = 0 THEN 'no items' WHEN done > 1 THEN 'closed twice' ELSE 'whole' END AS reason FROM a")
def x18_reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether what is stored of an attempt is reused, parsed again, or called for again."""
    e = table(spark, d, "p05_responses_multimessage").dropDuplicates(["turn", "attempt", "event_no"])
    a = e.groupBy("turn", "attempt").agg(F.count("response.id").alias("raw"), F.count_if(F.col("response.status") == "completed").alias("done"), F.count_if(F.col("type") == "response.output_item.done").alias("items"))
    rows = [(F.expr("raw = 0 and items = 0"), "call", "nothing stored"), (F.expr("done = 0 and items > 0"), "reparse", "not closed"), (F.expr("done > 0 and items = 0"), "call", "no items"), (F.expr("done > 1"), "review", "closed twice")]
    return a.select("turn", "attempt", rules.first_match(rows, "reuse", "whole").alias("x")).select("turn", "attempt", "x.*")


_SHOWN = "list_filter([CASE WHEN trim(title) <> '' THEN trim(title) END, CASE WHEN trim(source) <> '' THEN trim(source) END, CASE WHEN trim(title) <> '' THEN trim(title) END, CASE WHEN trim(lang) <> '' THEN trim(lang) END], lambda y: y IS NOT NULL)"


@register("x21_display_context", f"SELECT doc_id, array_to_string({keep_first('l')}, ' / ') AS label FROM (SELECT doc_id, {_SHOWN} AS l FROM documents)")
def x21_display_context(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels of a document in order, empty ones left out."""
    shown = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.array_compact(F.array(*map(shown, ("title", "source", "title", "lang"))))), " / ").alias("label"))
