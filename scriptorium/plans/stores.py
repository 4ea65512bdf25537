"""Queries of scans, stores, pointers, renderings and small planners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import assembly, fusion, markup
from ..sources import sealed
from ..session import table
from .registry import register
from .corpus import greedy_sql
from .links import _QUOTES, quotes
from .search import _TWO, two_lists
from .views import _UNITS, units

_BODIES = "bo AS (SELECT DISTINCT content_key, body FROM obc_detail WHERE content_key IS NOT NULL AND json_valid(body)), tr AS (SELECT bo.content_key, bo.body, j.* FROM bo, json_tree(bo.body) j)"
#: DuckDB's paths as JSON pointers; the keys of these tables need no escapes.
_POINTER = r"regexp_replace(regexp_replace(substr(fullkey, 2), '\[(\d+)\]', '/\1', 'g'), '\.\"?([^.\[\"]*)\"?', '/\1', 'g')"


def bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "obc_detail").where("content_key is not null and body is not null").select("content_key", "body").distinct()


@register("s8_json_leaves", f"WITH {_BODIES} SELECT content_key, {_POINTER} AS pointer, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type, CASE WHEN type IN ('NULL', 'OBJECT', 'ARRAY') THEN NULL WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') ELSE CAST(atom AS VARCHAR) END AS lexeme FROM tr WHERE atom IS NOT NULL OR type = 'NULL' OR (type = 'OBJECT' AND len(json_keys(value)) = 0) OR (type = 'ARRAY' AND json_array_length(value) = 0)")
def s8_json_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the bodies that are JSON, empty containers among them."""
    return sealed.json_leaves(bodies(spark, d), "content_key", "body").where("problem is null").drop("problem")


@register("s8_pointer_get", "SELECT DISTINCT content_key, json_extract_string(body, '/data/page/name') AS name, json_extract_string(body, '/data/page/modules/0/id') AS first_module, json_extract_string(body, '/data/page/modules/0/components/0/component_id') AS first_component FROM obc_detail WHERE content_key IS NOT NULL AND json_valid(body)")
def s8_pointer_get(spark: SparkSession, d: str) -> DataFrame:
    """Values at JSON pointers, null where the pointer leads nowhere."""
    get = sealed.pointers(["/data/page/name", "/data/page/modules/0/id", "/data/page/modules/0/components/0/component_id"])
    return markup.per_value(bodies(spark, d), "content_key", "body", get, "name string, first_module string, first_component string").distinct()


@register("s9_scalar_paths", rf"WITH {_BODIES}, s AS (SELECT content_key, {_POINTER} AS pointer, CASE WHEN type = 'VARCHAR' THEN trim(json_extract_string(atom, '$'), ' ' || chr(10) || chr(9) || chr(13)) ELSE CAST(atom AS VARCHAR) END AS value FROM tr WHERE atom IS NOT NULL AND type <> 'NULL' AND starts_with({_POINTER}, '/data/page/template_layout')) SELECT content_key, pointer, value FROM s WHERE value <> ''")
def s9_scalar_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pointers and stripped scalars of the layouts, keys sorted; empty strings and nulls are left out."""
    return sealed.scalar_paths(bodies(spark, d), "content_key", "body").where("startswith(pointer, '/data/page/template_layout')").select("content_key", "pointer", "value")


@register("view_source_leaves", f"WITH {_BODIES}, s AS (SELECT content_key, {_POINTER} AS pointer FROM tr WHERE (atom IS NOT NULL OR type = 'NULL') AND starts_with(path, '$.data.page')) SELECT content_key, pointer FROM s WHERE NOT regexp_matches(pointer, '/(?:id|pos|tab_id|module_group_id)(?:/|$)')")
def view_source_leaves(spark: SparkSession, d: str) -> DataFrame:
    """A view of a source without its locators: keys that only place things are taken out wherever they stand."""
    leaves = sealed.json_leaves(bodies(spark, d), "content_key", "body").where("problem is null and type not in ('object', 'array') and startswith(pointer, '/data/page/')")
    return leaves.where(~F.col("pointer").rlike("/(?:id|pos|tab_id|module_group_id)(?:/|$)")).select("content_key", "pointer")


@register("s11_selected_scan", "SELECT unit_id, source.canonical_address.record_id AS record_id, length(retrieval_visible_text) AS chars FROM p05_story_rus WHERE source.canonical_address.record_id IN ('lore_hub:zh-cn:1200019', 'lore_hub:zh-cn:1200048')")
def s11_selected_scan(spark: SparkSession, d: str) -> DataFrame:
    """Units of chosen records; the choice and the columns reach the scan."""
    a = F.col("source.canonical_address.record_id")
    return table(spark, d, "p05_story_rus").where(a.isin("lore_hub:zh-cn:1200019", "lore_hub:zh-cn:1200048")).select("unit_id", a.alias("record_id"), F.length("retrieval_visible_text").alias("chars"))


_ROUTE = "SELECT doc_id, CASE WHEN n_chars < 700 THEN ['micro'] WHEN n_chars < 1400 THEN ['micro', 'macro'] ELSE ['macro'] END AS g FROM documents"


@register("s13_granularity_rows", f"SELECT doc_id, len(g) > 1 AS shared FROM ({_ROUTE}) WHERE list_contains(g, 'macro')")
def s13_granularity_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one granularity of an index input in which a row may serve several."""
    n = F.col("n_chars")
    g = F.when(n < 700, F.array(F.lit("micro"))).when(n < 1400, F.array(F.lit("micro"), F.lit("macro"))).otherwise(F.array(F.lit("macro")))
    return table(spark, d, "documents").select("doc_id", g.alias("g")).where(F.array_contains("g", "macro")).select("doc_id", (F.size("g") > 1).alias("shared"))


@register("s12_exported_inputs", f"SELECT granularity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(g) AS granularity FROM ({_ROUTE})) GROUP BY granularity")
def s12_exported_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Index inputs written once, in one folder a granularity with the manifest last, read back after a check, and counted."""
    import uuid

    from ..session import shared_folder

    n = F.col("n_chars")
    g = F.when(n < 700, F.array(F.lit("micro"))).when(n < 1400, F.array(F.lit("micro"), F.lit("macro"))).otherwise(F.array(F.lit("macro")))
    where = f"{shared_folder(spark)}/inputs-{uuid.uuid4().hex}"
    sealed.write_sealed(table(spark, d, "documents").select("doc_id", "n_chars", F.explode(g).alias("granularity")), where, ["granularity"])
    return sealed.read_sealed(spark, where).groupBy("granularity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@register("s14_located_rows", f"{_TWO} SELECT query_id, key, source, n_chars FROM h JOIN documents ON doc_id = key WHERE route = 'sparse' AND rank = 1")
def s14_located_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows looked up by the locators that a search gives."""
    h = two_lists(spark, d).where("route = 'sparse' and rank = 1").select("query_id", "key")
    return h.join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "n_chars"), "key").select("query_id", "key", "source", "n_chars")


@register("s15_vector_shards", "SELECT vec_id % 4 AS shard, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last, CAST(max(len(embedding)) AS INTEGER) AS width FROM embeddings GROUP BY 1")
def s15_vector_shards(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by shard with the rows and the width of each."""
    return table(spark, d, "embeddings").groupBy((F.col("vec_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.max(F.size("embedding")).alias("width"))


@register("s19_merged_export", "WITH o AS (SELECT source, row_number() OVER (ORDER BY target_weight DESC NULLS LAST, source) AS n FROM mix_targets WHERE source IS NOT NULL) SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place, CAST(n AS INTEGER) AS part FROM documents JOIN o USING (source)")
def s19_merged_export(spark: SparkSession, d: str) -> DataFrame:
    """Exports of several sources merged in the order of selection: part and place order the whole without a global sort."""
    o = table(spark, d, "mix_targets").where("source is not null").select("source", F.row_number().over(Window.orderBy(F.desc_nulls_last("target_weight"), "source")).alias("part"))
    x = table(spark, d, "documents").select("source", "doc_id").join(F.broadcast(o), "source")
    return x.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"), "part")


@register("s20_text_lines", r"SELECT doc_id, concat_ws(chr(9), CAST(doc_id AS VARCHAR), coalesce(source, ''), regexp_replace(coalesce(title, ''), '[\t\r\n]+', ' ', 'g'), CAST(n_chars AS VARCHAR)) AS tsv, '- **' || coalesce(title, '(untitled)') || '** (' || coalesce(source, 'unknown') || ', ' || n_chars || ' characters)' AS markdown FROM documents")
def s20_text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a TSV and of a Markdown list; breaks and tabs inside values become blanks."""
    text = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    tsv = F.concat_ws("\t", F.col("doc_id").cast("string"), text("source", ""), F.regexp_replace(text("title", ""), r"[\t\r\n]+", " "), F.col("n_chars").cast("string"))
    line = F.concat(F.lit("- **"), text("title", "(untitled)"), F.lit("** ("), text("source", "unknown"), F.lit(", "), F.col("n_chars").cast("string"), F.lit(" characters)"))
    return table(spark, d, "documents").select("doc_id", tsv.alias("tsv"), line.alias("markdown"))


@register("s22_submissions", "SELECT submit_token, min(id) AS id, count(DISTINCT id) > 1 AS repeated FROM turns WHERE submit_token IS NOT NULL GROUP BY submit_token")
def s22_submissions(spark: SparkSession, d: str) -> DataFrame:
    """A submission counts once by its token, however often it arrives; the first turn answers for it."""
    t = table(spark, d, "turns").where("submit_token is not null")
    return t.groupBy("submit_token").agg(F.min("id").alias("id"), (F.countDistinct("id") > 1).alias("repeated"))


@register("v3_rendered_records", f"WITH {_UNITS} SELECT record_id, '# ' || coalesce(any_value(record_name), '') || chr(10) || string_agg(coalesce(text, raw, '(' || coalesce(kind, 'unknown') || ')'), chr(10) ORDER BY section_no, unit_no) AS markdown FROM units GROUP BY record_id")
def v3_rendered_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as Markdown: the name and the units' texts in order, other units by their kind."""
    u = units(spark, d).select("record_id", "record_name", "section_no", "unit_no", F.coalesce("text", "raw", F.concat(F.lit("("), F.coalesce("kind", F.lit("unknown")), F.lit(")"))).alias("t"))
    g = u.groupBy("record_id").agg(F.first("record_name").alias("n"), F.array_sort(F.collect_list(F.struct("section_no", "unit_no", "t"))).alias("x"))
    return g.select("record_id", F.concat(F.lit("# "), F.coalesce("n", F.lit("")), F.lit("\n"), F.array_join("x.t", "\n")).alias("markdown"))


_HEADER = "concat_ws(' / ', record_name, CASE WHEN section_name IS DISTINCT FROM record_name THEN section_name END)"


@register("c4_retrieval_text", f"WITH {_UNITS}, x AS (SELECT *, lag(section_name) OVER (PARTITION BY record_id ORDER BY section_no, unit_no) AS before FROM units WHERE text IS NOT NULL) SELECT record_id, section_no, unit_no, concat_ws(chr(10), nullif({_HEADER}, ''), CASE WHEN unit_no > 0 AND before IS NOT DISTINCT FROM section_name THEN '[continued]' END, text) AS rendered FROM x")
def c4_retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    """Text for retrieval: labels without repeats, a mark on continuations, the body."""
    before = F.lag("section_name").over(Window.partitionBy("record_id").orderBy("section_no", "unit_no"))
    u = units(spark, d).where("text is not null").withColumn("before", before)
    header = F.concat_ws(" / ", "record_name", F.when(~F.col("section_name").eqNullSafe(F.col("record_name")), F.col("section_name")))
    mark = F.when((F.col("unit_no") > 0) & F.col("before").eqNullSafe(F.col("section_name")), "[continued]")
    return u.select("record_id", "section_no", "unit_no", F.concat_ws("\n", F.when(header != "", header), mark, F.col("text")).alias("rendered"))


@register("c10_natural_parent", f"WITH {_QUOTES}, c AS (SELECT DISTINCT evidence_id, unit_id FROM q WHERE unit_id IS NOT NULL), r AS (SELECT unit_id, min(source.canonical_address.record_id) AS record_id, min(length(retrieval_visible_text)) AS n FROM p05_story_rus WHERE unit_id IS NOT NULL GROUP BY unit_id) SELECT c.evidence_id, r.record_id, count(*) AS units, CAST(sum(x.n) AS BIGINT) AS chars FROM c JOIN r USING (unit_id) JOIN r x ON x.record_id = r.record_id GROUP BY 1, 2")
def c10_natural_parent(spark: SparkSession, d: str) -> DataFrame:
    """The whole record behind each quote: its units and characters, summed before they are joined."""
    from .links import unit_texts

    u = unit_texts(spark, d)
    whole = u.groupBy("record_id").agg(F.count("*").alias("units"), F.sum(F.length("t")).alias("chars"))
    q = quotes(spark, d).where("unit_id is not null").select("evidence_id", "unit_id").distinct()
    return q.join(u.select("unit_id", "record_id"), "unit_id").join(whole, "record_id").select("evidence_id", "record_id", "units", "chars")


_CARDS = "cb AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY section, evidence_id) - 1 AS i FROM (SELECT DISTINCT source_id, q.evidence_id AS evidence_id, coalesce(q.section, -1) AS section, length(q.text) AS size FROM (SELECT source_id, unnest(quotes) AS q FROM card_semantic_cases) WHERE q.text IS NOT NULL))"


@register("c8_card_batches", f"WITH {_CARDS}, {greedy_sql('SELECT source_id AS owner, i, size FROM cb', 900, 6)} SELECT source_id, section, evidence_id, cb.size, CAST(batch AS INTEGER) AS batch FROM cb JOIN z ON z.owner = cb.source_id AND z.i = cb.i")
def c8_card_batches(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of a source packed by section into requests of at most 6 quotes and 900 characters; a section goes on in the next request."""
    c = table(spark, d, "card_semantic_cases").select("source_id", F.explode("quotes").alias("q")).select("source_id", "q.evidence_id", F.coalesce("q.section", F.lit(-1)).alias("section"), F.length("q.text").alias("size")).where("size is not null").distinct()
    return assembly.packed(c, "source_id", ["section", "evidence_id"], "size", 900, 6)


_HALVES = "hb AS (SELECT record_key, doc_id, CAST(half AS INTEGER) AS half, CAST(floor((half + 1) * n_chars / parts) - floor(half * n_chars / parts) AS INTEGER) AS size, row_number() OVER (PARTITION BY record_key ORDER BY doc_id, half) - 1 AS i FROM (SELECT *, unnest(range(CAST(parts AS BIGINT))) AS half FROM (SELECT record_key, doc_id, n_chars, pow(2, ceil(log2(greatest(n_chars / 2000, 1.0::DOUBLE)))) AS parts FROM documents WHERE record_key IS NOT NULL AND text <> '')))"


@register("x9_bisected_batches", f"WITH {_HALVES}, {greedy_sql('SELECT record_key AS owner, i, size FROM hb', 2000)} SELECT record_key, doc_id, half, hb.size, CAST(batch AS INTEGER) AS batch FROM hb JOIN z ON z.owner = hb.record_key AND z.i = hb.i")
def x9_bisected_batches(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a record packed into bodies of 2,000 characters; one that can't fit alone is halved until it does."""
    x = table(spark, d, "documents").where("record_key is not null and text <> ''").select("record_key", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n_chars") / 2000, F.lit(1.0))))).cast("int") - 1), lambda i: i)).alias("half"), "n_chars")
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n_chars") / 2000, F.lit(1.0)))))
    size = (F.floor((F.col("half") + 1) * F.col("n_chars") / parts) - F.floor(F.col("half") * F.col("n_chars") / parts)).cast("int")
    return assembly.packed(x.select("record_key", "doc_id", "half", size.alias("size")), "record_key", ["doc_id", "half"], "size", 2000, None)


@register("x17_matched_controls")
def x17_matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """For each anchor (long letters and notices) the control of the nearest length from other sources, none used twice, by source of the anchor."""
    x = table(spark, d, "documents").where("lang is not null")
    anchors = x.where("source in ('player_letter', 'notice')").select("lang", F.col("doc_id").alias("anchor"), "n_chars")
    controls = x.where("source not in ('player_letter', 'notice')").select("lang", F.col("doc_id").alias("control"), "n_chars")
    return fusion.matched(anchors, controls, "lang", "anchor", "control", "n_chars")


@register("x19_round_robin_frontier", f"{_TWO}, ln AS (SELECT query_id, route, key, rank, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, route) AS again FROM h WHERE rank <= 20), z AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank, route) AS place FROM ln WHERE again = 1) SELECT query_id, key, CAST(place AS INTEGER) AS place FROM z WHERE place <= 12")
def x19_round_robin_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Two lanes read in turn, what is read already passed over, until twelve pages are read."""
    return fusion.round_robin(two_lists(spark, d).where("rank <= 20"), "query_id", "route", "key", "rank", 12)


@register("f3_contract", f"{_TWO}, x AS (SELECT query_id, route, key, CASE WHEN query_id % 4 = 1 AND rank = 3 THEN 2 WHEN query_id % 4 = 2 AND rank > 5 THEN rank + 1 ELSE rank END AS rank FROM h UNION ALL SELECT query_id, route, key, 60 FROM h WHERE query_id % 4 = 3 AND rank = 1), s AS (SELECT query_id, route, count(*) AS n, count(DISTINCT key) AS keys, count(DISTINCT rank) AS ranks, min(rank) AS lo, max(rank) AS hi FROM (SELECT DISTINCT * FROM x) GROUP BY ALL) SELECT query_id, route AS channel, 'all' AS granularity, unnest(list_filter([CASE WHEN ranks < n THEN 'position taken twice' END, CASE WHEN keys < n THEN 'key at two positions' END, CASE WHEN lo <> 1 OR hi <> ranks THEN 'positions not contiguous' END], lambda p: p IS NOT NULL)) AS problem FROM s".replace(", s AS (SELECT query_id, route, count", ", st3 AS (SELECT query_id, route, count").replace("FROM s\"", "FROM st3\"").replace("AS problem FROM s", "AS problem FROM st3"))
def f3_contract(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the fusion contract in lists of which some were given a flaw: a shared position, a gap, a key twice; the others are whole."""
    h = two_lists(spark, d)
    q, r = F.col("query_id") % 4, F.col("rank")
    bent = h.withColumn("rank", F.when((q == 1) & (r == 3), 2).when((q == 2) & (r > 5), r + 1).otherwise(r))
    twice = h.where((q == 3) & (r == 1)).withColumn("rank", F.lit(60))
    return fusion.contract_violations(bent.unionByName(twice).select("query_id", F.col("route").alias("channel"), F.lit("all").alias("granularity"), "key", "rank"))
