"""Queries of metrics, graphs, assembly, sampling and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lines import numbered_lines
from ..operators import assembly, graphs, search, statistics
from ..session import table
from .registry import register
from .search import _DENSE, _TWO, two_lists


def dense_hits(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """Dense hits with whether the hit has the query's label."""
    v = table(spark, d, "embeddings")
    lab = v.select("vec_id", "label")
    h = search.dense_top_k(v, v.where("vec_id % 100 = 0"), k)
    return h.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").withColumn("hit", F.col("label") == F.col("want"))


_HITS = f"WITH {_DENSE}, h AS (SELECT d.query_id, d.vec_id, d.rank, a.label, b.label AS want, a.label = b.label AS hit FROM dense d JOIN embeddings a ON a.vec_id = d.vec_id JOIN embeddings b ON b.vec_id = d.query_id WHERE rank <= 50)"


@register("m1_first_positive", f"{_HITS} SELECT query_id, CAST(min(rank) FILTER (WHERE hit) AS INTEGER) AS first_positive, CAST(min(rank) FILTER (WHERE NOT hit) AS INTEGER) AS first_negative FROM h GROUP BY query_id")
def m1_first_positive(spark: SparkSession, d: str) -> DataFrame:
    return dense_hits(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_positive"), F.min(F.when(~F.col("hit"), F.col("rank"))).alias("first_negative"))


@register("m2_sufficient_rank", f"{_HITS}, n AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM h WHERE hit), z AS (SELECT query_id, (k - 1) // 2 AS set_no, max(rank) AS r, count(*) AS c FROM n GROUP BY ALL HAVING count(*) = 2) SELECT query_id, CAST(min(r) AS INTEGER) AS sufficient_rank FROM z GROUP BY query_id")
def m2_sufficient_rank(spark: SparkSession, d: str) -> DataFrame:
    """Evidence sets of two positives: the least rank at which some set is complete."""
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    s = dense_hits(spark, d).where("hit").withColumn("s", F.floor((k - 1) / 2)).groupBy("query_id", "s").agg(F.max("rank").alias("r"), F.count("*").alias("c"))
    return s.where("c = 2").groupBy("query_id").agg(F.min("r").alias("sufficient_rank"))


_M3 = "round(avg(CASE WHEN f <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}"


@register("m3_recall_mrr", f"{_HITS}, f AS (SELECT query_id, min(rank) FILTER (WHERE hit) AS f FROM h GROUP BY query_id) SELECT count(*) AS n, {_M3.format(k=1)}, {_M3.format(k=5)}, {_M3.format(k=10)}, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM f")
def m3_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    f = dense_hits(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("f"))
    at = lambda k: F.round(F.avg(F.when(F.col("f") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return f.agg(F.count("*").alias("n"), at(1), at(5), at(10), F.round(F.avg(F.coalesce(1.0 / F.col("f"), F.lit(0.0))), 6).alias("mrr"))


@register("m6_macro_recall", f"{_HITS}, q AS (SELECT query_id, any_value(want) AS family, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS r FROM h WHERE rank <= 10 GROUP BY query_id) SELECT round(avg(r), 6) AS macro_family, count(*) AS families FROM (SELECT family, avg(r) AS r FROM q GROUP BY family)")
def m6_macro_recall(spark: SparkSession, d: str) -> DataFrame:
    q = dense_hits(spark, d, 10).groupBy("query_id").agg(F.first("want").alias("family"), F.avg(F.col("hit").cast("double")).alias("r"))
    return q.groupBy("family").agg(F.avg("r").alias("r")).agg(F.round(F.avg("r"), 6).alias("macro_family"), F.count("*").alias("families"))


@register("m8_rank_delta", f"{_TWO} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.key, b.key) AS key, CAST(b.rank - a.rank AS INTEGER) AS delta, CASE WHEN a.rank IS NULL THEN 'only second' WHEN b.rank IS NULL THEN 'only first' ELSE 'both' END AS side FROM (SELECT * FROM h WHERE route = 'bm25' AND rank <= 10) a FULL JOIN (SELECT * FROM h WHERE route = 'sparse' AND rank <= 10) b ON a.query_id = b.query_id AND a.key = b.key")
def m8_rank_delta(spark: SparkSession, d: str) -> DataFrame:
    h = two_lists(spark, d).where("rank <= 10")
    a = h.where("route = 'bm25'").select("query_id", "key", F.col("rank").alias("ra"))
    b = h.where("route = 'sparse'").select("query_id", "key", F.col("rank").alias("rb"))
    side = F.when(F.col("ra").isNull(), "only second").when(F.col("rb").isNull(), "only first").otherwise("both")
    return a.join(b, ["query_id", "key"], "full").select("query_id", "key", (F.col("rb") - F.col("ra")).alias("delta"), side.alias("side"))


@register("m9_depth_ladder", f"{_HITS}, c AS (SELECT query_id, count(*) FILTER (WHERE hit) AS all_hits FROM h GROUP BY query_id), x AS (SELECT h.query_id, p.depth, count(*) FILTER (WHERE hit AND rank <= p.depth) AS n FROM h, (SELECT unnest([1, 5, 10, 20, 50]) AS depth) p GROUP BY ALL) SELECT query_id, min(depth) AS depth FROM x JOIN c USING (query_id) WHERE n >= (all_hits + 1) // 2 GROUP BY query_id")
def m9_depth_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The least depth of a ladder that shows half of the positives."""
    h = dense_hits(spark, d)
    c = h.groupBy("query_id").agg(F.count_if("hit").alias("all_hits"))
    steps = F.explode(F.filter(F.array(*map(F.lit, (1, 5, 10, 20, 50))), lambda x: F.col("rank") <= x))
    x = h.where("hit").select("query_id", steps.alias("depth")).groupBy("query_id", "depth").agg(F.count("*").alias("n"))
    low = x.join(c, "query_id").where(F.col("n") >= F.floor((F.col("all_hits") + 1) / 2)).groupBy("query_id").agg(F.min("depth").alias("depth"))
    none = c.where("all_hits = 0").select("query_id", F.lit(1).alias("depth"))
    return low.unionByName(none)


@register("a7_set_overlap", f"{_TWO}, x AS (SELECT query_id, key, count(*) AS n, min(route) AS r, any_value(n_chars) AS size, any_value(md5(text)) AS t FROM h JOIN documents ON doc_id = key WHERE rank <= 20 GROUP BY ALL), tx AS (SELECT query_id, t, max(CASE WHEN n = 2 OR r = 'bm25' THEN 1 ELSE 0 END) AS in_a FROM x GROUP BY ALL) SELECT query_id, CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS common, CAST(sum(CASE WHEN n = 1 AND r = 'bm25' THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN n = 1 AND r = 'sparse' THEN 1 ELSE 0 END) AS BIGINT) AS only_b, round(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) / count(*), 9) AS jaccard, CAST(sum(CASE WHEN n = 1 AND r = 'sparse' AND in_a = 1 THEN 1 ELSE 0 END) AS BIGINT) AS contained_b, CAST(sum(CASE WHEN n = 1 AND r = 'sparse' AND in_a = 0 THEN size ELSE 0 END) AS BIGINT) AS chars_outside FROM x JOIN tx USING (query_id, t) GROUP BY query_id")
def a7_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What two lists share, what one has alone, how much of that stands word for word in the other, and the characters that do not."""
    h = two_lists(spark, d).where("rank <= 20")
    counts = statistics.set_overlap(h, ["query_id"], "route", "bm25", "sparse", "key")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), F.md5("text").alias("t"))
    x = h.join(docs, "key").groupBy("query_id", "key", "t", "size").agg(F.max((F.col("route") == "bm25").cast("int")).alias("a"))
    in_a = F.max("a").over(Window.partitionBy("query_id", "t"))
    only = x.withColumn("in_a", in_a).where("a = 0").groupBy("query_id").agg(F.count_if(F.col("in_a") == 1).alias("contained_b"), F.sum(F.when(F.col("in_a") == 0, F.col("size")).otherwise(0)).alias("chars_outside"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return counts.join(only, "query_id", "left").select(*counts.columns, zero("contained_b"), zero("chars_outside"))


@register("a14_increments", f"{_TWO}, x AS (SELECT h.query_id, route, key, coalesce(e.split, '-') AS split FROM h JOIN eval_items e ON e.item_id = h.query_id WHERE rank <= 20), n AS (SELECT split, query_id, key FROM x WHERE route = 'sparse' EXCEPT SELECT split, query_id, key FROM x WHERE route = 'bm25') SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS added, count(DISTINCT query_id) AS queries FROM n GROUP BY ROLLUP (split)")
def a14_increments(spark: SparkSession, d: str) -> DataFrame:
    """What the second method adds, by split and over all."""
    e = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.coalesce("split", F.lit("-")).alias("split"))
    x = two_lists(spark, d).where("rank <= 20").join(e, "query_id")
    n = x.where("route = 'sparse'").join(x.where("route = 'bm25'").select("query_id", "key"), ["query_id", "key"], "left_anti")
    r = n.rollup("split").agg(F.grouping_id().alias("g"), F.count("*").alias("added"), F.countDistinct("query_id").alias("queries"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "added", "queries")


# ---- graphs ------------------------------------------------------------------------------------


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return graphs.dialogue_groups(table(spark, d, "canonical_records"))


@register("g1_diagnostics")
def g1_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return graphs.per_graph(_groups(spark, d), lambda n, e, r: [(" | ".join(graphs.diagnostics(n, e, r)),)], "problems string")


@register("g2_display_order")
def g2_display_order(spark: SparkSession, d: str) -> DataFrame:
    def rows(n, e, r):
        order, cyclic = graphs.display_order(n, e, r)
        return [(x, i, cyclic) for i, x in enumerate(order)]

    return graphs.per_graph(_groups(spark, d), rows, "node_id string, place int, cyclic boolean")


_G = """r AS (SELECT record_id, sections FROM canonical_records QUALIFY built_at = max(built_at) OVER (PARTITION BY record_id)),
    u AS (SELECT record_id, unnest(sections) AS s, unnest(range(len(sections))) AS section_no FROM r), v AS (SELECT record_id, section_no, unnest(s.units) AS u, unnest(range(len(s.units))) AS unit_no FROM u),
    g AS (SELECT record_id, section_no, unit_no, unnest(u.value.groups) AS g, unnest(range(len(u.value.groups))) AS group_no FROM v), h AS (SELECT DISTINCT ON (record_id, section_no, unit_no, group_no) * FROM g WHERE g IS NOT NULL),
    nodes AS (SELECT record_id, section_no, unit_no, group_no, unnest(g.nodes, recursive := true) FROM h), edges AS (SELECT record_id, section_no, unit_no, group_no, unnest(g.edges, recursive := true) FROM h)"""


@register(
    "g6_edge_documents",
    f"""WITH {_G} SELECT DISTINCT e.record_id, CAST(e.section_no AS INTEGER) AS section_no, CAST(e.unit_no AS INTEGER) AS unit_no, CAST(e.group_no AS INTEGER) AS group_no, e.parent_id, e.child_id,
    coalesce(p.dialogue, '') || chr(10) || coalesce(c.dialogue, '') AS text FROM edges e JOIN nodes p ON (p.record_id, p.section_no, p.unit_no, p.group_no, p.source_id) = (e.record_id, e.section_no, e.unit_no, e.group_no, e.parent_id)
    JOIN nodes c ON (c.record_id, c.section_no, c.unit_no, c.group_no, c.source_id) = (e.record_id, e.section_no, e.unit_no, e.group_no, e.child_id)""",
)
def g6_edge_documents(spark: SparkSession, d: str) -> DataFrame:
    """One document an edge: the texts of both ends, built inside the row that holds the graph."""
    g = _groups(spark, d).select("record_id", "section_no", "unit_no", "group_no", "nodes", F.explode("edges").alias("e"))
    end = lambda c: F.filter("nodes", lambda n: n["source_id"] == F.col(f"e.{c}"))
    ends = g.select("record_id", "section_no", "unit_no", "group_no", "e.parent_id", "e.child_id", end("parent_id").alias("p"), end("child_id").alias("c"))
    ends = ends.select("record_id", "section_no", "unit_no", "group_no", "parent_id", "child_id", F.explode("p").alias("pn"), "c").select("*", F.explode("c").alias("cn"))
    text = F.concat(F.coalesce("pn.dialogue", F.lit("")), F.lit("\n"), F.coalesce("cn.dialogue", F.lit("")))
    return ends.select("record_id", "section_no", "unit_no", "group_no", "parent_id", "child_id", text.alias("text")).distinct()


@register("g3_recursive_reach", "WITH RECURSIVE t AS (SELECT DISTINCT id, session, sequence FROM turns WHERE session IS NOT NULL), e AS (SELECT id AS a, lead(id) OVER (PARTITION BY session ORDER BY sequence) AS b FROM t), r(node, hops) AS (SELECT id, 0 FROM t QUALIFY row_number() OVER (PARTITION BY session ORDER BY sequence) = 1 UNION ALL SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE e.b IS NOT NULL) SELECT node, hops FROM r")
def g3_recursive_reach(spark: SparkSession, d: str) -> DataFrame:
    """All turns that their session's first turn reaches, over the chain of turns to its end."""
    t = table(spark, d, "turns").where("session is not null").select("id", "session", "sequence").distinct()
    w = Window.partitionBy("session").orderBy("sequence")
    return graphs.chain_places(t.select(F.col("id").alias("node"), F.lag("id").over(w).alias("back")))


@register("x1_arrivals", f"WITH {_DENSE}, b AS (SELECT query_id AS source, vec_id AS target, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM dense WHERE vec_id < query_id) SELECT DISTINCT least(source, target) AS low, greatest(source, target) AS high FROM b WHERE n <= 20")
def x1_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Vectors arrive in the order of their ids; each query vector links to the best among the earlier ones."""
    v = table(spark, d, "embeddings")
    ranks = search.dense_top_k(v, v.where("vec_id % 100 = 0"), 20, earlier=True).select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), "rank")
    return graphs.arrivals(ranks, v.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("place")))


# ---- assembly ----------------------------------------------------------------------------------


@register("e1_best_candidates", f"{_TWO}, x AS (SELECT query_id, key, rank, CASE route WHEN 'bm25' THEN 0 ELSE 1 END AS input_index FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, input_index) AS n, count(*) OVER (PARTITION BY query_id, key) AS seen FROM x) SELECT query_id, key, CAST(rank AS INTEGER) AS rank, input_index, seen FROM o WHERE n = 1")
def e1_best_candidates(spark: SparkSession, d: str) -> DataFrame:
    return assembly.best_candidates(two_lists(spark, d).select("query_id", "key", "rank", F.when(F.col("route") == "bm25", 0).otherwise(1).alias("input_index")))


@register("e3_blocks", "WITH s AS (SELECT DISTINCT id, session, sequence, question FROM turns WHERE session IS NOT NULL), o AS (SELECT *, CASE WHEN sequence - lag(sequence) OVER w <= 20 THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY session ORDER BY sequence)), b AS (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY sequence) AS b FROM o) SELECT session, min(sequence) AS first, max(sequence) AS last, count(*) AS rows, string_agg(question, chr(10) ORDER BY sequence) AS text FROM b GROUP BY session, b")
def e3_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("session is not null").select("id", "session", "sequence", "question").distinct()
    return assembly.blocks(t, ["session"], "sequence", "question", step=20)


@register("e12_conversation_window", "WITH t AS (SELECT DISTINCT id, session AS conversation, sequence AS turn, question AS text FROM turns WHERE session IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY turn DESC) AS age FROM t), s AS (SELECT *, CASE WHEN age <= 2 THEN 'full' ELSE 'index' END AS kind, CASE WHEN age <= 2 THEN text ELSE substr(text, 1, 8) END AS shown FROM a), u AS (SELECT *, sum(octet_length(encode(shown))) OVER (PARTITION BY conversation ORDER BY age) AS upto FROM s) SELECT conversation, turn, kind, shown AS text, CAST(length(text) - length(shown) AS INTEGER) AS omitted_chars FROM u WHERE upto <= 300 OR age = 1")
def e12_conversation_window(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("session is not null").select("id", F.col("session").alias("conversation"), F.col("sequence").alias("turn"), F.col("question").alias("text")).distinct()
    return assembly.conversation_window(t, 2, 300, 8)


@register("e13_gain", f"{_TWO} SELECT a.query_id, count(*) FILTER (WHERE b.key IS NULL) AS new_items, count(*) FILTER (WHERE b.key IS NOT NULL) AS kept_items FROM (SELECT * FROM h WHERE route = 'sparse' AND rank <= 20) a LEFT JOIN (SELECT * FROM h WHERE route = 'bm25' AND rank <= 20) b ON a.query_id = b.query_id AND a.key = b.key GROUP BY a.query_id")
def e13_gain(spark: SparkSession, d: str) -> DataFrame:
    h = two_lists(spark, d).where("rank <= 20")
    return assembly.gain(h.where("route = 'bm25'"), h.where("route = 'sparse'"), ["query_id"], "key")


# ---- sampling, predicates, validation ----------------------------------------------------------


@register("x22_blind_sides", "SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('run-1:' || doc_id), 1, 2) AS INTEGER) % 2 = 0 THEN 'AB' ELSE 'BA' END AS sides FROM documents")
def x22_blind_sides(spark: SparkSession, d: str) -> DataFrame:
    first = F.conv(F.substring(F.sha2(F.concat(F.lit("run-1:"), F.col("doc_id").cast("string")), 256), 1, 2), 16, 10).cast("int")
    return table(spark, d, "documents").select("doc_id", F.when(first % 2 == 0, "AB").otherwise("BA").alias("sides"))


# Patterns by which all lines of a text make it noise, in order.
_NOISE = (("placeholder", r"[\s\-—_.…/]*"), ("numeric", r"[\s\d.,:%/+-]+"), ("technical", r"[\w\-]+[:：]\s*[\w.\-]+"), ("rule", r"(?:规则|注意|Rule|Note)\s*\d*[:：.].*"), ("walkthrough", r"(?:步骤|第\s*\d+\s*步|Step\s*\d+).*"))


@register("x11_line_noise", "SELECT doc_id, CASE WHEN source = 'voice_lines' OR text IS NULL THEN NULL " + " ".join(f"WHEN len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_full_match(l, '{p}'))) = 0 THEN '{word}'" for word, p in _NOISE) + r" END AS noise, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\d{7,}'))) AS INTEGER) AS number_lines FROM documents")
def x11_line_noise(spark: SparkSession, d: str) -> DataFrame:
    """The first noise of which all lines of a text are (dialogue is exempt), and how many lines hold long numbers."""
    lines = F.split("text", "\n", -1)
    noise = F.when((F.col("source") == "voice_lines") | F.col("text").isNull(), F.lit(None))
    every = lambda pattern: F.forall(lines, lambda x: x.rlike(f"^(?:{pattern})$"))
    for word, pattern in _NOISE:
        noise = noise.when(every(pattern), word)
    return table(spark, d, "documents").select("doc_id", noise.alias("noise"), F.size(F.filter(lines, lambda x: x.rlike(r"\d{7,}"))).alias("number_lines"))


_CUE, _STAT, _BULLET = "说|问|答|曾|said|asked", r"\d+(?:\.\d+)?%|\d{3,}", r"^\s*[-*#]|https?://"


@register("line_spans", rf"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), x AS (SELECT doc_id, p, unnest(range(len(p))) AS i FROM l), y AS (SELECT doc_id, p[i + 1] AS line, coalesce(list_sum(list_transform(p[1:i], lambda v: length(v) + 1)), 0) AS s FROM x) SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(s + length(line) AS INTEGER) AS span_end FROM y WHERE length(line) >= 8 AND regexp_matches(line, '{_CUE}') AND NOT regexp_matches(line, '{_STAT}') AND NOT regexp_matches(line, '{_BULLET}')")
def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of at least eight characters with a narrative cue, without figures, bullets and addresses, with exact offsets."""
    line = F.col("l.line")
    keep = (F.length(line) >= 8) & line.rlike(_CUE) & ~line.rlike(_STAT) & ~line.rlike(_BULLET)
    x = table(spark, d, "documents").select("doc_id", F.explode(numbered_lines("text")).alias("l")).where(keep)
    return x.select("doc_id", "l.span_start", (F.col("l.span_start") + F.length(line)).alias("span_end"))


@register("reranker_text", "SELECT doc_id, substr(array_to_string(list_filter([CASE WHEN trim(title) <> '' THEN 'Title: ' || title END, CASE WHEN trim(source) <> '' THEN 'Section: ' || source END, CASE WHEN trim(text) <> '' THEN 'Text: ' || text END], lambda x: x IS NOT NULL), chr(10)), 1, 600) AS body, length(array_to_string(list_filter([CASE WHEN trim(title) <> '' THEN 'Title: ' || title END, CASE WHEN trim(source) <> '' THEN 'Section: ' || source END, CASE WHEN trim(text) <> '' THEN 'Text: ' || text END], lambda x: x IS NOT NULL), chr(10))) > 600 AS cut FROM documents")
def reranker_text(spark: SparkSession, d: str) -> DataFrame:
    line = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(label), F.col(c)))
    body = F.concat_ws("\n", line("Title: ", "title"), line("Section: ", "source"), line("Text: ", "text"))
    return table(spark, d, "documents").select("doc_id", F.substring(body, 1, 600).alias("body"), (F.length(body) > 600).alias("cut"))


@register("merge_views", r"WITH q AS (SELECT DISTINCT case_id, source_id, q.* FROM (SELECT case_id, source_id, unnest(quotes) AS q FROM card_semantic_cases) WHERE q IS NOT NULL), k AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS view FROM q WHERE text IS NOT NULL AND kind IS NOT NULL AND kind <> 'structured_observation') SELECT source_id, view, array_to_string(list_sort(list(DISTINCT evidence_id)), ' ') AS evidence, count(DISTINCT case_id) AS cases FROM k WHERE NOT regexp_full_match(view, '[\s\d.,:%/+-]*') GROUP BY 1, 2")
def merge_views(spark: SparkSession, d: str) -> DataFrame:
    """Views of a source: unknown and structured kinds and noise are dropped, equal texts but for blanks merged with their evidence."""
    q = table(spark, d, "card_semantic_cases").select("case_id", "source_id", F.explode("quotes").alias("q")).where("q is not null").distinct()
    k = q.where("q.text is not null and q.kind is not null and q.kind <> 'structured_observation'").withColumn("view", F.trim(F.regexp_replace("q.text", r"\s+", " ")))
    k = k.where(~F.col("view").rlike(r"^[\s\d.,:%/+-]*$"))
    return k.groupBy("source_id", "view").agg(F.array_join(F.sort_array(F.collect_set("q.evidence_id")), " ").alias("evidence"), F.countDistinct("case_id").alias("cases"))


_PAGES = "pg AS (SELECT *, (doc_id - 1) // 50 AS page FROM documents), sg AS (SELECT min(page) AS stop FROM pg WHERE text LIKE '%\"next_page\"%' OR doc_id = 777), kept AS (SELECT * FROM pg WHERE page <= coalesce((SELECT stop FROM sg), 1000000000))"


@register("s3_inventory", f"WITH {_PAGES} SELECT record_key, count(*) AS listed, count(DISTINCT source) AS channels, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources, count(*) - count(DISTINCT md5(text)) AS repeats FROM kept GROUP BY record_key")
def s3_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Listings read page by page up to the first page with a signal (here a marked row), deduplicated into an inventory by record."""
    pages = table(spark, d, "documents").withColumn("page", F.floor((F.col("doc_id") - 1) / 50))
    stop = pages.where(F.col("text").contains('"next_page"') | (F.col("doc_id") == 777)).agg(F.coalesce(F.min("page"), F.lit(10**9)).alias("stop"))
    kept = pages.crossJoin(F.broadcast(stop)).where("page <= stop")
    return kept.groupBy("record_key").agg(F.count("*").alias("listed"), F.countDistinct("source").alias("channels"), F.array_join(F.sort_array(F.collect_set("source")), " ").alias("sources"), (F.count("*") - F.countDistinct(F.md5("text"))).alias("repeats"))


_FIRST = "c AS (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE source IS NOT NULL AND record_key IS NOT NULL GROUP BY record_key)"


@register("s4_round_robin", f"WITH {_FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM c), o AS (SELECT *, row_number() OVER (ORDER BY rn, source) AS place FROM r) SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM o WHERE place <= 50")
def s4_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """A bounded sample of 50 records taken from the channels in turn, a record counting once over all channels."""
    c = table(spark, d, "documents").where("source is not null and record_key is not null").groupBy("record_key").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))
    c = c.select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rn"))
    top = c.where("rn <= 50").orderBy("rn", "source").limit(50)
    return top.select("doc_id", "source", F.row_number().over(Window.orderBy("rn", "source")).alias("place"))


@register("s4_limited", "SELECT record_key, min(doc_id) AS first FROM documents WHERE record_key IS NOT NULL GROUP BY record_key ORDER BY first LIMIT 30")
def s4_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 records in the order of the inventory."""
    return table(spark, d, "documents").where("record_key is not null").groupBy("record_key").agg(F.min("doc_id").alias("first")).orderBy("first").limit(30)


@register("m10_key_checks", "SELECT 'turns' AS name, count(*) - count(DISTINCT id) AS repeated, count(*) FILTER (WHERE id IS NULL) AS missing FROM turns UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id), count(*) FILTER (WHERE doc_id IS NULL) FROM documents UNION ALL SELECT 'units', count(*) - count(DISTINCT unit_id), count(*) FILTER (WHERE unit_id IS NULL) FROM p05_story_rus")
def m10_key_checks(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, t: str, key: str) -> DataFrame:
        return table(spark, d, t).agg(F.lit(name).alias("name"), (F.count("*") - F.countDistinct(key)).alias("repeated"), F.count_if(F.col(key).isNull()).alias("missing"))

    return one("turns", "turns", "id").unionByName(one("documents", "documents", "doc_id")).unionByName(one("units", "p05_story_rus", "unit_id"))
