"""Queries of graphs, orders, channel trees and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graphs, markup, shapes
from ..session import table
from .registry import register
from .evidence import _G, _groups
from .nested import _DETAIL, page_tables
from .search import _TWO, two_lists

_PLACE = "CAST(record_id AS VARCHAR) AS record_id, CAST(section_no AS INTEGER) AS section_no, CAST(unit_no AS INTEGER) AS unit_no, CAST(group_no AS INTEGER) AS group_no"
_GRAPHS = f"""{_G},
    k AS (SELECT DISTINCT record_id, section_no, unit_no, group_no, g.root_id AS root_id, coalesce(list_filter(g.nodes, lambda x: x IS NOT NULL), []) AS nodes, coalesce(list_filter(g.edges, lambda x: x IS NOT NULL), []) AS edges FROM h),
    n AS (SELECT record_id, section_no, unit_no, group_no, id, min(i) AS i FROM (SELECT record_id, section_no, unit_no, group_no, unnest(nodes).source_id AS id, unnest(range(len(nodes))) AS i FROM k) WHERE id IS NOT NULL GROUP BY ALL),
    e AS (SELECT DISTINCT record_id, section_no, unit_no, group_no, unnest(edges).parent_id AS a, unnest(edges).child_id AS b FROM k),
    ok AS (SELECT e.* FROM e JOIN n x ON (x.record_id, x.section_no, x.unit_no, x.group_no, x.id) = (e.record_id, e.section_no, e.unit_no, e.group_no, e.a) JOIN n y ON (y.record_id, y.section_no, y.unit_no, y.group_no, y.id) = (e.record_id, e.section_no, e.unit_no, e.group_no, e.b))"""


@register("g3_reachable_nodes", f"WITH RECURSIVE {_GRAPHS}, rr(record_id, section_no, unit_no, group_no, id) AS (SELECT k.record_id, k.section_no, k.unit_no, k.group_no, k.root_id FROM k JOIN n ON (n.record_id, n.section_no, n.unit_no, n.group_no, n.id) = (k.record_id, k.section_no, k.unit_no, k.group_no, k.root_id) UNION SELECT ok.record_id, ok.section_no, ok.unit_no, ok.group_no, ok.b FROM rr r JOIN ok ON (ok.record_id, ok.section_no, ok.unit_no, ok.group_no, ok.a) = (r.record_id, r.section_no, r.unit_no, r.group_no, r.id)) SELECT {_PLACE.replace('record_id AS VARCHAR', 'n.record_id AS VARCHAR').replace('section_no AS INTEGER', 'n.section_no AS INTEGER').replace('unit_no AS INTEGER', 'n.unit_no AS INTEGER').replace('group_no AS INTEGER', 'n.group_no AS INTEGER')}, n.id AS node_id, EXISTS (SELECT 1 FROM rr r WHERE (r.record_id, r.section_no, r.unit_no, r.group_no, r.id) = (n.record_id, n.section_no, n.unit_no, n.group_no, n.id)) AS reached FROM n")
def g3_reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Which nodes of each dialogue graph its root reaches."""

    def rows(n, e, r):
        seen = graphs.reach(n, e, r)
        return [(x, x in seen) for x in n]

    return graphs.per_graph(_groups(spark, d), rows, "node_id string, reached boolean")


@register("g4_components", f"WITH RECURSIVE {_GRAPHS}, bo AS (SELECT record_id, section_no, unit_no, group_no, a, b FROM ok UNION SELECT record_id, section_no, unit_no, group_no, b, a FROM ok), rr(record_id, section_no, unit_no, group_no, id, s) AS (SELECT record_id, section_no, unit_no, group_no, id, id FROM n UNION SELECT r.record_id, r.section_no, r.unit_no, r.group_no, bo.b, r.s FROM rr r JOIN bo ON (bo.record_id, bo.section_no, bo.unit_no, bo.group_no, bo.a) = (r.record_id, r.section_no, r.unit_no, r.group_no, r.id)) SELECT CAST(r.record_id AS VARCHAR) AS record_id, CAST(r.section_no AS INTEGER) AS section_no, CAST(r.unit_no AS INTEGER) AS unit_no, CAST(r.group_no AS INTEGER) AS group_no, r.id AS node_id, arg_min(r.s, n.i) AS component FROM rr r JOIN n ON (n.record_id, n.section_no, n.unit_no, n.group_no, n.id) = (r.record_id, r.section_no, r.unit_no, r.group_no, r.s) GROUP BY ALL")
def g4_components(spark: SparkSession, d: str) -> DataFrame:
    """Weak components of each dialogue graph, named by their first node."""
    return graphs.per_graph(_groups(spark, d), lambda n, e, r: list(graphs.components(n, e).items()), "node_id string, component string")


@register("g1_simple_diagnostics", f"WITH {_GRAPHS} SELECT {_PLACE}, len(nodes) = 0 AS no_nodes, root_id IS NULL AS root_missing, coalesce(root_id <> '' AND NOT list_contains(list_transform(nodes, lambda x: x.source_id), root_id), false) AS root_not_found, EXISTS (SELECT 1 FROM e WHERE (e.record_id, e.section_no, e.unit_no, e.group_no) = (k.record_id, k.section_no, k.unit_no, k.group_no) AND NOT list_contains(list_transform(k.nodes, lambda x: x.source_id), e.b)) AS dangling_edge FROM k")
def g1_simple_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each graph, as flags (all words are in ``g1_diagnostics``)."""

    def rows(n, e, r):
        found = graphs.diagnostics(n, e, r)
        return [("no nodes" in found, "root missing" in found, "root not found" in found, "dangling edge" in found)]

    return graphs.per_graph(_groups(spark, d), rows, "no_nodes boolean, root_missing boolean, root_not_found boolean, dangling_edge boolean")


@register("g5_conditions")
def g5_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that hold on every way to a node (here the options chosen), and how many ways come in."""

    def rows(nodes, edges, root):
        known = graphs.guards(nodes, edges, root, {n: {n} for n in nodes})
        _, parents = graphs.adjacency(nodes, edges)
        return [(n, " ".join(sorted(known[n])), len(parents[n])) for n in nodes]

    return graphs.per_graph(_groups(spark, d), rows, "node_id string, conditions string, entries int")


@register("g9_bounded_walk")
def g9_bounded_walk(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within three steps of the root, at most 32 over 64 edges, and whether a bound cut the walk."""

    def rows(nodes, edges, root):
        seen, cut = graphs.bounded_walk([root] if root in set(nodes) else [], [(f"{i:04d}", a, b) for i, (a, b) in enumerate(edges) if a in set(nodes) and b in set(nodes)])
        return [(len(seen), cut)]

    return graphs.per_graph(_groups(spark, d), rows, "nodes_seen int, cut boolean")


@register("x7_reading_order")
def x7_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Dialogue nodes depth first from the root, then the rest as they come."""
    return graphs.per_graph(_groups(spark, d), lambda n, e, r: [(x, i) for i, x in enumerate(graphs.walk_order(n, e, r))], "node_id string, place int")


@register("g7_hierarchy", "WITH p AS (SELECT doc_id, string_split(record_key, ':') AS s FROM documents WHERE record_key IS NOT NULL), x AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS depth FROM p) SELECT array_to_string(s[1:depth], ':') AS path, CAST(depth AS INTEGER) AS depth, count(*) AS items, count(CASE WHEN depth = len(s) THEN 1 END) AS direct FROM x GROUP BY 1, 2")
def g7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path prefixes with the number of items under them and directly at them."""
    p = table(spark, d, "documents").where("record_key is not null").select(F.split("record_key", ":").alias("s"))
    x = p.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    return x.groupBy(F.array_join(F.slice("s", F.lit(1), F.col("depth")), ":").alias("path"), "depth").agg(F.count("*").alias("items"), F.count_if(F.col("depth") == F.size("s")).alias("direct"))


@register("g8_property_graph", "WITH t AS (SELECT DISTINCT id, session, campaign FROM turns), m AS (SELECT DISTINCT id, turn FROM chat_messages) SELECT 'node' AS part, 'turn' AS kind, id AS a, NULL AS b, count(*) AS n FROM t GROUP BY id UNION ALL SELECT 'node', 'session', session, NULL, count(*) FROM t WHERE session IS NOT NULL GROUP BY session UNION ALL SELECT 'edge', 'in session', id, session, count(*) FROM t WHERE session IS NOT NULL GROUP BY id, session UNION ALL SELECT 'edge', 'of turn', m.id, t.id, count(*) FROM m JOIN t ON t.id = m.turn GROUP BY m.id, t.id")
def g8_property_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of a property graph over turns, sessions and messages."""
    t = table(spark, d, "turns").select("id", "session", "campaign").distinct()
    m = table(spark, d, "chat_messages").select(F.col("id").alias("m"), "turn").distinct()
    part = lambda df, p, kind, a, b: df.groupBy(F.lit(p).alias("part"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    none, s = F.lit(None).cast("string"), t.where("session is not null")
    return part(t, "node", "turn", F.col("id"), none).unionByName(part(s, "node", "session", F.col("session"), none)).unionByName(part(s, "edge", "in session", F.col("id"), F.col("session"))).unionByName(part(m.join(t, F.col("id") == F.col("turn")), "edge", "of turn", F.col("m"), F.col("id")))


@register("g10_merged_rows", f"{_TWO}, a AS (SELECT query_id, key, rank FROM h WHERE route = 'bm25' AND rank <= 10), b AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h WHERE route = 'sparse' AND rank <= 20 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = h.query_id AND a.key = h.key)) SELECT query_id, key, CAST(rank AS INTEGER) AS rank, 'baseline' AS origin FROM a UNION ALL SELECT b.query_id, key, CAST(coalesce((SELECT max(rank) FROM a WHERE a.query_id = b.query_id), 0) + n AS INTEGER), 'added' FROM b")
def g10_merged_rows(spark: SparkSession, d: str) -> DataFrame:
    """A baseline list first and, behind it with the next ranks, what another list adds."""
    from ..operators import fusion

    h = two_lists(spark, d)
    out = fusion.supplement(h.where("route = 'bm25' and rank <= 10").drop("route"), h.where("route = 'sparse' and rank <= 20").drop("route"), 20)
    return out.select("query_id", "key", "rank", F.when(F.col("part") == "base", "baseline").otherwise("added").alias("origin"))


@register("g11_two_hop_bridge", "WITH a AS (SELECT DISTINCT source AS a, record_key AS m FROM documents WHERE source IS NOT NULL AND record_key IS NOT NULL), b AS (SELECT DISTINCT record_key AS m, lang AS b FROM documents WHERE lang IS NOT NULL AND record_key IS NOT NULL) SELECT a, b, count(*) AS bridges FROM a JOIN b USING (m) GROUP BY a, b")
def g11_two_hop_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of source and language with the number of records that bridge them; edges are made distinct before they meet."""
    x = table(spark, d, "documents").where("record_key is not null")
    a, b = x.where("source is not null").select(F.col("source").alias("a"), "record_key").distinct(), x.where("lang is not null").select(F.col("lang").alias("b"), "record_key").distinct()
    return a.join(b, "record_key").groupBy("a", "b").agg(F.count("*").alias("bridges"))


@register("g12_catalog_order", "WITH o AS (SELECT source, row_number() OVER (ORDER BY target_weight DESC NULLS LAST, source) AS n FROM mix_targets WHERE source IS NOT NULL), l AS (SELECT DISTINCT source, record_key FROM documents WHERE source IS NOT NULL AND record_key IS NOT NULL) SELECT l.source, record_key, CAST(row_number() OVER (PARTITION BY l.source ORDER BY record_key) AS INTEGER) AS listed, CAST(o.n AS INTEGER) AS catalog FROM l LEFT JOIN o USING (source)")
def g12_catalog_order(spark: SparkSession, d: str) -> DataFrame:
    """Listings in the order of an official catalog (here the weights), ties in the order of listing; what the catalog lacks has none."""
    o = table(spark, d, "mix_targets").where("source is not null").select("source", F.row_number().over(Window.orderBy(F.desc_nulls_last("target_weight"), "source")).alias("catalog"))
    l = table(spark, d, "documents").where("source is not null and record_key is not null").select("source", "record_key").distinct()  # noqa: E741
    return l.withColumn("listed", F.row_number().over(Window.partitionBy("source").orderBy("record_key"))).join(F.broadcast(o), "source", "left").select("source", "record_key", "listed", "catalog")


@register("g13_ancestry_check", "WITH t AS (SELECT DISTINCT id, session, sequence, submit_token FROM turns WHERE session IS NOT NULL), p AS (SELECT *, lag(id) OVER (PARTITION BY session ORDER BY id) AS parent FROM t) SELECT p.id, CASE WHEN p.parent IS NULL THEN 'root' WHEN q.id IS NULL THEN 'parent unknown' WHEN q.session <> p.session THEN 'other session' WHEN q.sequence >= p.sequence THEN 'not earlier' ELSE 'fine' END AS state FROM p LEFT JOIN t q ON q.id = p.parent")
def g13_ancestry_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each turn's parent (here the one before by id) is known, of the same session and earlier."""
    t = table(spark, d, "turns").where("session is not null").select("id", "session", "sequence").distinct()
    p = t.withColumn("parent", F.lag("id").over(Window.partitionBy("session").orderBy("id")))
    q = t.select(F.col("id").alias("parent"), F.col("session").alias("s"), F.col("sequence").alias("n"))
    state = F.when(F.col("parent").isNull(), "root").when(F.col("n").isNull(), "parent unknown").when(F.col("s") != F.col("session"), "other session").when(F.col("n") >= F.col("sequence"), "not earlier").otherwise("fine")
    return p.join(q, "parent", "left").select("id", state.alias("state"))


@register("s2_identified_objects", f"WITH {_DETAIL}, al AS (SELECT content_key, body FROM good WHERE n = 1) SELECT content_key, count(*) AS objects FROM (SELECT al.content_key FROM al, json_tree(al.body) j WHERE j.type = 'OBJECT' AND json_type(j.value, '$.component_id') IN ('VARCHAR', 'BIGINT', 'UBIGINT')) GROUP BY content_key")
def s2_identified_objects(spark: SparkSession, d: str) -> DataFrame:
    """How many objects with an identity (component_id) a page holds anywhere, found by a walk of the whole tree."""

    def walk(body: str) -> list[tuple]:
        good, _, parsed = shapes._page(body)
        return [(sum(isinstance(x.get("component_id"), (str, int)) for x in shapes.objects(parsed)),)] if good else []

    rows = table(spark, d, "obc_detail").where("ok and http_status = 200 and content_key is not null and body is not null")
    at = F.struct("content_key", "fetched_at", F.xxhash64("body").alias("tie")).alias("at")
    parsed = markup.per_value(rows.select(at, "body"), "at", "body", walk, "objects long")
    return parsed.groupBy("at.content_key").agg(F.max_by("objects", F.struct("at.fetched_at", "at.tie")).alias("objects")).where("objects > 0")


@register("s6_channel_ancestry", "WITH RECURSIVE c AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 3 END AS parent FROM nation), r(id, up, path, depth) AS (SELECT id, parent, CAST(id AS VARCHAR), 0 FROM c UNION ALL SELECT r.id, c.parent, c.id || '/' || r.path, r.depth + 1 FROM r JOIN c ON c.id = r.up) SELECT id, path, depth FROM r WHERE up IS NULL")
def s6_channel_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """The path of ancestors of every node of a tree (nations in threes here), by a recursive common table."""
    table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.when(F.col("n_nationkey") != 0, F.floor((F.col("n_nationkey") - 1) / 3)).cast("int").alias("parent")).createOrReplaceTempView("_channel_tree")
    return spark.sql("WITH RECURSIVE r(id, up, path, depth) AS (SELECT id, parent, CAST(id AS STRING), 0 FROM _channel_tree UNION ALL SELECT r.id, c.parent, concat(c.id, '/', r.path), r.depth + 1 FROM r JOIN _channel_tree c ON c.id = r.up) SELECT id, path, depth FROM r WHERE up IS NULL")


_LAYOUT = f"""{_DETAIL}, mo AS (SELECT DISTINCT root_id, json_extract_string(v, '$.id') AS id, child FROM detail WHERE a = 'modules'), pl AS (SELECT root_id, json_extract_string(v, '$.id') AS id, min(child) AS placed FROM detail WHERE a = 'module' GROUP BY ALL)"""


@register("x6_layout_partition", f"WITH {_LAYOUT} SELECT coalesce(mo.root_id, pl.root_id) AS root_id, coalesce(mo.id, pl.id) AS id, CASE WHEN mo.id IS NULL AND pl.id IS NOT NULL THEN 'placement without module' WHEN pl.placed IS NULL THEN 'not placed' ELSE regexp_extract(pl.placed, '^(.*)/module/', 1) END AS part FROM (SELECT * FROM mo WHERE id IS NOT NULL) mo FULL JOIN (SELECT * FROM pl WHERE id IS NOT NULL) pl ON mo.root_id = pl.root_id AND mo.id = pl.id GROUP BY ALL")
def x6_layout_partition(spark: SparkSession, d: str) -> DataFrame:
    """Modules by the group of the layout they are placed in, those without a place, and places without a module."""
    n = page_tables(spark, d)
    of = lambda a: n.where(F.col("array_name") == a).select("root_id", F.col("fields")["id"].alias("id"), "pointer").where("id is not null")
    m, p = of("modules").select("root_id", "id", F.lit(1).alias("m")).distinct(), of("module").groupBy("root_id", "id").agg(F.min("pointer").alias("placed"))
    part = F.when(F.col("m").isNull(), "placement without module").when(F.col("placed").isNull(), "not placed").otherwise(F.regexp_extract("placed", "^(.*)/module/", 1))
    return m.join(p, ["root_id", "id"], "full").select("root_id", "id", part.alias("part")).distinct()
