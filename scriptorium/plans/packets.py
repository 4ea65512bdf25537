"""Queries of evidence packets: expansion, staged admission, compaction, routing and churn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import assembly, fusion
from ..session import table
from .registry import register
from .links import _QUOTES, _TEXTS, quotes, unit_texts
from .routes import skip_fit_sql
from .search import _TWO, two_lists

_BM = f"{_TWO}, bm AS (SELECT query_id, key, h.rank, n_chars AS size, record_key, text, source FROM h JOIN documents ON doc_id = key WHERE route = 'bm25')"


def bm25_hits(spark: SparkSession, d: str) -> DataFrame:
    """BM25 hits with size, record, text and source of their documents."""
    n = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), "record_key", "text", "source")
    return two_lists(spark, d).where("route = 'bm25'").drop("route").join(n, "key")


_V1 = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, key, rank, size FROM bm", "12000", "3000", "8")


@register("e4_admission", f"{_BM}, {_V1} SELECT query_id, key, CAST(rank AS INTEGER) AS rank, CAST(size AS BIGINT) AS size, reason = 'admitted' AS admitted, reason FROM o JOIN w USING (query_id, i)")
def e4_admission(spark: SparkSession, d: str) -> DataFrame:
    return assembly.admit(bm25_hits(spark, d), total=12_000, each=3_000, most=8)


_NEIGHBOURS = """sq AS (SELECT doc_id AS key, record_key, lag(doc_id) OVER (PARTITION BY record_key ORDER BY doc_id) AS before, lead(doc_id) OVER (PARTITION BY record_key ORDER BY doc_id) AS after FROM documents WHERE record_key IS NOT NULL),
    ex AS (SELECT query_id, key, min(ord) AS ord, min(rank) AS rank FROM (SELECT query_id, key, 0 AS ord, rank FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, sq.before, 1, rank FROM bm JOIN sq USING (key) WHERE rank <= 10 AND sq.before IS NOT NULL UNION ALL SELECT query_id, sq.after, 1, rank FROM bm JOIN sq USING (key) WHERE rank <= 10 AND sq.after IS NOT NULL) GROUP BY query_id, key)"""


@register("e2_context_expansion", f"{_BM}, {_NEIGHBOURS} SELECT query_id, key, CASE ord WHEN 0 THEN 'direct' ELSE 'neighbour' END AS reason, CAST(rank AS INTEGER) AS anchor_rank FROM ex")
def e2_context_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The ten best hits and the documents next to them in their record, from direct hits only; each with the best anchor."""
    return assembly.expanded(bm25_hits(spark, d).where("rank <= 10"), table(spark, d, "documents").select(F.col("doc_id").alias("key"), "record_key"), "record_key").select("query_id", "key", "reason", "anchor_rank")


_V2 = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ord, rank, key) AS i, key, ord, n_chars AS size FROM ex JOIN documents ON doc_id = key", "6000")


@register("e5_direct_then_context", f"{_BM}, {_NEIGHBOURS}, {_V2} SELECT query_id, key, CASE ord WHEN 0 THEN 'direct' ELSE 'neighbour' END AS stage, reason FROM o JOIN w USING (query_id, i)")
def e5_direct_then_context(spark: SparkSession, d: str) -> DataFrame:
    """Direct hits first, then their context, in one budget; what does not fit is passed over."""
    docs = table(spark, d, "documents")
    x = assembly.expanded(bm25_hits(spark, d).where("rank <= 10"), docs.select(F.col("doc_id").alias("key"), "record_key"), "record_key").join(docs.select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size")), "key")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("reason") != "direct", "anchor_rank", "key"))
    kept = assembly.admit(x.select("query_id", "key", place.alias("rank"), "size"), total=6_000, each=10**9).select("query_id", "key", F.col("reason").alias("r"))
    return x.join(kept, ["query_id", "key"]).select("query_id", "key", F.col("reason").alias("stage"), F.col("r").alias("reason"))


_PARTS = "pt AS (SELECT query_id, key AS anchor, rank, part, length(p[part + 1]) AS size, md5(p[part + 1]) AS body FROM (SELECT query_id, key, rank, p, unnest(range(len(p))) AS part FROM (SELECT query_id, key, rank, string_split(text, chr(10)) AS p FROM bm WHERE rank <= 10)) WHERE p[part + 1] <> ''), ow AS (SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY rank, part) AS n FROM pt)"


@register("e6_footprints", f"{_BM}, {_PARTS} SELECT query_id, anchor, CAST(count(*) AS INTEGER) AS parts, CAST(sum(size) AS BIGINT) AS footprint, CAST(sum(CASE WHEN n = 1 THEN size ELSE 0 END) AS BIGINT) AS marginal FROM ow GROUP BY query_id, anchor")
def e6_footprints(spark: SparkSession, d: str) -> DataFrame:
    """What each anchor holds and what it adds: a part that several anchors hold is charged to the best of them."""
    p = bm25_hits(spark, d).where("rank <= 10").select("query_id", F.col("key").alias("anchor"), "rank", F.posexplode(F.split("text", "\n", -1)).alias("part", "body")).where("body <> ''")
    n = F.row_number().over(Window.partitionBy("query_id", F.md5("body")).orderBy("rank", "part"))
    p = p.withColumn("n", n).withColumn("size", F.length("body"))
    return p.groupBy("query_id", "anchor").agg(F.count("*").cast("int").alias("parts"), F.sum("size").cast("long").alias("footprint"), F.sum(F.when(F.col("n") == 1, F.col("size")).otherwise(0)).cast("long").alias("marginal"))


_STAGED = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part > 0, rank, part) AS i, anchor, part, size FROM ow WHERE n = 1", "4000")


@register("e7_deferred_charge", f"{_BM}, {_PARTS}, {_STAGED} SELECT query_id, anchor, CAST(part AS INTEGER) AS part, CASE WHEN part = 0 THEN 'root' ELSE 'rest' END AS stage, reason FROM o JOIN w USING (query_id, i)")
def e7_deferred_charge(spark: SparkSession, d: str) -> DataFrame:
    """Roots (first parts) are charged first for all anchors, the rest afterwards, in one budget; shared parts are charged once."""
    p = bm25_hits(spark, d).where("rank <= 10").select("query_id", F.col("key").alias("anchor"), "rank", F.posexplode(F.split("text", "\n", -1)).alias("part", "body")).where("body <> ''")
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.md5("body")).orderBy("rank", "part"))).where("n = 1")
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("part") > 0, "rank", "part"))).withColumn("size", F.length("body").cast("long"))
    kept = assembly.admit(p.select("query_id", F.col("place").alias("key"), F.col("place").alias("rank"), "size"), total=4_000, each=10**9).select("query_id", F.col("key").alias("place"), "reason")
    return p.join(kept, ["query_id", "place"]).select("query_id", "anchor", "part", F.when(F.col("part") == 0, "root").otherwise("rest").alias("stage"), "reason")


_SLIM = "sl AS (SELECT query_id, key, rank, size, length(regexp_replace(text, '\\s+', ' ', 'g')) AS slim, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) AS copy FROM bm)"
_BEFORE = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, key, size FROM sl", "8000").replace("o AS (", "o1 AS (").replace(" o ", " o1 ").replace("o.", "o1.").replace("w AS (WITH RECURSIVE w(", "w1 AS (WITH RECURSIVE w(")
_AFTER = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, key, slim AS size FROM sl WHERE copy = 1", "8000").replace("w AS (WITH RECURSIVE w(", "w2 AS (WITH RECURSIVE w(")


@register("e8_compaction", f"{_BM}, {_SLIM}, {_BEFORE}, {_AFTER}, a AS (SELECT query_id, key FROM o1 JOIN w1 USING (query_id, i) WHERE reason = 'admitted'), b AS (SELECT query_id, key FROM o JOIN w2 USING (query_id, i) WHERE reason = 'admitted') SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'refilled' WHEN b.key IS NULL THEN 'released' ELSE 'kept' END AS state FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key")
def e8_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Copies and blanks release budget, which left-out hits refill: what is kept, released and refilled."""
    b = bm25_hits(spark, d)
    slim = b.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", F.md5("text")).orderBy("rank"))).where("copy = 1").select("query_id", "key", "rank", F.length(F.regexp_replace("text", r"\s+", " ")).cast("long").alias("size"))
    admitted = lambda rows, c: assembly.admit(rows, total=8_000, each=10**9).where("admitted").select("query_id", "key", F.lit(1).alias(c))
    both = admitted(b, "a").join(admitted(slim, "b"), ["query_id", "key"], "full")
    return both.select("query_id", "key", F.when(F.col("a").isNull(), "refilled").when(F.col("b").isNull(), "released").otherwise("kept").alias("state"))


_CLEAN = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source IS NULL, source, rank) AS i, key, octet_length(encode(text)) AS size FROM sl9 WHERE copy = 1", "20000")


@register("e9_clean_packet", f"{_BM}, sl9 AS (SELECT *, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY source IS NULL, source, rank) AS copy FROM bm), {_CLEAN} SELECT query_id, key, reason FROM o JOIN w USING (query_id, i) UNION ALL SELECT query_id, key, 'covered' FROM sl9 WHERE copy > 1")
def e9_clean_packet(spark: SparkSession, d: str) -> DataFrame:
    """Fragments by group and rank, covered repeats skipped, admitted while the whole message fits its bytes; one disposition a fragment."""
    order = (F.col("source").isNull(), "source", "rank")
    b = bm25_hits(spark, d).withColumn("copy", F.row_number().over(Window.partitionBy("query_id", F.md5("text")).orderBy(*order)))
    main = b.where("copy = 1").select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"), F.octet_length("text").cast("long").alias("size"))
    return assembly.admit(main, total=20_000, each=10**9).select("query_id", "key", "reason").unionByName(b.where("copy > 1").select("query_id", "key", F.lit("covered").alias("reason")))


_LADDER = [8000 - 2048 * i for i in range(4)]
_CAPS = skip_fit_sql(f"SELECT query_id || ' ' || cap AS query_id, row_number() OVER (PARTITION BY query_id, cap ORDER BY rank) AS i, key, query_id AS q, cap, size FROM bm, (SELECT unnest({_LADDER}) AS cap) WHERE rank > 2", "o.cap")


@register("e10_envelope", f"{_BM}, base AS (SELECT query_id, sum(size) AS used FROM bm WHERE rank <= 2 GROUP BY query_id), {_CAPS}, ad AS (SELECT q AS query_id, cap, sum(size) AS extra, count(*) AS n FROM o JOIN w USING (query_id, i) WHERE reason = 'admitted' GROUP BY ALL), ok AS (SELECT b.query_id, max(cap) AS cap FROM base b JOIN ad USING (query_id) WHERE used + extra + 100 * (n + 2) <= 9000 GROUP BY b.query_id) SELECT b.query_id, CAST(used AS BIGINT) AS baseline_chars, CAST(coalesce(ad.cap, 0) AS INTEGER) AS cap, CAST(coalesce(ad.extra, 0) AS BIGINT) AS extra_chars FROM base b LEFT JOIN ok USING (query_id) LEFT JOIN ad ON ad.query_id = ok.query_id AND ad.cap = ok.cap")
def e10_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The two best hits are never displaced; the room for others shrinks by 2,048 characters until packet and envelope (100 a part) fit 9,000."""
    b = bm25_hits(spark, d).select("query_id", "key", "rank", F.col("size").cast("long").alias("size"))
    base = b.where("rank <= 2").groupBy("query_id").agg(F.sum("size").alias("used"))
    tries = [assembly.admit(b.where("rank > 2"), total=cap, each=10**9).where("admitted").groupBy("query_id").agg(F.sum("size").alias("extra"), F.count("*").alias("n")).withColumn("cap", F.lit(cap)) for cap in _LADDER]
    fits = reduce(DataFrame.unionByName, tries).join(base, "query_id").where(F.col("used") + F.col("extra") + 100 * (F.col("n") + 2) <= 9000)
    best = fits.groupBy("query_id").agg(F.max(F.struct("cap", "extra")).alias("x"))
    return base.join(best, "query_id", "left").select("query_id", F.col("used").alias("baseline_chars"), F.coalesce("x.cap", F.lit(0)).alias("cap"), F.coalesce("x.extra", F.lit(0).cast("long")).alias("extra_chars"))


@register("e11_read_receipts", f"WITH {_QUOTES}, {_TEXTS}, s AS (SELECT 'quote' AS scope, evidence_id AS id, unit_id AS origin, length(text) AS chars FROM q UNION ALL SELECT 'unit', unit_id, record_id, length(t) FROM u WHERE unit_id IN (SELECT unit_id FROM q) UNION ALL SELECT 'record', record_id, NULL, sum(length(t)) FROM u WHERE record_id IN (SELECT record_id FROM u WHERE unit_id IN (SELECT unit_id FROM q)) GROUP BY record_id) SELECT scope, id, origin, CAST(chars AS BIGINT) AS chars FROM s WHERE id IS NOT NULL")
def e11_read_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of what was read at three scopes, each with the origin it closes over: quote, unit and whole record."""
    q, u = quotes(spark, d), unit_texts(spark, d)
    read = u.join(q.select("unit_id").distinct(), "unit_id", "left_semi")
    whole = u.join(read.where("record_id is not null").select("record_id").distinct(), "record_id", "left_semi").groupBy("record_id").agg(F.sum(F.length("t")).alias("chars"))
    row = lambda df, scope, i, origin, chars: df.select(F.lit(scope).alias("scope"), i.alias("id"), origin.alias("origin"), chars.cast("long").alias("chars"))
    out = row(q, "quote", F.col("evidence_id"), F.col("unit_id"), F.length("text")).unionByName(row(read, "unit", F.col("unit_id"), F.col("record_id"), F.length("t")))
    return out.unionByName(row(whole, "record", F.col("record_id"), F.lit(None).cast("string"), F.col("chars"))).where("id is not null")


@register("x2_repeat_stability", f"{_TWO}, a AS (SELECT query_id, key FROM h WHERE route = 'bm25' AND rank <= 20), b AS (SELECT query_id, key FROM h WHERE route = 'sparse' AND rank <= 20), n AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) AS u, count(CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 1 END) AS c FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key GROUP BY 1) SELECT query_id, round(c / greatest(u, 1), 6) AS stability FROM n")
def x2_repeat_stability(spark: SparkSession, d: str) -> DataFrame:
    """The share of the twenty best that two profiles have in common."""
    h = two_lists(spark, d).where("rank <= 20").groupBy("query_id", "key").agg(F.count("*").alias("n"))
    return h.groupBy("query_id").agg(F.round(F.count_if(F.col("n") == 2) / F.greatest(F.count("*"), F.lit(1)), 6).alias("stability"))


@register("x3_two_hop_bridge", f"{_BM}, m AS (SELECT query_id, record_key, rank FROM bm WHERE rank <= 2 AND record_key IS NOT NULL), t AS (SELECT m.query_id, d.doc_id AS key, m.rank AS hop, row_number() OVER (PARTITION BY m.query_id, m.rank ORDER BY d.doc_id) AS rank FROM m JOIN documents d USING (record_key)), al AS (SELECT query_id, key, rank FROM bm UNION ALL SELECT query_id, key, rank FROM t WHERE rank <= 20), fz AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM al GROUP BY ALL), o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fz) SELECT query_id, key, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM o2")
def x3_two_hop_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The records of the two best hits are gone through in turn (20 documents each), and all rankings are fused."""
    b = bm25_hits(spark, d)
    m = b.where("rank <= 2 and record_key is not null").select("query_id", "record_key", F.col("rank").alias("hop"))
    t = m.join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "record_key"), "record_key").withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "hop").orderBy("key"))).where("rank <= 20")
    return fusion.rrf(b.select("query_id", "key", "rank").unionByName(t.select("query_id", "key", "rank"))).withColumn("score", F.round("score", 9))


_ROLES = "ro AS (SELECT * FROM (VALUES ('causal', 'wiki_page'), ('causal', 'book_text'), ('attribution', 'voice_lines'), ('attribution', 'wiki_page')) v(need, supply))"


@register("x4_role_routing", f"{_BM}, {_ROLES}, ok AS (SELECT bm.query_id, key, rank FROM bm JOIN eval_items e ON e.item_id = query_id WHERE e.track NOT IN (SELECT need FROM ro) OR EXISTS (SELECT 1 FROM ro WHERE need = e.track AND supply = source)), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ok) SELECT query_id, key, CAST(place AS INTEGER) AS place FROM t WHERE place <= 10")
def x4_role_routing(spark: SparkSession, d: str) -> DataFrame:
    """A map of needs to supplies admits hits before the ten best are cut; tracks without an entry admit all."""
    roles = spark.createDataFrame([("causal", "wiki_page"), ("causal", "book_text"), ("attribution", "voice_lines"), ("attribution", "wiki_page")], "need string, supply string")
    supplies = roles.groupBy("need").agg(F.collect_set("supply").alias("supplies"))
    e = table(spark, d, "eval_items").where("track is not null").select(F.col("item_id").alias("query_id"), "track")
    j = bm25_hits(spark, d).join(e, "query_id").join(F.broadcast(supplies), F.col("track") == F.col("need"), "left").where(F.col("need").isNull() | F.coalesce(F.array_contains("supplies", F.col("source")), F.lit(False)))
    return j.select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place")).where("place <= 10")


_CLASSES = "SELECT query_id, key, rank, CASE WHEN source = 'quest_transcript' THEN 0 WHEN source = 'voice_lines' THEN 1 WHEN source = 'book_text' THEN 2 WHEN source = 'wiki_page' THEN 3 WHEN source IS NULL THEN 5 ELSE 4 END AS class, size FROM bm"
_PRIORITY = skip_fit_sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY class, rank) AS i, key, rank, class, size FROM cl", "8000")


@register("x8_prioritised_admission", f"{_BM}, cl AS ({_CLASSES}), {_PRIORITY} SELECT query_id, key, CAST(class AS INTEGER) AS class, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM o JOIN w USING (query_id, i) WHERE reason = 'admitted'")
def x8_prioritised_admission(spark: SparkSession, d: str) -> DataFrame:
    """Admission by class of source and then rank within 8,000 characters; what is admitted is put back into the order of retrieval."""
    c = F.col("source")
    klass = F.when(c == "quest_transcript", 0).when(c == "voice_lines", 1).when(c == "book_text", 2).when(c == "wiki_page", 3).when(c.isNull(), 5).otherwise(4)
    b = bm25_hits(spark, d).withColumn("class", klass)
    b = b.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("class", "rank")))
    kept = assembly.admit(b.select("query_id", "key", F.col("place").alias("rank"), F.col("size").cast("long").alias("size")), total=8_000, each=10**9).where("admitted").select("query_id", "key")
    return b.join(kept, ["query_id", "key"]).select("query_id", "key", "class", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place"))


@register("x13_card_hierarchy", f"WITH {_QUOTES}, {_TEXTS}, c AS (SELECT DISTINCT case_id, source_id, unnest(quotes) AS q FROM card_semantic_cases), e AS (SELECT source_id, q.section AS section, count(DISTINCT case_id) AS cases, array_to_string(list_sort(list(DISTINCT q.evidence_id)), ' ') AS evidence, count(DISTINCT q.unit_id) AS units FROM c WHERE q IS NOT NULL GROUP BY ALL), n AS (SELECT record_id AS source_id, count(*) AS all_units, count(CASE WHEN unit_id NOT IN (SELECT unit_id FROM q WHERE unit_id IS NOT NULL) THEN 1 END) AS unread FROM u GROUP BY record_id) SELECT e.*, n.unread FROM e LEFT JOIN n USING (source_id)")
def x13_card_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Sources, their sections and what the cases of each cite, with the number of units of the source that nobody cites."""
    c = table(spark, d, "card_semantic_cases").select("case_id", "source_id", F.explode("quotes").alias("q")).where("q is not null").distinct()
    e = c.groupBy("source_id", F.col("q.section").alias("section")).agg(F.countDistinct("case_id").alias("cases"), F.array_join(F.sort_array(F.collect_set("q.evidence_id")), " ").alias("evidence"), F.countDistinct("q.unit_id").alias("units"))
    cited = quotes(spark, d).where("unit_id is not null").select("unit_id").distinct().withColumn("cited", F.lit(1))
    n = unit_texts(spark, d).join(cited, "unit_id", "left").groupBy(F.col("record_id").alias("source_id")).agg(F.count_if(F.col("cited").isNull()).alias("unread"))
    return e.join(n, "source_id", "left")


@register("x14_complete_revisions", "WITH r AS (SELECT record_id, built_at, any_value(status) AS status, bool_and(sections IS NOT NULL AND len(sections) > 0) AS filled FROM canonical_records WHERE record_id IS NOT NULL GROUP BY record_id, built_at), l AS (SELECT record_id, max(built_at) AS newest, max(CASE WHEN status = 'canonical' AND filled THEN built_at END) AS whole FROM r GROUP BY record_id) SELECT record_id, whole AS chosen, CASE WHEN whole IS NULL THEN 'no whole revision' WHEN whole < newest THEN 'older one chosen' ELSE 'newest' END AS reason FROM l")
def x14_complete_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The newest complete revision of each record, and why if it is not the newest of all."""
    filled = F.coalesce(F.size("sections") > 0, F.lit(False))
    r = table(spark, d, "canonical_records").where("record_id is not null").groupBy("record_id", "built_at").agg(F.first("status").alias("status"), F.min(filled).alias("filled"))
    l = r.groupBy("record_id").agg(F.max("built_at").alias("newest"), F.max(F.when((F.col("status") == "canonical") & F.col("filled"), F.col("built_at"))).alias("whole"))  # noqa: E741
    return l.select("record_id", F.col("whole").alias("chosen"), F.when(F.col("whole").isNull(), "no whole revision").when(F.col("whole") < F.col("newest"), "older one chosen").otherwise("newest").alias("reason"))


@register("x15_quote_routes", f"WITH {_QUOTES}, {_TEXTS}, j AS (SELECT evidence_id, t, text, ru_start FROM q JOIN u USING (unit_id) WHERE text <> '' AND t IS NOT NULL), n AS (SELECT evidence_id, t, text, ru_start, list_filter(range(greatest(length(t) - length(text) + 1, 0)), lambda i: substr(t, i + 1, length(text)) = text) AS places FROM j) SELECT evidence_id, array_to_string(list_transform(places, lambda x: CAST(x AS VARCHAR)), ' ') AS offsets, CASE WHEN len(places) = 0 THEN 'absent' WHEN list_contains(places, ru_start) THEN 'bound' WHEN len(places) = 1 THEN 'moved' ELSE 'ambiguous' END AS route FROM n")
def x15_quote_routes(spark: SparkSession, d: str) -> DataFrame:
    """All places at which a quote stands in its unit, and the repair it needs: none, moved, ambiguous or absent."""
    j = quotes(spark, d).join(unit_texts(spark, d), "unit_id").where("text <> '' and t is not null")
    room = F.length("t") - F.length("text")
    at = F.when(room >= 0, F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), lambda i: F.substring(F.col("t"), i + 1, F.length("text")) == F.col("text"))).otherwise(F.array().cast("array<int>"))
    x = j.withColumn("at", F.when(F.col("t").contains(F.col("text")), at).otherwise(F.array().cast("array<int>")))
    route = F.when(F.size("at") == 0, "absent").when(F.coalesce(F.array_contains("at", F.col("ru_start")), F.lit(False)), "bound").when(F.size("at") == 1, "moved").otherwise("ambiguous")
    return x.select("evidence_id", F.array_join(F.col("at").cast("array<string>"), " ").alias("offsets"), route.alias("route"))


_QUEUE = "dd AS (SELECT doc_id, text, record_key, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN record_key IS NULL THEN 'no entity' WHEN n_chars < 120 THEN 'short' ELSE 'eligible' END AS disposition FROM documents), fam AS (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS representative, row_number() OVER (PARTITION BY record_key, disposition ORDER BY doc_id) - 1 AS i FROM dd WHERE disposition = 'eligible')"


@register("x16_structural_queue", f"WITH {_QUEUE} SELECT doc_id, representative, CASE WHEN representative <> doc_id THEN 'copy' WHEN i % 2 = 0 THEN 'first queue' WHEN CAST('0x' || substr(sha256('queue:' || doc_id), 1, 2) AS INTEGER) % 2 = 0 THEN 'control' ELSE 'semantic' END AS queue FROM fam")
def x16_structural_queue(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive dispositions, families of equal texts, representatives, and queues by parity of place and of hash."""
    t = F.col("text")
    disposition = F.when(t.isNull() | (F.trim(t) == ""), "empty").when(F.col("record_key").isNull(), "no entity").when(F.col("n_chars") < 120, "short").otherwise("eligible")
    e = table(spark, d, "documents").where(disposition == "eligible").select("doc_id", "record_key", F.md5("text").alias("h"))
    least = e.groupBy("h").agg(F.min("doc_id").alias("representative"))
    e = e.join(least, "h").withColumn("i", F.row_number().over(Window.partitionBy("record_key").orderBy("doc_id")) - 1)
    parity = F.conv(F.substring(F.sha2(F.concat(F.lit("queue:"), F.col("doc_id").cast("string")), 256), 1, 2), 16, 10).cast("int") % 2
    queue = F.when(F.col("representative") != F.col("doc_id"), "copy").when(F.col("i") % 2 == 0, "first queue").when(parity == 0, "control").otherwise("semantic")
    return e.select("doc_id", "representative", queue.alias("queue"))


@register("x20_novelty_ladder", f"{_TWO}, dn AS (SELECT * FROM h WHERE route = 'sparse' AND rank <= 20), x AS (SELECT dn.query_id, dn.key, CASE WHEN d.record_key IS NULL THEN 'unresolved' WHEN EXISTS (SELECT 1 FROM h b WHERE b.route = 'bm25' AND b.query_id = dn.query_id AND b.key = dn.key) THEN 'in baseline' WHEN d.n_chars > 3000 THEN 'too large' WHEN dn.rank > 10 THEN 'not visible' ELSE 'novel' END AS step FROM dn JOIN documents d ON d.doc_id = dn.key) SELECT step, count(*) AS n, count(DISTINCT query_id) AS queries FROM x GROUP BY step")
def x20_novelty_ladder(spark: SparkSession, d: str) -> DataFrame:
    """What a second channel brings, by the first step of a ladder at which it fails: resolved, novel, admitted, visible."""
    h = two_lists(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "record_key", "n_chars")
    base = h.where("route = 'bm25'").select("query_id", "key", F.lit(1).alias("b"))
    x = h.where("route = 'sparse' and rank <= 20").join(docs, "key").join(base, ["query_id", "key"], "left")
    step = F.when(F.col("record_key").isNull(), "unresolved").when(F.col("b").isNotNull(), "in baseline").when(F.col("n_chars") > 3000, "too large").when(F.col("rank") > 10, "not visible").otherwise("novel")
    return x.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@register("x23_packet_churn", f"{_TWO}, s AS (SELECT query_id, key, max(CASE WHEN route = 'bm25' THEN 1 ELSE 0 END) AS a, max(CASE WHEN route = 'sparse' THEN 1 ELSE 0 END) AS b, any_value(n_chars) AS size FROM h JOIN documents ON doc_id = key WHERE rank <= 20 GROUP BY query_id, key) SELECT query_id, CAST(sum(a * b) AS BIGINT) AS overlap, CAST(sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS displaced, CAST(sum((b - a) * size) AS BIGINT) AS chars_delta FROM s GROUP BY query_id")
def x23_packet_churn(spark: SparkSession, d: str) -> DataFrame:
    """From one packet of twenty to another: what stays, what is displaced, and the change in characters."""
    n = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"))
    in_ = lambda r: F.max((F.col("route") == r).cast("int"))
    s = two_lists(spark, d).where("rank <= 20").join(n, "key").groupBy("query_id", "key").agg(in_("bm25").alias("a"), in_("sparse").alias("b"), F.first("size").alias("size"))
    return s.groupBy("query_id").agg(F.sum(F.expr("a * b")).alias("overlap"), F.sum(F.expr("case when a = 1 and b = 0 then 1 else 0 end")).cast("long").alias("displaced"), F.sum(F.expr("(b - a) * size")).alias("chars_delta"))
