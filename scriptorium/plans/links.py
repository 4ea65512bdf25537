"""Queries of contract joins, reconstructions and bindings between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import intervals, search
from ..session import table
from .registry import register
from .search import _DENSE, _TWO, two_lists

_QUOTES = "q AS (SELECT DISTINCT evidence_id, unit_id, canonical_sha256, ru_start, ru_end, text, kind, section FROM (SELECT unnest(quotes, recursive := true) FROM card_semantic_cases))"
_TEXTS = "u AS (SELECT unit_id, min(retrieval_visible_text) AS t, min(source.canonical_address.canonical_unit_kind) AS ukind, min(source.canonical_address.section_ordinal) AS usection, min(source.canonical_address.record_id) AS record_id FROM p05_story_rus WHERE unit_id IS NOT NULL GROUP BY unit_id)"


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "card_semantic_cases").select(F.explode("quotes").alias("q")).select("q.*").distinct()


def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """One row a unit (unit_id, t, ukind, usection, record_id), re-deliveries counted once."""
    a = F.col("source.canonical_address")
    low = lambda c, n: F.min(c).alias(n)
    return table(spark, d, "p05_story_rus").where("unit_id is not null").groupBy("unit_id").agg(low("retrieval_visible_text", "t"), low(a["canonical_unit_kind"], "ukind"), low(a["section_ordinal"], "usection"), low(a["record_id"], "record_id"))


@register("j2_parent_join", f"WITH {_QUOTES}, {_TEXTS} SELECT evidence_id, unit_id, CASE WHEN u.t IS NULL AND u.ukind IS NULL AND u.record_id IS NULL THEN 'no parent' WHEN q.kind IS DISTINCT FROM ukind THEN 'kind differs' WHEN q.section IS DISTINCT FROM usection THEN 'section differs' ELSE 'same' END AS state FROM q LEFT JOIN u USING (unit_id)")
def j2_parent_join(spark: SparkSession, d: str) -> DataFrame:
    """Quotes and their parent units, with whether the identity of both agrees."""
    j = quotes(spark, d).join(unit_texts(spark, d), "unit_id", "left")
    gone = F.col("t").isNull() & F.col("ukind").isNull() & F.col("record_id").isNull()
    state = F.when(gone, "no parent").when(~F.col("kind").eqNullSafe(F.col("ukind")), "kind differs").when(~F.col("section").eqNullSafe(F.col("usection")), "section differs").otherwise("same")
    return j.select("evidence_id", "unit_id", state.alias("state"))


@register("j3_digest_join", f"WITH {_QUOTES}, {_TEXTS} SELECT CASE WHEN q.canonical_sha256 IS NULL THEN 'unknown' WHEN q.canonical_sha256 = sha256(u.t) THEN 'text' WHEN q.canonical_sha256 = sha256(q.text) THEN 'quote' ELSE 'other' END AS digest_of, count(*) AS n FROM q JOIN u USING (unit_id) GROUP BY 1")
def j3_digest_join(spark: SparkSession, d: str) -> DataFrame:
    """What the digest that a quote carries is the digest of."""
    j = quotes(spark, d).join(unit_texts(spark, d), "unit_id")
    h = F.col("canonical_sha256")
    return j.groupBy(F.when(h.isNull(), "unknown").when(h == F.sha2("t", 256), "text").when(h == F.sha2("text", 256), "quote").otherwise("other").alias("digest_of")).agg(F.count("*").alias("n"))


@register("j4_both_arms", f"{_TWO}, a AS (SELECT * FROM h WHERE route = 'bm25'), b AS (SELECT * FROM h WHERE route = 'sparse') SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.key, b.key) AS key, CAST(a.rank AS INTEGER) AS lexical_rank, CAST(b.rank AS INTEGER) AS sparse_rank FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key")
def j4_both_arms(spark: SparkSession, d: str) -> DataFrame:
    """Hits of two arms side by side; a hit of one arm only has no rank in the other."""
    at = lambda r: F.max(F.when(F.col("route") == r, F.col("rank")))
    return two_lists(spark, d).groupBy("query_id", "key").agg(at("bm25").alias("lexical_rank"), at("sparse").alias("sparse_rank"))


@register("j5_rankings_bind", f"{_TWO}, a AS (SELECT query_id, key, rank FROM h WHERE route = 'bm25'), b AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY key) + CASE WHEN query_id % 5 = 0 THEN 1 ELSE 0 END AS rank FROM a WHERE query_id % 3 <> 0 OR rank <> 2), n AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, count(a.key) AS left_n, count(b.key) AS right_n, count(CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 1 END) AS common, min(b.rank) AS lo, max(b.rank) AS hi, count(DISTINCT b.rank) AS ranks FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key GROUP BY 1) SELECT query_id, CASE WHEN common <> left_n OR common <> right_n THEN 'keys differ' WHEN lo <> 1 OR hi <> right_n OR ranks <> right_n THEN 'ranks not 1 to n' ELSE 'bound' END AS state FROM n")
def j5_rankings_bind(spark: SparkSession, d: str) -> DataFrame:
    """Whether a second ranking holds exactly the keys of the first, ranked 1 to n; some second rankings are given a flaw here."""
    a = two_lists(spark, d).where("route = 'bm25'").select("query_id", "key", "rank")
    b = a.where("query_id % 3 <> 0 or rank <> 2").select("query_id", "key", (F.row_number().over(Window.partitionBy("query_id").orderBy("key")) + F.when(F.col("query_id") % 5 == 0, 1).otherwise(0)).alias("rank"))
    return search.bound_rankings(a, b)


_CASES = "c AS (SELECT DISTINCT case_id, q.unit_id, q.ru_start AS s, q.ru_end AS e FROM (SELECT case_id, unnest(quotes) AS q FROM card_semantic_cases) WHERE q.ru_end > q.ru_start AND q.unit_id IS NOT NULL)"


@register(
    "j8_shared_length",
    f"""WITH {_CASES}, x AS (SELECT a.case_id AS a, b.case_id AS b, a.unit_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM c a JOIN c b ON a.unit_id = b.unit_id AND a.case_id < b.case_id AND a.s < b.e AND b.s < a.e),
    p AS (SELECT DISTINCT a, b, unit_id, unnest(range(s, e)) AS i FROM x) SELECT a, b, count(*) AS shared FROM p GROUP BY a, b""",
)
def j8_shared_length(spark: SparkSession, d: str) -> DataFrame:
    """Characters that the quotes of two cases share, each counted once: pairwise intersections, merged."""
    c = table(spark, d, "card_semantic_cases").select("case_id", F.explode("quotes").alias("q")).select("case_id", "q.unit_id", F.col("q.ru_start").alias("start"), F.col("q.ru_end").alias("end")).where("end > start and unit_id is not null").distinct()
    return intervals.shared_length(c, ["unit_id"], "case_id", cell=64)


@register("j11_others_only", f"WITH {_DENSE}, l AS (SELECT d.query_id, d.vec_id, d.score FROM dense d JOIN embeddings a ON a.vec_id = d.vec_id JOIN embeddings b ON b.vec_id = d.query_id WHERE a.label <> b.label), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM l) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10")
def j11_others_only(spark: SparkSession, d: str) -> DataFrame:
    """The best hits outside the query's own group, the group being left out before the cut at k."""
    v = table(spark, d, "embeddings")
    return search.dense_top_k(v, v.where("vec_id % 100 = 0"), 10, exclude="label")


@register("j14_rebuilt_spans", 'WITH f AS (SELECT doc_id, i, substr(text, i * 300 + 1, 300) AS part, i * 300 AS s, least(i * 300 + 300, length(text)) AS e FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 300) AS BIGINT))) AS i FROM documents WHERE text <> \'\')), b AS (SELECT doc_id, string_agg(part, \'\' ORDER BY i) AS whole FROM f GROUP BY doc_id), w AS (SELECT doc_id, 250 AS s, 650 AS e FROM b WHERE length(whole) >= 650) SELECT f.doc_id, b.whole = d.text AS rebuilt, CAST(f.i AS INTEGER) AS fragment, CAST(least(f.e, w.e) - greatest(f.s, w.s) AS INTEGER) AS overlap FROM f JOIN w ON f.doc_id = w.doc_id AND f.s < w.e AND w.s < f.e JOIN b ON b.doc_id = f.doc_id JOIN documents d ON d.doc_id = f.doc_id')
def j14_rebuilt_spans(spark: SparkSession, d: str) -> DataFrame:
    """Fragments put together again must give the text; a span of the text (here 250 to 650) names the fragments it lies in."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    f = docs.select("doc_id", F.explode(T.fragments(F.col("text"), 300)).alias("f")).select("doc_id", F.col("f.index").alias("fragment"), F.col("f.start").alias("s"), F.col("f.text").alias("part"))
    whole = f.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fragment", "part"))), lambda x: x["part"]), "").alias("whole"))
    w = whole.join(docs, "doc_id").where(F.length("whole") >= 650).select("doc_id", (F.col("whole") == F.col("text")).alias("rebuilt"))
    overlap = F.least(F.col("s") + F.length("part"), F.lit(650)) - F.greatest("s", F.lit(250))
    return f.join(w, "doc_id").where(overlap > 0).select("doc_id", "rebuilt", "fragment", overlap.alias("overlap"))


_BANDS = "b AS (SELECT * FROM (VALUES ('low', 0.0, 20.0), ('middle', 10.0, 60.0), ('high', 50.0, 1e9)) v(band, lo, hi))"


@register("j15_band_join", f"WITH {_BANDS} SELECT event_type, band, count(*) AS n FROM events JOIN b ON value >= lo AND value < hi GROUP BY ALL")
def j15_band_join(spark: SparkSession, d: str) -> DataFrame:
    """A join by inequality only, against a table of three rows: each event with all bands that hold its value."""
    bands = spark.createDataFrame([("low", 0.0, 20.0), ("middle", 10.0, 60.0), ("high", 50.0, 1e9)], "band string, lo double, hi double")
    return table(spark, d, "events").join(F.broadcast(bands), F.expr("value >= lo and value < hi")).groupBy("event_type", "band").agg(F.count("*").alias("n"))


@register("v1_record_problems", """
    WITH r AS (SELECT * FROM canonical_records WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY built_at DESC NULLS LAST) = 1),
    s AS (SELECT record_id, unnest(sections) AS s FROM r), u AS (SELECT record_id, s.ordinal AS section, unnest(s.units) AS u FROM s), c AS (SELECT record_id, s.ordinal AS section, unnest(s.component_contexts) AS c FROM s),
    k AS (SELECT record_id, section, c.observation_key AS key, unnest(c.child_unit_ordinals) AS o FROM c WHERE c IS NOT NULL)
    SELECT record_id, 'section without ordinal' AS problem, count(*) AS n FROM s WHERE s.ordinal IS NULL GROUP BY record_id
    UNION ALL SELECT record_id, 'repeated unit', sum(m - 1)::BIGINT FROM (SELECT record_id, u.unit_id, count(*) AS m FROM u WHERE u.unit_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY record_id
    UNION ALL SELECT record_id, 'unit without kind', count(*) FROM u WHERE u IS NOT NULL AND u.kind IS NULL GROUP BY record_id
    UNION ALL SELECT record_id, 'missing child', count(*) FROM k WHERE o IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.record_id = k.record_id AND u.section IS NOT DISTINCT FROM k.section AND u.u.ordinal = k.o) GROUP BY record_id
    UNION ALL SELECT record_id, 'count differs', count(*) FROM c WHERE c IS NOT NULL AND c.unit_count IS DISTINCT FROM len(c.child_unit_ordinals) GROUP BY record_id
""")
def v1_record_problems(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of the latest build of each record, with the number of rows that break them."""
    c = table(spark, d, "canonical_records").where("record_id is not null")
    s = c.groupBy("record_id").agg(F.max_by("sections", F.coalesce(F.col("built_at"), F.lit("0001-01-01").cast("timestamp"))).alias("s")).select("record_id", F.explode("s").alias("s"))
    u = s.select("record_id", F.col("s.ordinal").alias("section"), F.explode("s.units").alias("u"))
    k = s.select("record_id", F.col("s.ordinal").alias("section"), F.explode("s.component_contexts").alias("c")).where("c is not null")
    count = lambda rows, word: rows.groupBy("record_id").agg(F.lit(word).alias("problem"), F.count("*").alias("n"))
    again = u.where("u.unit_id is not null").groupBy("record_id", "u.unit_id").agg((F.count("*") - 1).alias("m")).where("m > 0").groupBy("record_id").agg(F.lit("repeated unit").alias("problem"), F.sum("m").alias("n"))
    child = k.select("record_id", "section", F.explode("c.child_unit_ordinals").alias("o")).where("o is not null")
    known = u.select(F.col("record_id").alias("r"), F.col("section").alias("z"), F.col("u.ordinal").alias("p")).distinct()
    lost = child.join(known, (F.col("record_id") == F.col("r")) & F.col("section").eqNullSafe(F.col("z")) & (F.col("o") == F.col("p")), "left_anti")
    size = F.when(F.col("c.child_unit_ordinals").isNotNull(), F.size("c.child_unit_ordinals"))
    parts = [count(s.where("s.ordinal is null"), "section without ordinal"), again, count(u.where("u is not null and u.kind is null"), "unit without kind"), count(lost, "missing child"), count(k.where(~F.col("c.unit_count").eqNullSafe(size)), "count differs")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("v2_resolved_ranges", f"WITH {_QUOTES}, {_TEXTS} SELECT evidence_id, CAST(f AS INTEGER) AS fragment, substr(t, CAST(greatest(ru_start, f * 100) AS BIGINT) + 1, CAST(least(ru_end, f * 100 + 100) - greatest(ru_start, f * 100) AS BIGINT)) AS piece FROM (SELECT evidence_id, t, ru_start, ru_end, unnest(range(ru_start // 100, (ru_end - 1) // 100 + 1)) AS f FROM q JOIN u USING (unit_id) WHERE t IS NOT NULL AND ru_start >= 0 AND ru_end > ru_start AND ru_end <= length(t))")
def v2_resolved_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range of a unit resolved to the stored fragments (of 100 characters) that it covers, with the piece of each."""
    j = quotes(spark, d).join(unit_texts(spark, d), "unit_id").where(F.expr("t is not null and ru_start >= 0 and ru_end > ru_start and ru_end <= length(t)"))
    x = j.select("evidence_id", "t", "ru_start", "ru_end", F.explode(F.sequence(F.floor(F.col("ru_start") / 100), F.floor((F.col("ru_end") - 1) / 100))).alias("f"))
    lo, hi = F.greatest("ru_start", F.col("f") * 100), F.least("ru_end", F.col("f") * 100 + 100)
    return x.select("evidence_id", F.col("f").cast("int").alias("fragment"), F.substring(F.col("t"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


@register("v4_representation_ids", "WITH g AS (SELECT DISTINCT coalesce(source, '-') AS source, CASE WHEN n_chars < 700 THEN 'micro' ELSE 'macro' END AS granularity FROM documents), k AS (SELECT unnest(['bm25f', 'dense', 'sparse']) AS kind) SELECT source, granularity, kind, sha256(to_json({'bundle': source, 'config': 'v1', 'granularity': granularity, 'kind': kind})) AS representation_id FROM g, k")
def v4_representation_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identities of representations: the digest of what they are made from, in the order of the keys."""
    g = table(spark, d, "documents").select(F.coalesce("source", F.lit("-")).alias("source"), F.when(F.col("n_chars") < 700, "micro").otherwise("macro").alias("granularity")).distinct()
    x = g.withColumn("kind", F.explode(F.array(*map(F.lit, ("bm25f", "dense", "sparse")))))
    return x.withColumn("representation_id", F.sha2(F.to_json(F.struct(F.col("source").alias("bundle"), F.lit("v1").alias("config"), "granularity", "kind")), 256))


@register("v6_unresolved_gold", f"WITH {_QUOTES}, {_TEXTS} SELECT evidence_id, CASE WHEN unit_id IS NULL THEN 'no location' WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.unit_id = q.unit_id) THEN 'no unit' WHEN ru_start IS NULL OR ru_end IS NULL THEN 'no range' WHEN (SELECT ru_end > length(t) FROM u WHERE u.unit_id = q.unit_id) THEN 'out of range' END AS problem FROM q WHERE unit_id IS NULL OR NOT EXISTS (SELECT 1 FROM u WHERE u.unit_id = q.unit_id) OR ru_start IS NULL OR ru_end IS NULL OR (SELECT ru_end > length(t) FROM u WHERE u.unit_id = q.unit_id)")
def v6_unresolved_gold(spark: SparkSession, d: str) -> DataFrame:
    """Locations that do not resolve, with what is missing."""
    u = unit_texts(spark, d).withColumn("known", F.lit(True))
    j = quotes(spark, d).join(u, "unit_id", "left")
    word = F.when(F.col("unit_id").isNull(), "no location").when(F.col("known").isNull(), "no unit").when(F.col("ru_start").isNull() | F.col("ru_end").isNull(), "no range").when(F.col("ru_end") > F.length("t"), "out of range")
    return j.select("evidence_id", word.alias("problem")).where("problem is not null")


@register("v8_binding_ledger", f"WITH {_QUOTES}, {_TEXTS} SELECT evidence_id, coalesce(t IS NOT NULL AND text IS NOT NULL AND contains(t, text) AND (ru_start IS NULL OR ru_end IS NULL OR substr(t, ru_start + 1, ru_end - ru_start) = text), false) AS active, CASE WHEN t IS NULL THEN 'unit missing' WHEN text IS NULL THEN 'text missing' WHEN NOT contains(t, text) THEN 'text differs' WHEN ru_start IS NOT NULL AND ru_end IS NOT NULL AND substr(t, ru_start + 1, ru_end - ru_start) <> text THEN 'range differs' ELSE 'bound' END AS reason FROM q LEFT JOIN u USING (unit_id)")
def v8_binding_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of quotes: active where text and range agree with the unit, else inactive with the reason."""
    j = quotes(spark, d).join(unit_texts(spark, d), "unit_id", "left")
    cut = F.substring(F.col("t"), F.col("ru_start") + 1, F.col("ru_end") - F.col("ru_start"))
    reason = F.when(F.col("t").isNull(), "unit missing").when(F.col("text").isNull(), "text missing").when(~F.col("t").contains(F.col("text")), "text differs").when(F.col("ru_start").isNotNull() & F.col("ru_end").isNotNull() & (cut != F.col("text")), "range differs").otherwise("bound")
    return j.select("evidence_id", (reason == "bound").alias("active"), reason.alias("reason"))
