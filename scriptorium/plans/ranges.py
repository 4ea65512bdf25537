"""Queries of ranges, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals, statistics
from ..session import table
from .registry import register

_Q = "q AS (SELECT DISTINCT unit_id, evidence_id, ru_start AS s, ru_end AS e FROM (SELECT unnest(quotes, recursive := true) FROM card_semantic_cases) WHERE ru_end > ru_start AND unit_id IS NOT NULL)"


def quote_ranges(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "card_semantic_cases").select(F.explode("quotes").alias("q")).select("q.unit_id", "q.evidence_id", F.col("q.ru_start").alias("start"), F.col("q.ru_end").alias("end"))
    return q.where("end > start and unit_id is not null").distinct()


_MERGED = f"""{_Q}, r AS (SELECT DISTINCT unit_id, s, e FROM q), o AS (SELECT *, max(e) OVER (PARTITION BY unit_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY s, e) AS island FROM o), m AS (SELECT unit_id, min(s) AS s, max(e) AS e FROM i GROUP BY unit_id, island)"""


@register("x12_merged_ranges", f'WITH {_MERGED} SELECT unit_id, s AS "start", e AS "end" FROM m')
def x12_merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(quote_ranges(spark, d), ["unit_id"])


@register("a8_union_length", f"WITH {_MERGED} SELECT a.unit_id, CAST(single AS BIGINT) AS single, CAST(covered AS BIGINT) AS covered, CAST(single - covered AS BIGINT) AS repeated FROM (SELECT unit_id, sum(e - s) AS single FROM q GROUP BY unit_id) a JOIN (SELECT unit_id, sum(e - s) AS covered FROM m GROUP BY unit_id) b USING (unit_id)")
def a8_union_length(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_length(quote_ranges(spark, d), ["unit_id"])


_LEN = "n AS (SELECT unit_id, max(length(retrieval_visible_text)) AS n FROM p05_story_rus GROUP BY unit_id)"


@register(
    "x10_unread_ranges",
    f"""WITH {_MERGED}, {_LEN}, z AS (SELECT unit_id, 0 AS s, 0 AS e FROM n UNION ALL SELECT unit_id, least(s, n), least(e, n) FROM m JOIN n USING (unit_id) UNION ALL SELECT unit_id, n, n FROM n),
    b AS (SELECT unit_id, max(e) OVER (PARTITION BY unit_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, s AS t FROM z) SELECT unit_id, f AS "start", t AS "end" FROM b WHERE t > f""",
)
def x10_unread_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What the quotes leave unread of every unit."""
    n = table(spark, d, "p05_story_rus").groupBy("unit_id").agg(F.max(F.length("retrieval_visible_text")).cast("int").alias("length"))
    return intervals.gaps(quote_ranges(spark, d), n, ["unit_id"])


@register("j6_overlap_join", f"WITH {_Q} SELECT a.unit_id, a.evidence_id AS a, b.evidence_id AS b, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS INTEGER) AS shared FROM q a JOIN q b ON a.unit_id = b.unit_id AND a.evidence_id < b.evidence_id AND a.s < b.e AND b.s < a.e")
def j6_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlaps(quote_ranges(spark, d), ["unit_id"], "evidence_id", cell=64)


@register("j7_containment_join", f'WITH {_Q} SELECT a.unit_id, a.evidence_id AS id, min(b.evidence_id) AS "by" FROM q a JOIN q b ON a.unit_id = b.unit_id AND b.evidence_id < a.evidence_id AND b.s <= a.s AND b.e >= a.e GROUP BY a.unit_id, a.evidence_id')
def j7_containment_join(spark: SparkSession, d: str) -> DataFrame:
    return intervals.contained(quote_ranges(spark, d), ["unit_id"], "evidence_id", "evidence_id")


@register("a18_contiguity", f"""WITH {_MERGED}, b AS (SELECT *, lag(e) OVER (PARTITION BY unit_id ORDER BY s, e) AS b FROM m) SELECT unit_id, s AS "start", e AS "end", CASE WHEN b IS NULL AND s <> 0 THEN 'starts late' WHEN s > b THEN 'gap' WHEN s < b THEN 'overlap' END AS problem FROM b WHERE (b IS NULL AND s <> 0) OR s <> b""")
def a18_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return intervals.not_contiguous(intervals.merged(quote_ranges(spark, d), ["unit_id"]), ["unit_id"])


@register("v7_evidence_binding", "WITH q AS (SELECT DISTINCT evidence_id, unit_id, text, ru_start, ru_end FROM (SELECT unnest(quotes, recursive := true) FROM card_semantic_cases)), u AS (SELECT unit_id, any_value(retrieval_visible_text) AS t FROM p05_story_rus GROUP BY unit_id) SELECT evidence_id, CASE WHEN t IS NULL THEN 'no unit' WHEN text IS NULL OR ru_start IS NULL OR ru_end IS NULL THEN 'no text or range' WHEN substr(t, ru_start + 1, ru_end - ru_start) = text THEN 'exact' WHEN contains(t, text) THEN 'elsewhere' ELSE 'differs' END AS binding FROM q LEFT JOIN u USING (unit_id)")
def v7_evidence_binding(spark: SparkSession, d: str) -> DataFrame:
    """Whether a quote equals its unit's slice."""
    q = table(spark, d, "card_semantic_cases").select(F.explode("quotes").alias("q")).select("q.evidence_id", "q.unit_id", "q.text", "q.ru_start", "q.ru_end").distinct()
    u = table(spark, d, "p05_story_rus").groupBy("unit_id").agg(F.first("retrieval_visible_text").alias("t"))
    word = F.when(F.col("t").isNull(), "no unit").when(F.col("text").isNull() | F.col("ru_start").isNull() | F.col("ru_end").isNull(), "no text or range")
    word = word.when(F.substring(F.col("t"), F.col("ru_start") + 1, F.col("ru_end") - F.col("ru_start")) == F.col("text"), "exact").when(F.col("t").contains(F.col("text")), "elsewhere").otherwise("differs")
    return q.join(u, "unit_id", "left").select("evidence_id", word.alias("binding"))


# ---- aggregates --------------------------------------------------------------------------------


_PROFILE = {
    "records": "count(DISTINCT record_key)", "texts": "count(DISTINCT md5(text))", "repeated_rows": "count(*) - count(DISTINCT md5(text))", "chars": "CAST(sum(n_chars) AS BIGINT)", "shortest": "min(n_chars)", "longest": "max(n_chars)",
    "untitled": "count(*) FILTER (WHERE title IS NULL)", "empty": "count(*) FILTER (WHERE trim(text) = '')", "headed": "count(*) FILTER (WHERE starts_with(text, '#'))", "with_digits": "count(*) FILTER (WHERE regexp_matches(text, '[0-9]{4,}'))",
    "with_latin": "count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]{3,}'))", "with_han": "count(*) FILTER (WHERE regexp_matches(text, '[一-鿿]'))", "with_kana": "count(*) FILTER (WHERE regexp_matches(text, '[ぁ-ヿ]'))", "with_links": "count(*) FILTER (WHERE regexp_matches(text, 'https?://'))",
    "with_mail": "count(*) FILTER (WHERE contains(text, '@'))", "paragraphs": "CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT)", "titles": "count(DISTINCT title)", "bytes": "CAST(sum(octet_length(encode(text))) AS BIGINT)",
    "late": "count(*) FILTER (WHERE loaded_at > fetched_at + INTERVAL 1 DAY)", "first_fetch": "min(fetched_at)", "last_fetch": "max(fetched_at)",
}


@register("a1_profile", "SELECT coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, count(*) AS n, " + ", ".join(f"{x} AS {c}" for c, x in _PROFILE.items()) + " FROM documents GROUP BY ALL")
def a1_profile(spark: SparkSession, d: str) -> DataFrame:
    """A profile of the corpus by source and language in one pass: some twenty counters, sums and distinct counts."""
    x, t = table(spark, d, "documents"), F.col("text")
    has = lambda p: F.count_if(t.rlike(p))
    return x.groupBy(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang")).agg(
        F.count("*").alias("n"), F.countDistinct("record_key").alias("records"), F.countDistinct(F.md5("text")).alias("texts"), (F.count("*") - F.countDistinct(F.md5("text"))).alias("repeated_rows"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
        F.count_if(F.col("title").isNull()).alias("untitled"), F.count_if(F.trim(t) == "").alias("empty"), F.count_if(t.startswith("#")).alias("headed"), has("[0-9]{4,}").alias("with_digits"), has("[A-Za-z]{3,}").alias("with_latin"), has("[一-鿿]").alias("with_han"), has("[ぁ-ヿ]").alias("with_kana"), has("https?://").alias("with_links"),
        F.count_if(t.contains("@")).alias("with_mail"), F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("paragraphs"), F.countDistinct("title").alias("titles"), F.sum(F.octet_length(t)).alias("bytes"),
        F.count_if(F.col("loaded_at") > F.col("fetched_at") + F.expr("INTERVAL 1 DAY")).alias("late"), F.min("fetched_at").alias("first_fetch"), F.max("fetched_at").alias("last_fetch"),
    )


@register("a1_top_values", "WITH c AS (SELECT 'title' AS field, title AS value, count(*) AS n FROM documents WHERE title IS NOT NULL GROUP BY title UNION ALL SELECT 'record_key', record_key, count(*) FROM documents WHERE record_key IS NOT NULL GROUP BY record_key), t AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM c) SELECT field, value, n, CAST(place AS INTEGER) AS place FROM t WHERE place <= 15")
def a1_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent values of two fields, ties by value."""
    x = table(spark, d, "documents").select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "record_key")))).alias("v")).select("v.*").where("value is not null")
    c = x.groupBy("field", "value").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where("place <= 15")


@register("a2_distribution", "WITH s AS (SELECT coalesce(source, '-') AS source, list_sort(list(n_chars)) AS v FROM documents GROUP BY 1) SELECT source, CAST(len(v) AS BIGINT) AS n, CAST(list_sum(v) AS BIGINT) AS total, v[1] AS min, v[CAST(floor((len(v) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90, v[CAST(floor((len(v) - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99, v[-1] AS max FROM s")
def a2_distribution(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distribution(table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("-"))), ["source"], "n_chars")


@register("a3_observed_percentile", "SELECT l_returnflag, quantile_disc(l_quantity, 0.9) AS p FROM lineitem GROUP BY l_returnflag")
def a3_observed_percentile(spark: SparkSession, d: str) -> DataFrame:
    return statistics.observed_percentile(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.9)


@register("a4_histogram_percentile", "WITH c AS (SELECT n_chars // 100 AS bin, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM c) SELECT p.p, min(bin) AS bin FROM s, (SELECT unnest([0.5::DOUBLE, 0.9, 0.95]) AS p) p WHERE upto >= ceil(total * p) GROUP BY p.p")
def a4_histogram_percentile(spark: SparkSession, d: str) -> DataFrame:
    bins = table(spark, d, "documents").select(F.floor(F.col("n_chars") / 100).alias("bin"), F.lit(1).alias("g"))
    c = statistics.value_counts(bins, ["g"], "bin").crossJoin(F.broadcast(spark.createDataFrame([(0.5,), (0.9,), (0.95,)], "p double")))
    return c.where(F.col("upto") >= F.ceil(F.col("total") * F.col("p"))).groupBy("p").agg(F.min("value").alias("bin"))


@register("a6_summary", "SELECT label, min(x) AS min, round(median(x), 9) AS median, round(avg(x), 6) AS mean, max(x) AS max FROM (SELECT label, vec_id % 97 AS x FROM embeddings) GROUP BY label")
def a6_summary(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 97).alias("x"))
    return v.groupBy("label").agg(F.min("x").alias("min"), F.round(F.expr("percentile(x, 0.5)"), 9).alias("median"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("max"))


@register("a11_token_usage", "WITH r AS (SELECT DISTINCT ON (turn, attempt, event_no) turn, attempt, response FROM p05_responses_multimessage WHERE response IS NOT NULL) SELECT turn, count(*) AS calls, CASE WHEN count(*) = count(response.usage.input_tokens) THEN CAST(sum(response.usage.input_tokens) AS BIGINT) END AS input_tokens, CASE WHEN count(*) = count(response.usage.total_tokens) THEN CAST(sum(response.usage.total_tokens) AS BIGINT) END AS total_tokens FROM r GROUP BY turn")
def a11_token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Token sums per turn; one unknown call makes the sum unknown."""
    r = table(spark, d, "p05_responses_multimessage").where("response is not null").select("turn", "attempt", "event_no", F.col("response.usage.input_tokens").alias("i"), F.col("response.usage.total_tokens").alias("t")).dropDuplicates(["turn", "attempt", "event_no"])
    return r.groupBy("turn").agg(F.count("*").alias("calls"), statistics.sum_or_unknown(F.col("i")).alias("input_tokens"), statistics.sum_or_unknown(F.col("t")).alias("total_tokens"))


@register("a12_cost_rollup", "SELECT coalesce(event_type, '-') AS event_type, coalesce(CAST(user_id % 10 AS VARCHAR), '-') AS cohort, grouping(event_type) * 2 + grouping(user_id % 10) AS level, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def a12_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("c", F.col("user_id") % 10)
    r = e.rollup("event_type", "c").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value"))
    return r.select(F.coalesce("event_type", F.lit("-")).alias("event_type"), F.coalesce(F.col("c").cast("string"), F.lit("-")).alias("cohort"), "level", "n", "value")


@register("a13_share_bounds", "SELECT http_status, round(count(*) FILTER (WHERE ok) / count(*), 9) AS low, round((count(*) FILTER (WHERE ok) + count(*) FILTER (WHERE ok IS NULL)) / count(*), 9) AS high FROM obc_detail GROUP BY http_status")
def a13_share_bounds(spark: SparkSession, d: str) -> DataFrame:
    low, high = statistics.share_bounds(F.col("ok"), F.col("ok").isNull())
    return table(spark, d, "obc_detail").groupBy("http_status").agg(low.alias("low"), high.alias("high"))


@register("a16_size_bands", "SELECT CASE WHEN n_chars < 1000 THEN 'lt1k' WHEN n_chars < 4000 THEN '1-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS band, count(*) AS n, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE contains(text, chr(10) || chr(10))) AS multi_segment FROM documents GROUP BY 1")
def a16_size_bands(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    band = F.when(n < 1000, "lt1k").when(n < 4000, "1-4k").when(n < 8000, "4-8k").otherwise("8k+")
    return table(spark, d, "documents").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.col("text").contains("\n\n")).alias("multi_segment"))


@register("a17_source_accounting", "WITH s AS (SELECT DISTINCT id FROM turns), c AS (SELECT turn, count(DISTINCT id) AS n FROM chat_messages GROUP BY turn) SELECT coalesce(s.id, c.turn) AS turn, CASE WHEN s.id IS NULL THEN 'unexpected' WHEN c.n IS NULL THEN 'unclaimed' ELSE 'claimed ' || c.n END AS state FROM s FULL JOIN c ON s.id = c.turn WHERE c.n IS DISTINCT FROM 2 OR s.id IS NULL")
def a17_source_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Turns not claimed by exactly two messages, and claims of turns that do not exist."""
    s = table(spark, d, "turns").select("id").distinct()
    c = table(spark, d, "chat_messages").groupBy("turn").agg(F.countDistinct("id").alias("n"))
    state = F.when(F.col("id").isNull(), "unexpected").when(F.col("n").isNull(), "unclaimed").otherwise(F.concat(F.lit("claimed "), F.col("n").cast("string")))
    return s.join(c, s["id"] == c["turn"], "full").where(~F.col("n").eqNullSafe(F.lit(2)) | F.col("id").isNull()).select(F.coalesce("id", "turn").alias("turn"), state.alias("state"))


@register("a19_witness_comparison", "WITH r AS (SELECT list_dot_product(embedding, embedding) AS a, 1.0 AS b FROM embeddings) SELECT count(*) AS n, round(max(abs(a - b)), 4) AS max_abs_error, bool_and(abs(a - b) <= 1e-4 + 1e-3 * abs(b)) AS within FROM r")
def a19_witness_comparison(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.search import dot

    v = table(spark, d, "embeddings").select(dot(F.col("embedding"), F.col("embedding")).alias("a"), F.lit(1.0).alias("b"))
    return statistics.close_report(v, "a", "b", 1e-3, 1e-4).select("n", F.round("max_abs_error", 4).alias("max_abs_error"), "within")


# ---- joins -------------------------------------------------------------------------------------


@register("j9_dangling_messages", "SELECT DISTINCT id, turn FROM chat_messages m WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.id = m.turn)")
def j9_dangling_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").select("id", "turn").distinct()
    return m.join(table(spark, d, "turns").select(F.col("id").alias("turn")), "turn", "left_anti")


@register("j10_next_turn", "SELECT session, min(sequence) AS sequence FROM turns t WHERE session IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p05_responses_multimessage r WHERE r.turn = t.id AND r.type = 'response.completed') GROUP BY session")
def j10_next_turn(spark: SparkSession, d: str) -> DataFrame:
    """First turn of each session without a completed response."""
    done = table(spark, d, "p05_responses_multimessage").where("type = 'response.completed'").select(F.col("turn").alias("id")).distinct()
    return table(spark, d, "turns").where("session is not null").join(done, "id", "left_anti").groupBy("session").agg(F.min("sequence").alias("sequence"))


@register("j12_neighbours", "WITH t AS (SELECT DISTINCT id, session, sequence FROM turns WHERE session IS NOT NULL) SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM t WINDOW w AS (PARTITION BY session ORDER BY sequence)")
def j12_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("sequence")
    return table(spark, d, "turns").where("session is not null").select("id", "session", "sequence").distinct().select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


@register("j13_carry_forward", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS i, last_value(CASE WHEN starts_with(line, '#') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM l")
def j13_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The heading in force at each line of a document."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", "i", F.last(F.when(F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(w).alias("heading"))


@register("j1_contract_join", "SELECT count(*) FILTER (WHERE t.id IS NULL) AS unmatched, count(*) FILTER (WHERE t.session <> m.session) AS conflicting, count(*) AS n FROM (SELECT DISTINCT id, session, turn FROM chat_messages) m LEFT JOIN (SELECT DISTINCT id, session FROM turns) t ON t.id = m.turn")
def j1_contract_join(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").select(F.col("session").alias("named"), "turn", "id").distinct()
    t = table(spark, d, "turns").select(F.col("id").alias("turn"), "session").distinct().withColumn("known", F.lit(True))
    return m.join(t, "turn", "left").agg(F.count_if(F.col("known").isNull()).alias("unmatched"), F.count_if(F.col("named") != F.col("session")).alias("conflicting"), F.count("*").alias("n"))
