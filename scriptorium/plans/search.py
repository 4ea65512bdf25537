"""Queries of retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, search
from ..session import table
from .registry import register

TOK = r"list_concat(regexp_extract_all(lower({0}), '[\x{{3400}}-\x{{9fff}}]'), regexp_extract_all(lower({0}), '[a-z0-9]+'))"
D_TOK, Q_TOK = TOK.format("text"), TOK.format("query")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "title", "record_key")


def eval_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))


_BM25 = """
    q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({q}) AS term FROM eval_items) GROUP BY ALL),
    d AS (SELECT doc_id, len({t}) AS dl, {t} AS toks, {role} AS in_role, {pop} AS in_pop FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl, any_value(in_role) AS in_role, any_value(in_pop) AS in_pop
          FROM (SELECT doc_id, dl, in_role, in_pop, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
    f AS (SELECT term, count(*) AS df FROM p WHERE in_pop GROUP BY term),
    st AS (SELECT count(*) AS n, avg(dl) AS a FROM d WHERE in_pop),
    sc AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a)))), 9) AS score
           FROM q JOIN f USING (term) JOIN p USING (term), st WHERE in_role GROUP BY query_id, doc_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score <> 0)
"""


def _bm25_sql(role: str = "true", pop: str = "true", q: str = Q_TOK) -> str:
    return _BM25.format(q=q, t=D_TOK, role=role, pop=pop)


@register("r2_bm25", f"WITH {_bm25_sql()} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def r2_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(docs(spark, d), eval_queries(spark, d)).withColumn("score", F.round("score", 6))


_WITNESS = f"""WITH {_bm25_sql(q=D_TOK)} SELECT e.item_id AS query_id, CAST(min(rank) AS INTEGER) AS witness_rank FROM top JOIN documents d USING (doc_id) JOIN eval_items e ON e.item_id = top.query_id
    WHERE rank <= 50 AND e.text <> '' AND contains(d.text, e.text) GROUP BY e.item_id"""


@register("m7_witness_rank", _WITNESS)
def m7_witness_rank(spark: SparkSession, d: str) -> DataFrame:
    """Best rank of a hit that holds the whole text of the item literally."""
    passages = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    hits = search.bm25(docs(spark, d), passages, 50)
    items = passages.withColumnRenamed("text", "quote").where("quote <> ''")
    both = hits.join(docs(spark, d).select("doc_id", "text"), "doc_id").join(items, "query_id")
    return both.where(F.col("text").contains(F.col("quote"))).groupBy("query_id").agg(F.min("rank").alias("witness_rank"))


@register("r5_population_bm25", f"WITH {_bm25_sql(role="coalesce(source = 'book_text', false)", pop="coalesce(lang = 'zh', false)")} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def r5_population_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of one population, candidates of one role: the mask is not the statistic."""
    hit = search.bm25(docs(spark, d), eval_queries(spark, d), population=F.coalesce(F.col("lang") == "zh", F.lit(False)), role=F.coalesce(F.col("source") == "book_text", F.lit(False)))
    return hit.withColumn("score", F.round("score", 6))


_FIELDS = {"title": 2.0, "source": 1.25, "record_key": 0.0, "text": 1.0}


@register(
    "r3_bm25f",
    f"""
    WITH q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({Q_TOK}) AS term FROM eval_items) GROUP BY ALL),
    l AS (SELECT doc_id, 'title' AS field, 2.0 AS w, {TOK.format("coalesce(title, '')")} AS toks FROM documents UNION ALL SELECT doc_id, 'source', 1.25, {TOK.format("coalesce(source, '')")} FROM documents
          UNION ALL SELECT doc_id, 'record_key', 0.0, {TOK.format("coalesce(record_key, '')")} FROM documents UNION ALL SELECT doc_id, 'text', 1.0, {TOK.format("coalesce(text, '')")} FROM documents),
    a AS (SELECT field, avg(len(toks)) AS a FROM l GROUP BY field),
    p AS (SELECT doc_id, field, term, count(*) AS tf, any_value(w) AS w, any_value(dl) AS dl FROM (SELECT doc_id, field, w, len(toks) AS dl, unnest(toks) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, field, term),
    x AS (SELECT doc_id, term, sum(w * tf / (1 - 0.75 + 0.75 * dl / a)) AS x FROM p JOIN a USING (field) GROUP BY doc_id, term),
    f AS (SELECT term, count(*) AS df FROM x GROUP BY term),
    sc AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * x * 2.2 / (x + 1.2)), 9) AS score FROM q JOIN f USING (term) JOIN x USING (term), (SELECT count(*) AS n FROM documents) GROUP BY query_id, doc_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10
    """,
)
def r3_bm25f(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_fields(docs(spark, d), eval_queries(spark, d), _FIELDS).withColumn("score", F.round("score", 6))


_BI = r"list_concat(regexp_extract_all(lower({0}), '[\x{{3400}}-\x{{9fff}}]'), flatten(list_transform(regexp_extract_all(lower({0}), '[\x{{3400}}-\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def _channel_sql(name: str, boost: float, weight: float, field: str, tok: str) -> str:
    return f"""(WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({tok.format("query")}) AS term FROM eval_items),
      t AS (SELECT doc_id, {tok.format(field)} AS toks FROM documents WHERE {field} IS NOT NULL),
      p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
      f AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t)
      SELECT query_id, doc_id, {boost * weight} * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))) AS s FROM q JOIN f USING (term) JOIN p USING (term), st)"""


# A dictionary for the word analyzer: a parameter of the queries.
WORDS = ("灰狼", "海螺", "灯塔", "祭坛", "风车", "经文", "纸鸢", "罗盘", "商队", "石碑", "药铺", "冰湖", "马车", "使团", "山猫")
_WORD = "regexp_extract_all(lower({0}), '(" + "|".join(WORDS) + r"|[a-z0-9]+|[\x{{3400}}-\x{{9fff}}])')"
_FIVE = {"title": 2.0, "source": 1.25, "record_key": 0.5, "lang": 0.25, "text": 1.0}
_ANALYZERS = (("uni", 1.0, TOK), ("bi", 0.8, _BI), ("word", 0.6, _WORD))


@register(
    "r6_channels_bm25f",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT * FROM {_channel_sql(n, b, w, f, t)}" for n, b, t in _ANALYZERS for f, w in _FIVE.items())
    + """), sc AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM u GROUP BY query_id, doc_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10""",
)
def r6_channels_bm25f(spark: SparkSession, d: str) -> DataFrame:
    """Five fields by three analyzers (characters, with bigrams, words), each physical field with its own statistics."""
    channels = {"uni": (1.0, T.bag), "bi": (0.8, T.analyze_with_bigrams), "word": (0.6, lambda c: T.dictionary_words(c, list(WORDS)))}
    return search.bm25_channels(docs(spark, d), eval_queries(spark, d), _FIVE, channels).withColumn("score", F.round("score", 6))


_DENSE = """
    s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
          FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


@register("r7_dense_top_k", f"WITH {_DENSE} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def r7_dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors, exactly."""
    v = table(spark, d, "embeddings")
    return search.dense_top_k(v, v.where("vec_id % 100 = 0"), 10)


@register("r9_window_max", f"WITH {_DENSE}, b AS (SELECT query_id, vec_id // 4 AS owner, max(score) AS score FROM s GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner) AS rank FROM b) SELECT query_id, owner, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10")
def r9_window_max(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as windows of owners (four each): an owner scores as its best window."""
    v = table(spark, d, "embeddings")
    return search.dense_top_k(v, v.where("vec_id % 100 = 0"), 10, owner=4).withColumnRenamed("vec_id", "owner")


_SPARSE = """
    ss AS (SELECT query_id, doc_id, round(sum(tf / sqrt(dl) * CAST(qf AS DOUBLE)), 9) AS score FROM p JOIN q USING (term) GROUP BY query_id, doc_id),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ss WHERE score > 0)
"""


def _sparse_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Documents as sparse vectors of term frequency over the root of the length."""
    return search.bag_sparse_top_k(docs(spark, d).select("doc_id", "text"), eval_queries(spark, d), k)


@register("r10_sparse_top_k", f"WITH {_bm25_sql()}, {_SPARSE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def r10_sparse_top_k(spark: SparkSession, d: str) -> DataFrame:
    return _sparse_hits(spark, d, 10).withColumn("score", F.round("score", 6))


@register("r11_strongest_weight", f"SELECT doc_id, term, max(CAST(i % 7 AS DOUBLE)) AS w FROM (SELECT doc_id, unnest({D_TOK}) AS term, unnest(range(len({D_TOK}))) AS i FROM documents) WHERE i % 7 > 0 GROUP BY ALL")
def r11_strongest_weight(spark: SparkSession, d: str) -> DataFrame:
    """Token weights (here of their positions) reduced to the largest positive one of a term."""
    toks = docs(spark, d).select("doc_id", F.posexplode(T.analyze(F.col("text"))).alias("i", "term"))
    return search.strongest(toks.select("doc_id", "term", (F.col("i") % 7).cast("double").alias("w")))


@register("r15_record_ranks", f"WITH {_bm25_sql()}, r AS (SELECT query_id, record_key, min(rank) AS best, count(*) AS support FROM top JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY ALL) SELECT query_id, record_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best) AS INTEGER) AS rank, CAST(least(support, 6) AS BIGINT) AS support FROM r")
def r15_record_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of documents turned into ranks of their records by first occurrence."""
    from pyspark.sql.window import Window

    hits = search.bm25(docs(spark, d), eval_queries(spark, d), 50).join(docs(spark, d).select("doc_id", "record_key"), "doc_id")
    best = hits.groupBy("query_id", "record_key").agg(F.min("rank").alias("best"), F.least(F.count("*"), F.lit(6)).alias("support"))
    return best.select("query_id", "record_key", F.row_number().over(Window.partitionBy("query_id").orderBy("best")).alias("rank"), "support")


@register("r16_spread_queries", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, vec_id FROM r WHERE n <= 4 OR list_contains(list_transform([0,1,2,3], lambda j: CAST(round_even(j * (n - 1) / 3.0, 0) AS BIGINT)), i)")
def r16_spread_queries(spark: SparkSession, d: str) -> DataFrame:
    return fusion.spread(table(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id", 4)


# ---- fusion ------------------------------------------------------------------------------------

_TWO = f"WITH {_bm25_sql()}, {_SPARSE}, h AS (SELECT query_id, 'bm25' AS route, doc_id AS key, rank FROM top WHERE rank <= 50 UNION ALL SELECT query_id, 'sparse', doc_id, rank FROM sparse WHERE rank <= 50)"


def two_lists(spark: SparkSession, d: str) -> DataFrame:
    a = search.bm25(docs(spark, d), eval_queries(spark, d), 50).select("query_id", F.lit("bm25").alias("route"), F.col("doc_id").alias("key"), "rank")
    return a.unionByName(_sparse_hits(spark, d, 50).select("query_id", F.lit("sparse").alias("route"), F.col("doc_id").alias("key"), "rank"))


@register("f1_rrf", f"{_TWO}, s AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM h GROUP BY ALL) SELECT query_id, key, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s")
def f1_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(two_lists(spark, d)).withColumn("score", F.round("score", 9))


_ROUTES = f"{_TWO}, r AS (SELECT query_id, route AS channel, g AS granularity, key, row_number() OVER (PARTITION BY query_id, route, g ORDER BY h.rank) AS rank FROM h JOIN (SELECT doc_id AS key, CASE WHEN n_chars < 700 THEN 'micro' ELSE 'macro' END AS g FROM documents) USING (key))"


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Hits by channel and granularity; short documents are micro, long ones macro."""
    from pyspark.sql.window import Window

    g = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("n_chars") < 700, "micro").otherwise("macro").alias("granularity"))
    h = two_lists(spark, d).join(g, "key").withColumnRenamed("route", "channel")
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel", "granularity").orderBy("rank")))


def _fused_sql(agg: str) -> str:
    return f"""{_ROUTES}, i AS (SELECT query_id, granularity, key, round(sum(CASE channel WHEN 'bm25' THEN 0.5::DOUBLE / 0.75 ELSE 0.25::DOUBLE / 0.75 END / (60 + rank)), 12) AS s FROM r GROUP BY ALL),
    j AS (SELECT *, row_number() OVER (PARTITION BY query_id, granularity ORDER BY s DESC, key) AS r2 FROM i), k AS (SELECT query_id, key, round({agg}(1.0::DOUBLE / (60 + r2)), 12) AS score FROM j GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM k) SELECT query_id, key, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 100"""


_CHANNEL_WEIGHTS = {"bm25": 0.5, "sparse": 0.25}


@register("f2_fuse_max", _fused_sql("max"))
def f2_fuse_max(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_routes(routes(spark, d), _CHANNEL_WEIGHTS, "f1_max").withColumn("score", F.round("score", 9))


@register("f2_fuse_rrf", _fused_sql("sum"))
def f2_fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_routes(routes(spark, d), _CHANNEL_WEIGHTS, "f1_rrf").withColumn("score", F.round("score", 9))


@register("f2_fuse_sum", f"{_ROUTES}, k AS (SELECT query_id, key, round(sum(CASE channel WHEN 'bm25' THEN 0.5::DOUBLE / 0.75 ELSE 0.25::DOUBLE / 0.75 END / (60 + rank)), 12) AS score FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM k) SELECT query_id, key, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 100")
def f2_fuse_sum(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_routes(routes(spark, d), _CHANNEL_WEIGHTS, "f0").withColumn("score", F.round("score", 9))


_BOTH = f"{_TWO}, b AS (SELECT a.query_id, a.key, a.rank AS first_rank, z.rank AS second_rank FROM h a JOIN h z ON a.query_id = z.query_id AND a.key = z.key AND a.route = 'bm25' AND z.route = 'sparse')"


def both_ranks(spark: SparkSession, d: str) -> DataFrame:
    h = two_lists(spark, d)
    a = h.where("route = 'bm25'").select("query_id", "key", F.col("rank").alias("first_rank"))
    return a.join(h.where("route = 'sparse'").select("query_id", "key", F.col("rank").alias("second_rank")), ["query_id", "key"])


@register("f6_rank_fusion", f"{_BOTH}, s AS (SELECT *, round(0.35::DOUBLE / (60 + first_rank) + 0.65::DOUBLE / (60 + second_rank), 12) AS score FROM b) SELECT query_id, key, CAST(first_rank AS INTEGER) AS first_rank, CAST(second_rank AS INTEGER) AS second_rank, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank, key) AS INTEGER) AS rank FROM s")
def f6_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_two_ranks(both_ranks(spark, d), "first_rank", "second_rank").withColumn("score", F.round("score", 9))


@register("f7_stable_rerank", f"{_BOTH} SELECT query_id, key, CAST(first_rank AS INTEGER) AS rank, CAST(second_rank % 5 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY second_rank % 5 DESC, first_rank, key) AS INTEGER) AS new_rank FROM b")
def f7_stable_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A coarse second score with many ties keeps the first order inside a tie."""
    return fusion.stable_rerank(both_ranks(spark, d).select("query_id", "key", F.col("first_rank").alias("rank"), (F.col("second_rank") % 5).cast("double").alias("score")))


@register("f10_yes_probability", "SELECT event_id, round(1 / (1 + exp(value / 100 - 0.5)), 9) AS p FROM events WHERE value IS NOT NULL")
def f10_yes_probability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value is not null").select("event_id", F.round(fusion.yes_probability(F.lit(0.5), F.col("value") / 100), 9).alias("p"))


@register("f12_balanced_rrf", f"{_TWO}, w AS (SELECT item_id AS query_id, coalesce(track, '-') AS source, 1.0::DOUBLE / count(*) OVER (PARTITION BY coalesce(track, '-')) AS w FROM eval_items), s AS (SELECT source, key, round(sum(w / (60 + rank)), 12) AS score FROM h JOIN w USING (query_id) WHERE route = 'bm25' GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS rank FROM s) SELECT source, key, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM o")
def f12_balanced_rrf(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.coalesce("track", F.lit("-")).alias("source"))
    return fusion.balanced_rrf(two_lists(spark, d).where("route = 'bm25'"), sources).withColumn("score", F.round("score", 9))


@register("f13_supplement", f"{_TWO}, base AS (SELECT query_id, key, rank FROM h WHERE route = 'bm25' AND rank <= 10), e AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM h WHERE route = 'sparse' AND NOT EXISTS (SELECT 1 FROM base WHERE base.query_id = h.query_id AND base.key = h.key)), z AS (SELECT query_id, max(rank) AS size FROM base GROUP BY query_id) SELECT query_id, key, CAST(rank AS INTEGER) AS rank, 'base' AS part FROM base UNION ALL SELECT e.query_id, key, CAST(coalesce(size, 0) + n AS INTEGER), 'supplement' FROM e LEFT JOIN z USING (query_id) WHERE n <= 20")
def f13_supplement(spark: SparkSession, d: str) -> DataFrame:
    h = two_lists(spark, d)
    return fusion.supplement(h.where("route = 'bm25' and rank <= 10").drop("route"), h.where("route = 'sparse'").drop("route"))


@register("f15_nested_quota", "WITH e AS (SELECT doc_id, source, record_key, row_number() OVER (PARTITION BY source, record_key ORDER BY doc_id) AS e FROM documents WHERE source IN ('wiki_page', 'book_text', 'qa_log', 'notice')), s AS (SELECT doc_id, source, record_key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS slot FROM e WHERE e <= 2) SELECT doc_id, source, record_key, CAST(slot AS INTEGER) AS slot FROM s WHERE slot <= CASE source WHEN 'wiki_page' THEN 16 WHEN 'book_text' THEN 8 ELSE 12 END")
def f15_nested_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", "source", "record_key").where(F.col("source").isin("wiki_page", "book_text", "qa_log", "notice"))
    return fusion.nested_quota(rows, "source", "record_key", "doc_id", 2, {"wiki_page": 16, "book_text": 8, "qa_log": 12, "notice": 12})


_DISJOINT = """WITH RECURSIVE p AS (SELECT doc_id, lang, lead(doc_id) OVER (PARTITION BY record_key ORDER BY doc_id) AS other FROM documents), r AS (SELECT lang, doc_id || '-' || other AS pair, doc_id AS a, other AS b FROM p WHERE other IS NOT NULL AND lang IS NOT NULL),
    n AS (SELECT *, row_number() OVER (ORDER BY lang, h, pair) AS i, row_number() OVER (PARTITION BY lang ORDER BY h, pair) AS place FROM (SELECT *, sha256('round-1:' || lang || ':' || pair) AS h FROM r)),
    w(i, lang, taken, used, word) AS (SELECT 0::BIGINT, '', 0, CAST([] AS BIGINT[]), '' UNION ALL SELECT n.i, n.lang,
      CASE WHEN w.lang = n.lang THEN w.taken ELSE 0 END + CASE WHEN (w.lang <> n.lang OR w.taken < 3) AND NOT list_has_any(w.used, [n.a, n.b]) THEN 1 ELSE 0 END,
      CASE WHEN (w.lang <> n.lang OR w.taken < 3) AND NOT list_has_any(w.used, [n.a, n.b]) THEN list_concat(w.used, [n.a, n.b]) ELSE w.used END,
      CASE WHEN w.lang = n.lang AND w.taken >= 3 THEN 'quota full' WHEN list_has_any(w.used, [n.a, n.b]) THEN 'source used' ELSE 'selected' END FROM w JOIN n ON n.i = w.i + 1)
    SELECT n.lang, n.pair, CAST(n.place AS INTEGER) AS place, w.word AS disposition FROM n JOIN w USING (i)"""


@register("f14_disjoint_selection", _DISJOINT)
def f14_disjoint_selection(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents of one record with neighbouring ids, chosen by hash so that no document is used twice."""
    from pyspark.sql.window import Window

    rows = docs(spark, d).select("doc_id", "lang", F.lead("doc_id").over(Window.partitionBy("record_key").orderBy("doc_id")).alias("other")).where("other is not null and lang is not null")
    return fusion.disjoint_selection(rows.withColumn("pair", F.concat_ws("-", "doc_id", "other")), "lang", "pair", ("doc_id", "other"), "round-1", 3)


@register("f9_mmr")
def f9_mmr(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    hits = search.dense_top_k(v, v.where("vec_id % 100 = 0"), 50)
    return fusion.mmr(hits.join(v.select("vec_id", "embedding"), "vec_id").select("query_id", F.col("vec_id").alias("key"), "score", "embedding"))


_DEFERRED = f"""{_TWO}, hb AS (SELECT query_id, key, h.rank, text FROM h LEFT JOIN documents ON doc_id = key WHERE route = 'bm25'),
    cv AS (SELECT a.query_id, a.key, list(b.key) AS covered_by FROM hb a JOIN hb b ON a.query_id = b.query_id AND b.rank < a.rank AND a.text <> '' AND length(a.text) <= length(b.text) AND contains(b.text, a.text) GROUP BY ALL),
    oo AS (SELECT hb.query_id, hb.key, hb.rank, cv.covered_by FROM hb LEFT JOIN cv ON cv.query_id = hb.query_id AND cv.key = hb.key),
    ww AS (WITH RECURSIVE w(query_id, i, main, mains) AS (SELECT DISTINCT query_id, 0::BIGINT, false, CAST([] AS BIGINT[]) FROM oo UNION ALL SELECT oo.query_id, w.i + 1, NOT list_has_any(coalesce(oo.covered_by, []), w.mains), CASE WHEN list_has_any(coalesce(oo.covered_by, []), w.mains) THEN w.mains ELSE list_append(w.mains, oo.key) END FROM w JOIN oo ON oo.query_id = w.query_id AND oo.rank = w.i + 1) SELECT * FROM w),
    fi AS (SELECT oo.query_id, oo.key, oo.rank, ww.main, row_number() OVER (PARTITION BY oo.query_id ORDER BY NOT ww.main, oo.rank) AS final_rank FROM oo JOIN ww ON ww.query_id = oo.query_id AND ww.i = oo.rank)
    SELECT query_id, key, CAST(rank AS INTEGER) AS rank, main, CAST(final_rank AS INTEGER) AS final_rank, CASE WHEN final_rank > 30 THEN 'outside' WHEN main THEN 'selected' ELSE 'selected_refill' END AS disposition FROM fi"""


@register("f5_defer_covered", _DEFERRED)
def f5_defer_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text stands whole in another one are moved behind the uncovered ones."""
    h = two_lists(spark, d).where("route = 'bm25'").select("query_id", "key", "rank")
    covers = fusion.containment(h, docs(spark, d).select(F.col("doc_id").alias("key"), "text"))
    return fusion.defer_covered(h, covers, 30)


@register("f8_structural_rerank", _DEFERRED.replace("SELECT query_id, key, CAST(rank AS INTEGER) AS rank, main, CAST(final_rank AS INTEGER) AS final_rank, CASE WHEN final_rank > 30 THEN 'outside' WHEN main THEN 'selected' ELSE 'selected_refill' END AS disposition FROM fi", "SELECT query_id, key, CAST(final_rank AS INTEGER) AS final_rank, main FROM fi").replace("hb AS (SELECT query_id, key, h.rank, text FROM h LEFT JOIN documents ON doc_id = key WHERE route = 'bm25')", "rl AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank % 7 DESC, rank, key) AS rank FROM h WHERE route = 'bm25'), hb AS (SELECT query_id, key, rl.rank, text FROM rl LEFT JOIN documents ON doc_id = key)"))
def f8_structural_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Hits ordered by a relevance score (here a coarse one of their ranks), then those that an earlier one covers behind all others."""
    h = two_lists(spark, d).where("route = 'bm25'").select("query_id", "key", "rank", (F.col("rank") % 7).cast("double").alias("score"))
    order = fusion.stable_rerank(h).select("query_id", "key", F.col("new_rank").alias("rank"))
    covers = fusion.containment(order, docs(spark, d).select(F.col("doc_id").alias("key"), "text"))
    return fusion.defer_covered(order, covers, 30).select("query_id", "key", "final_rank", "main")
