"""Queries of three-channel retrieval, channel sets, snippets, budgets and quality by slice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import assembly, fusion, search, statistics
from ..session import cut, table
from .registry import register
from .search import _BI, _DENSE, _FIELDS, _TWO, D_TOK, Q_TOK, TOK, _bm25_sql, docs, eval_queries, two_lists

_THREE = f"""{_TWO}, ds AS (SELECT e.item_id AS query_id, v.vec_id + 1 AS key, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM eval_items e JOIN embeddings q ON q.vec_id = e.item_id - 7000, embeddings v WHERE v.vec_id <> q.vec_id),
    dr AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM ds),
    h3 AS (SELECT * FROM h UNION ALL SELECT query_id, 'dense' AS route, key, rank FROM dr WHERE rank <= 50)"""


def three_lists(spark: SparkSession, d: str) -> DataFrame:
    """Hits (query_id, route, key, rank) of BM25, sparse and dense search; an item's vector is the one of its number, a document's that of its id."""
    v = table(spark, d, "embeddings")
    ids = table(spark, d, "eval_items").select((F.col("item_id") - 7000).alias("vec_id"))
    dense = search.dense_top_k(v, v.join(F.broadcast(ids), "vec_id"), 50)
    return two_lists(spark, d).unionByName(dense.select((F.col("query_id") + 7000).alias("query_id"), F.lit("dense").alias("route"), (F.col("vec_id") + 1).alias("key"), "rank"))


# Channel weights of the three sets.
SETS = {"S0": {"bm25": 0.5, "dense": 0.5}, "S1": {"dense": 0.5, "sparse": 0.5}, "S2": {"bm25": 0.25, "dense": 0.5, "sparse": 0.25}}

_ROUTES3 = f"{_THREE}, g AS (SELECT doc_id AS key, CASE WHEN n_chars < 700 THEN 'micro' ELSE 'macro' END AS granularity, text FROM documents), r3 AS (SELECT query_id, route AS channel, granularity, key, row_number() OVER (PARTITION BY query_id, route, granularity ORDER BY h3.rank) AS rank FROM h3 JOIN g USING (key)), w3 AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{c}', {w}::DOUBLE)" for s, ws in SETS.items() for c, w in ws.items())}) v(channels, channel, w))"


def routes3(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("n_chars") < 700, "micro").otherwise("macro").alias("granularity"))
    h = three_lists(spark, d).join(g, "key").withColumnRenamed("route", "channel")
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel", "granularity").orderBy("rank")))


_F0 = "SELECT channels, query_id, key, round(sum(w / (60 + rank)), 12) AS score FROM r3 JOIN w3 USING (channel) GROUP BY ALL"


@register("f4_channel_sets", f"{_ROUTES3}, s AS ({_F0}), o AS (SELECT *, row_number() OVER (PARTITION BY channels, query_id ORDER BY score DESC, key) AS rank FROM s) SELECT channels, query_id, key, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 100")
def f4_channel_sets(spark: SparkSession, d: str) -> DataFrame:
    """Three sets of weighted channels fused from the same hits."""
    hits = cut(routes3(spark, d))
    return reduce(DataFrame.unionByName, (fusion.fuse_routes(hits, w, "f0").select(F.lit(s).alias("channels"), "query_id", "key", F.round("score", 9).alias("score"), "rank") for s, w in SETS.items()))


_MATRIX = f"""{_ROUTES3}, f0 AS (SELECT 'f0' AS profile, * FROM ({_F0})),
    i AS (SELECT channels, query_id, granularity, key, round(sum(w / (60 + rank)), 12) AS s FROM r3 JOIN w3 USING (channel) GROUP BY ALL), j AS (SELECT *, row_number() OVER (PARTITION BY channels, query_id, granularity ORDER BY s DESC, key) AS r2 FROM i),
    f1 AS (SELECT 'f1_max' AS profile, channels, query_id, key, round(max(1.0::DOUBLE / (60 + r2)), 12) AS score FROM j GROUP BY ALL), f2 AS (SELECT 'f1_rrf' AS profile, channels, query_id, key, round(sum(1.0::DOUBLE / (60 + r2)), 12) AS score FROM j GROUP BY ALL),
    al AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT 'no_cleanup', channels, query_id, key, score FROM f1),
    o AS (SELECT *, row_number() OVER (PARTITION BY profile, channels, query_id ORDER BY score DESC, key) AS rank FROM al), t AS (SELECT * FROM o WHERE rank <= 100),
    c AS (SELECT t.*, CASE WHEN profile = 'no_cleanup' THEN 1 ELSE row_number() OVER (PARTITION BY profile, channels, query_id, md5(g.text) ORDER BY t.rank) END AS copy FROM t JOIN g USING (key)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY profile, channels, query_id ORDER BY copy > 1, rank) AS place FROM c)"""


@register("a9_profile_matrix", f"{_MATRIX} SELECT channels, profile, cutoff, count(*) AS hits, count(DISTINCT key) AS documents, CAST(sum(CASE WHEN copy > 1 THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM pl, (SELECT unnest([10, 30, 100]) AS cutoff) WHERE place <= cutoff GROUP BY ALL")
def a9_profile_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Twelve profiles: three channel sets by three fusions with equal texts deferred and one without; what each shows at three cutoffs."""
    hits = cut(routes3(spark, d))
    digest = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.md5("text").alias("digest"))
    parts = []
    for s, w in SETS.items():
        for profile in ("f0", "f1_max", "f1_rrf", "no_cleanup"):
            parts.append(fusion.fuse_routes(hits, w, "f1_max" if profile == "no_cleanup" else profile).select(F.lit(s).alias("channels"), F.lit(profile).alias("profile"), "query_id", "key", "rank"))
    ranked = reduce(DataFrame.unionByName, parts).join(digest, "key")
    one = Window.partitionBy("profile", "channels", "query_id")
    copy = F.when(F.col("profile") == "no_cleanup", 1).otherwise(F.row_number().over(Window.partitionBy("profile", "channels", "query_id", "digest").orderBy("rank")))
    placed = ranked.withColumn("copy", copy).withColumn("place", F.row_number().over(one.orderBy(F.col("copy") > 1, "rank")))
    cutoffs = F.explode(F.filter(F.array(*map(F.lit, (10, 30, 100))), lambda x: F.col("place") <= x))
    return placed.select("channels", "profile", "key", "copy", cutoffs.alias("cutoff")).groupBy("channels", "profile", "cutoff").agg(F.count("*").alias("hits"), F.countDistinct("key").alias("documents"), F.count_if(F.col("copy") > 1).alias("copies"))


@register("r18_channel_runner", f"{_THREE} SELECT route, count(*) AS hits, count(DISTINCT query_id) AS queries, CAST(max(rank) AS INTEGER) AS deepest FROM h3 GROUP BY route")
def r18_channel_runner(spark: SparkSession, d: str) -> DataFrame:
    """All channels run as one plan, their hits put together; what each gave."""
    return three_lists(spark, d).groupBy("route").agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"), F.max("rank").alias("deepest"))


def retrieve(spark: SparkSession, d: str, mode: str, k: int = 20) -> DataFrame:
    """(mode, query_id, key, rank) of a search mode: lexical, dense, or hybrid (reciprocal rank fusion of both)."""
    hits = three_lists(spark, d)
    if mode == "hybrid":
        found = fusion.rrf(hits.where("route in ('bm25', 'dense')"))
    elif mode in ("lexical", "dense"):
        found = hits.where(F.col("route") == {"lexical": "bm25", "dense": "dense"}[mode])
    else:
        raise ValueError(f"unknown mode {mode}")
    return found.where(F.col("rank") <= k).select(F.lit(mode).alias("mode"), "query_id", "key", "rank")


@register("r17_dispatch", f"{_THREE}, fu AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM h3 WHERE route IN ('bm25', 'dense') GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fu) SELECT 'hybrid' AS mode, query_id, key, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 20 UNION ALL SELECT CASE route WHEN 'bm25' THEN 'lexical' ELSE 'dense' END, query_id, key, CAST(rank AS INTEGER) FROM h3 WHERE route IN ('bm25', 'dense') AND rank <= 20")
def r17_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The same questions in every search mode."""
    return reduce(DataFrame.unionByName, (retrieve(spark, d, m) for m in ("lexical", "dense", "hybrid")))


@register(
    "r4_matrix_bm25f",
    f"""
    WITH q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({Q_TOK}) AS term FROM eval_items) GROUP BY ALL),
    l AS (SELECT doc_id, 'title' AS field, 2.0 AS w, {TOK.format("coalesce(title, '')")} AS toks FROM documents UNION ALL SELECT doc_id, 'source', 1.25, {TOK.format("coalesce(source, '')")} FROM documents UNION ALL SELECT doc_id, 'text', 1.0, {TOK.format("coalesce(text, '')")} FROM documents),
    a AS (SELECT field, avg(len(toks)) AS a FROM l GROUP BY field),
    p AS (SELECT doc_id, field, term, count(*) AS tf, any_value(w) AS w, any_value(dl) AS dl FROM (SELECT doc_id, field, w, len(toks) AS dl, unnest(toks) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, field, term),
    x AS (SELECT doc_id, term, sum(w * tf / (1 - 0.75 + 0.75 * dl / a)) AS x FROM p JOIN a USING (field) GROUP BY doc_id, term), f AS (SELECT term, count(*) AS df FROM x GROUP BY term),
    sc AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * x * 2.2 / (x + 1.2)), 9) AS score FROM q JOIN f USING (term) JOIN x USING (term), (SELECT count(*) AS n FROM documents) GROUP BY query_id, doc_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10
    """,
)
def r4_matrix_bm25f(spark: SparkSession, d: str) -> DataFrame:
    """Fielded BM25 whose document frequency counts weighted fields only."""
    return search.bm25_fields(docs(spark, d), eval_queries(spark, d), {f: w for f, w in _FIELDS.items() if w}).withColumn("score", F.round("score", 6))


@register("r8_renormalised_dense", "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: 3 * x) AS big FROM embeddings), q AS (SELECT vec_id, list_transform(big, lambda x: x / sqrt(list_dot_product(big, big))) AS e FROM n WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(q.e, n.e), 6) AS score FROM q, n WHERE q.vec_id <> n.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 20")
def r8_renormalised_dense(spark: SparkSession, d: str) -> DataFrame:
    """Queries that come at any length (here three times too long) are brought to length 1 first."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select("vec_id", search.unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("embedding"))
    return search.dense_top_k(v, q, 20)


@register("r12_positive_top", f"WITH {_DENSE}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank2 FROM s WHERE score > 0 AND isfinite(score)) SELECT query_id, vec_id, score, CAST(rank2 AS INTEGER) AS rank FROM t WHERE rank2 <= 30")
def r12_positive_top(spark: SparkSession, d: str) -> DataFrame:
    """The best finite and positive scores by a total order."""
    v = table(spark, d, "embeddings")
    hits = search.dense_top_k(v, v.where("vec_id % 100 = 0"), 30)
    return hits.where("score > 0 and not isnan(score)")


@register("r13_snippets", f"WITH {_bm25_sql()} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, substr(d.text, 1, 200) AS snippet, CAST(greatest(length(d.text) - 200, 0) AS INTEGER) AS omitted FROM top JOIN documents d USING (doc_id) JOIN eval_items e ON e.item_id = query_id WHERE rank <= 10 AND length(e.query) <= 160")
def r13_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search of short questions, ten hits with the first 200 characters and how many are left out."""
    hits = search.bm25(docs(spark, d), eval_queries(spark, d).where(F.length("text") <= 160), 10)
    return hits.join(docs(spark, d).select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "rank", F.substring("text", 1, 200).alias("snippet"), F.greatest(F.length("text") - 200, F.lit(0)).alias("omitted"))


def skip_fit_sql(ordered: str, total: str, each: str = "1000000000", most: str = "1000000000") -> str:
    """Common tables o (query_id, i, key, size) and w (query_id, i, reason) of admission in order under budgets, skipping what does not fit."""
    reason = f"CASE WHEN o.size > {each} THEN 'too large' WHEN w.n >= {most} THEN 'no slot' WHEN w.used + o.size > {total} THEN 'no room' ELSE 'admitted' END"
    fits = f"o.size <= {each} AND w.n < {most} AND w.used + o.size <= {total}"
    return f"""o AS ({ordered}), w AS (WITH RECURSIVE w(query_id, i, used, n, reason) AS (SELECT DISTINCT query_id, 0, 0, 0, '' FROM o UNION ALL
        SELECT o.query_id, o.i, CASE WHEN {fits} THEN w.used + o.size ELSE w.used END, CASE WHEN {fits} THEN w.n + 1 ELSE w.n END, {reason} FROM w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1) SELECT * FROM w)"""


_OVERLAP = f"""{_TWO}, b AS (SELECT query_id, key, h.rank, n_chars AS size FROM h JOIN documents ON doc_id = key WHERE route = 'bm25'),
    qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({Q_TOK}) AS term FROM eval_items) GROUP BY ALL),
    dk AS MATERIALIZED (SELECT doc_id, {D_TOK} AS toks FROM documents), dt AS (SELECT doc_id AS key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dk) GROUP BY ALL),
    ov AS (SELECT b.query_id, b.key, any_value(b.rank) AS rank, any_value(b.size) AS size, round(sum(least(qf, tf) / sqrt(dl)), 9) AS score FROM b JOIN qt USING (query_id) JOIN dt ON dt.key = b.key AND dt.term = qt.term GROUP BY ALL)"""


@register("r14_context_choice", f"{_OVERLAP}, {skip_fit_sql("SELECT query_id, key, rank, size, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS i FROM ov", '6000')} SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o.rank) AS INTEGER) AS place, score FROM o JOIN w USING (query_id, i) WHERE reason = 'admitted'")
def r14_context_choice(spark: SparkSession, d: str) -> DataFrame:
    """Context chosen by shared words over the root of the length, best first while it fits 6,000 characters, shown in the order of retrieval."""
    n = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), T.bag(F.col("text")).alias("toks"))
    h = two_lists(spark, d).where("route = 'bm25'").select("query_id", "key", F.col("rank").alias("shown")).join(n, "key")
    dt = h.select("query_id", "key", "shown", "size", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("query_id", "key", "shown", "size", "dl", "term").agg(F.count("*").alias("tf"))
    q = search.query_terms(eval_queries(spark, d), T.bag)
    scored = dt.join(q, ["query_id", "term"]).groupBy("query_id", "key", "shown", "size").agg(F.round(F.sum(F.least("tf", "qf") / F.sqrt("dl")), 9).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    kept = assembly.admit(ranked, total=6000, each=10**9).where("admitted").select("query_id", "key")
    return ranked.join(kept, ["query_id", "key"]).select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy("shown")).alias("place"), "score")


@register("f11_token_budget", f"SELECT item_id, array_to_string(list_concat(['question'], {Q_TOK}[1:12], ['document'], {D_TOK}[1:greatest(0, 40 - 3 - len({Q_TOK}[1:12]))], ['answer']), ' ') AS prompt, len({D_TOK}) > greatest(0, 40 - 3 - len({Q_TOK}[1:12])) AS cut FROM eval_items")
def f11_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of 40 tokens: frame and question stay whole, the document is cut at its end."""
    e = table(spark, d, "eval_items")
    q, t = F.slice(T.analyze(F.col("query")), 1, 12), T.analyze(F.col("text"))
    return e.select("item_id", *fusion.within_budget(F.concat(F.array(F.lit("question")), q, F.array(F.lit("document"))), t, F.array(F.lit("answer")), 40))


@register("f16_stratified_sample", "WITH x AS (SELECT doc_id, coalesce(source, '-') AS category, sha256('sample:' || doc_id) AS h FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h) AS n FROM x), o AS (SELECT *, row_number() OVER (ORDER BY n > 1, h) AS place FROM c) SELECT doc_id, category, n = 1 AS for_coverage FROM o WHERE place <= 42")
def f16_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 42 in hash order in which every category stands at least once."""
    x = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("category"))
    return fusion.covering_sample(x, "doc_id", "category", "sample", 42)


@register("a5_index_percentile", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[CAST(floor(0.95::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS p95, round(list_median(v), 9) AS median FROM s")
def a5_index_percentile(spark: SparkSession, d: str) -> DataFrame:
    """The value at index int(0.95 * (n - 1)) and the averaged median, from counted values."""
    c = statistics.value_counts(table(spark, d, "events"), ["event_type"], "value")
    n = F.col("total")
    at = lambda i, name: statistics.at_index(c, ["event_type"], i, name)
    mid = at(F.floor((n - 1) / 2), "lo").join(at(F.floor(n / 2), "hi"), "event_type").select("event_type", F.round((F.col("lo") + F.col("hi")) / 2, 9).alias("median"))
    return at(F.floor(F.lit(0.95) * (n - 1)), "p95").join(mid, "event_type")


@register("a10_cost_report", "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(CASE WHEN n = 1 THEN value END) AS first, round(median(value) FILTER (WHERE n > 1), 6) AS later_median, round(sum(value) / (SELECT sum(value) FROM s), 6) AS share FROM s GROUP BY event_type")
def a10_cost_report(spark: SparkSession, d: str) -> DataFrame:
    """Sum, median, 95th percentile, first value and median of the later ones of each channel, and its share of everything."""
    e = table(spark, d, "events").where("value is not null")
    return statistics.cost_report(e, "event_type", "value", ["ts", "event_id"])


_SIDES = "s AS (SELECT doc_id, coalesce(lang, '-') AS lang, CASE WHEN CAST('0x' || substr(sha256('run-1:' || doc_id), 1, 2) AS INTEGER) % 2 = 0 THEN 'AB' ELSE 'BA' END AS sides, CASE n_chars % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'same' END AS said FROM documents)"


@register("a15_blind_tally", f"WITH {_SIDES} SELECT lang, count(CASE WHEN (said = 'left' AND sides = 'AB') OR (said = 'right' AND sides = 'BA') THEN 1 END) AS first_better, count(CASE WHEN (said = 'right' AND sides = 'AB') OR (said = 'left' AND sides = 'BA') THEN 1 END) AS second_better, count(CASE WHEN said = 'same' THEN 1 END) AS same, count(CASE WHEN said IS NULL THEN 1 END) AS open FROM s GROUP BY lang")
def a15_blind_tally(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts given blindly (here from the length), unblinded by the assignment of sides and counted by language."""
    x = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), statistics.blind_sides("run-1", F.col("doc_id")).alias("sides"), F.element_at(F.create_map(*(F.lit(v) for v in (0, "left", 1, "right", 2, "same"))), (F.col("n_chars") % 4).cast("int")).alias("said"))
    return statistics.blind_tally(x, "lang")


_SAME = f"WITH {_bm25_sql()}, hit AS (SELECT query_id, rank, d.lang = e.lang AS good FROM top JOIN documents d USING (doc_id) JOIN eval_items e ON e.item_id = query_id WHERE rank <= 10), b AS (SELECT query_id, min(CASE WHEN good THEN rank END) AS first, avg(CASE WHEN good THEN 1.0 ELSE 0 END) AS share FROM hit GROUP BY query_id)"


@register("m4_slices", f"{_SAME}, x AS (SELECT b.*, unnest(['all', 'track ' || coalesce(track, '-'), 'split ' || coalesce(split, '-'), 'lang ' || coalesce(lang, '-')]) AS slice FROM b JOIN eval_items ON item_id = query_id) SELECT slice, count(*) AS n, round(avg(share), 6) AS share, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM x GROUP BY slice")
def m4_slices(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by slice of the items, a hit being good if it is of the item's language."""
    e = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("lang").alias("want"), "track", "split")
    h = search.bm25(docs(spark, d), eval_queries(spark, d), 10).join(docs(spark, d).select("doc_id", "lang"), "doc_id").join(e, "query_id")
    good = F.coalesce(F.col("lang") == F.col("want"), F.lit(False))
    b = h.groupBy("query_id", "want", "track", "split").agg(F.min(F.when(good, F.col("rank"))).alias("first"), F.avg(good.cast("double")).alias("share"))
    word = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("-")))
    x = b.select("first", "share", F.explode(F.array(F.lit("all"), word("track ", "track"), word("split ", "split"), word("lang ", "want"))).alias("slice"))
    return x.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("share"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def _analyzer_sql(name: str, tok: str, field: str) -> str:
    return f"""(WITH q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({tok.format("query")}) AS term FROM eval_items) GROUP BY ALL), d AS (SELECT doc_id, lang, {tok.format(field)} AS toks FROM documents WHERE {field} IS NOT NULL),
      p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d),
      sc AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a)))), 9) AS score FROM q JOIN f USING (term) JOIN p USING (term), st GROUP BY query_id, doc_id),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
      SELECT '{name}' AS analyzer, '{field}' AS arm, count(*) AS hits, round(avg(CASE WHEN d.lang = e.lang THEN 1.0 ELSE 0 END), 6) AS same_language FROM t JOIN d USING (doc_id) JOIN eval_items e ON e.item_id = query_id WHERE rank <= 10)"""


@register("m5_analyzer_matrix", " UNION ALL ".join(f"SELECT * FROM {_analyzer_sql(n, t, f)}" for n, t in (("A", TOK), ("B", _BI)) for f in ("title", "text")))
def m5_analyzer_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Two analyzers by two arms on the same questions."""
    parts = []
    langs = docs(spark, d).select("doc_id", "lang")
    want = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("lang").alias("want"))
    for name, tokens in (("A", T.bag), ("B", T.analyze_with_bigrams)):
        for arm in ("title", "text"):
            rows = docs(spark, d).select("doc_id", F.col(arm).alias("text"))
            h = search.bm25(rows, eval_queries(spark, d), 10, tokens=tokens).join(langs, "doc_id").join(want, "query_id")
            parts.append(h.agg(F.count("*").alias("hits"), F.round(F.avg(F.coalesce((F.col("lang") == F.col("want")).cast("double"), F.lit(0.0))), 6).alias("same_language")).select(F.lit(name).alias("analyzer"), F.lit(arm).alias("arm"), "hits", "same_language"))
    return reduce(DataFrame.unionByName, parts)


_POSTED = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM k_{f}) GROUP BY doc_id, term" for f in ("title", "text"))


@register("s17_postings", f"WITH k_title AS MATERIALIZED (SELECT doc_id, {TOK.format('title')} AS toks FROM documents WHERE title IS NOT NULL), k_text AS MATERIALIZED (SELECT doc_id, {D_TOK} AS toks FROM documents WHERE text IS NOT NULL) {_POSTED}")
def s17_postings(spark: SparkSession, d: str) -> DataFrame:
    """The postings table that a lexical index is: field, document, term, frequency and length."""
    part = lambda f: search.postings(docs(spark, d).select("doc_id", F.col(f).alias("text")).where("text is not null"), T.bag).select(F.lit(f).alias("field"), "doc_id", "term", "tf", "dl")
    return part("title").unionByName(part("text"))


@register("v9_index_readback", f"WITH p AS (SELECT doc_id, count(*) AS terms, sum(tf) AS tokens FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({D_TOK}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, term) GROUP BY doc_id), s AS (SELECT doc_id, len({D_TOK}) AS dl FROM documents) SELECT s.doc_id, coalesce(p.terms, 0) AS terms, CAST(coalesce(p.tokens, 0) AS BIGINT) AS tokens, coalesce(p.tokens, 0) = s.dl AS whole FROM s LEFT JOIN p USING (doc_id)")
def v9_index_readback(spark: SparkSession, d: str) -> DataFrame:
    """An index read back against its source: tokens of every document counted in both."""
    p = search.postings(docs(spark, d).select("doc_id", "text").where("text is not null"), T.bag).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))
    s = docs(spark, d).select("doc_id", F.size(T.analyze(F.col("text"))).alias("want"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return s.join(p, "doc_id", "left").select("doc_id", zero(F.col("terms")).alias("terms"), zero(F.col("tokens")).alias("tokens"), (zero(F.col("tokens")) == F.col("want")).alias("whole"))


@register("s16_sparse_rows", f"SELECT doc_id, array_to_string(list(term ORDER BY term), ' ') AS terms, array_to_string(list(CAST(tf AS VARCHAR) ORDER BY term), ' ') AS weights, CAST(count(*) AS INTEGER) AS nnz FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({D_TOK}) AS term FROM documents) WHERE ascii(term) < 128 GROUP BY doc_id, term) GROUP BY doc_id")
def s16_sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    """Postings of ASCII terms as sparse rows: sorted terms, their weights, and how many."""
    p = search.postings(docs(spark, d).select("doc_id", "text"), T.bag).where(F.ascii("term") < 128)
    g = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("string").alias("tf")))).alias("x"))
    return g.select("doc_id", F.array_join("x.term", " ").alias("terms"), F.array_join("x.tf", " ").alias("weights"), F.size("x").alias("nnz"))


@register("j1_granularity_contract", f"{_ROUTES3}, x AS (SELECT query_id, channel, key, CASE WHEN (query_id + key) % 11 = 0 THEN 'macro' ELSE granularity END AS said FROM r3 UNION ALL SELECT query_id, 'bm25', -key, 'micro' FROM h3 WHERE route = 'bm25' AND rank = 50) SELECT channel, count(*) AS n, count(CASE WHEN g.key IS NULL THEN 1 END) AS unknown, count(CASE WHEN g.granularity <> said THEN 1 END) AS other_granularity FROM x LEFT JOIN g USING (key) GROUP BY channel")
def j1_granularity_contract(spark: SparkSession, d: str) -> DataFrame:
    """Hits joined with their documents under the contract: the document must exist and have the granularity of the hit; some hits were given a flaw."""
    h = routes3(spark, d).select("query_id", "channel", "key", F.when((F.col("query_id") + F.col("key")) % 11 == 0, "macro").otherwise(F.col("granularity")).alias("said"))
    bad = three_lists(spark, d).where("route = 'bm25' and rank = 50").select("query_id", F.lit("bm25").alias("channel"), (-F.col("key")).alias("key"), F.lit("micro").alias("said"))
    g = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("n_chars") < 700, "micro").otherwise("macro").alias("granularity"))
    j = h.unionByName(bad).join(g, "key", "left")
    return j.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("granularity").isNull()).alias("unknown"), F.count_if(F.col("granularity") != F.col("said")).alias("other_granularity"))


@register("m10_item_checks", "SELECT 'repeated item' AS problem, count(*) - count(DISTINCT item_id) AS n FROM eval_items UNION ALL SELECT 'unknown language', count(*) FILTER (WHERE lang NOT IN ('zh', 'en', 'ja')) FROM eval_items UNION ALL SELECT 'no split', count(*) FILTER (WHERE split IS NULL) FROM eval_items UNION ALL SELECT 'empty query', count(*) FILTER (WHERE trim(coalesce(query, '')) = '') FROM eval_items UNION ALL SELECT 'query of several items', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM eval_items GROUP BY query HAVING count(*) > 1) UNION ALL SELECT 'text of several splits', count(*) FROM (SELECT text FROM eval_items GROUP BY text HAVING count(DISTINCT split) > 1)")
def m10_item_checks(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of the evaluation items: unique, of known languages, in a split, with a query of their own, no text in two splits."""
    e = table(spark, d, "eval_items")
    one = e.agg((F.count("*") - F.countDistinct("item_id")).alias("repeated item"), F.count_if(~F.col("lang").isin("zh", "en", "ja")).alias("unknown language"), F.count_if(F.col("split").isNull()).alias("no split"), F.count_if(F.trim(F.coalesce("query", F.lit(""))) == "").alias("empty query"))
    many = e.groupBy("query").agg(F.count("*").alias("c")).where("c > 1").agg(F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("query of several items"))
    both = e.groupBy("text").agg(F.countDistinct("split").alias("c")).where("c > 1").agg(F.count("*").alias("text of several splits"))
    x = one.crossJoin(many).crossJoin(both)
    return x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(f"`{c}`").alias("n")) for c in x.columns))).alias("p")).select("p.*")
