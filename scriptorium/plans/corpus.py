"""Queries of text analysis, chunking and duplicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.grams import with_gram_sets
from ..functions.tokens import Tokens
from ..functions.unicode import alnum_runs, nfkc_fold
from ..operators import chunking, dedupe
from ..session import table
from .registry import register
from .search import _BI, D_TOK, WORDS


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "title", "source", "record_key")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").select("id", F.col("question").alias("text")).distinct()


# Fixed value: width forms and their ordinary characters, by rule.
_BLANKS = "\u00a0\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + _BLANKS
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " " * len(_BLANKS)


def folded_sql(c: str) -> str:
    """NFKC and case folding as SQL can say it: composition, width forms, lower case, blanks."""
    wide, plain = (x.replace("'", "''") for x in (_WIDE, _PLAIN))
    return f"trim(regexp_replace(lower(translate(replace(replace(nfc_normalize({c}), '…', '...'), '‥', '..'), '{wide}', '{plain}')), '\\s+', ' ', 'g'))"


@register("t1_analyze", f"SELECT doc_id, array_to_string({D_TOK}, ' ') AS tokens FROM documents")
def t1_analyze(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(T.analyze(F.col("text")), " ").alias("tokens"))


@register("t2_bigrams", f"SELECT DISTINCT id, array_to_string({_BI.format('question')}, ' ') AS tokens FROM turns")
def t2_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", F.array_join(T.analyze_with_bigrams(F.col("text")), " ").alias("tokens"))


# Letters and digits of the scripts in the tables, Han aside; the pattern is for an engine without subtraction of classes.
_OTHER = r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Hiragana}\p{Katakana}\p{Hangul}\p{N}\x{30fc}]"
_HAN_SQL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}]"


def runs_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '({_HAN_SQL}+|{_OTHER}+)')"


def channel_sql(c: str, n: int) -> str:
    """Overlapping n-grams of Han runs and whole other runs in lower case, as one list."""
    return f"flatten(list_transform({runs_sql(c)}, lambda r: CASE WHEN regexp_matches(r, '^{_HAN_SQL}') THEN list_transform(range(1, greatest(length(r) - {n} + 2, 1)), lambda i: substr(r, i, {n})) ELSE [lower(r)] END))"


@register("t3_runs", f"SELECT DISTINCT id, array_to_string(list_transform({runs_sql('question')}, lambda r: lower(r)), ' ') AS runs FROM turns")
def t3_runs(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", F.array_join(alnum_runs("text"), " ").alias("runs"))


@register("t4_channels", f"SELECT DISTINCT id, array_to_string({channel_sql('question', 1)}, ' ') AS unigrams, array_to_string({channel_sql('question', 2)}, ' ') AS bigrams FROM turns")
def t4_channels(spark: SparkSession, d: str) -> DataFrame:
    one, two = T.han_channels(F.col("text"))
    return questions(spark, d).select("id", F.array_join(one, " ").alias("unigrams"), F.array_join(two, " ").alias("bigrams"))


@register("t6_nfkc_fold", f"SELECT doc_id, {folded_sql('text')} AS norm FROM documents")
def t6_nfkc_fold(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", nfkc_fold("text").alias("norm"))


@register("t7_without_space", r"SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS squeezed FROM documents")
def t7_without_space(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.without_space(F.col("text")).alias("squeezed"))


@register("t8_ngram_sets", "SELECT doc_id, CAST(count(DISTINCT g) AS INTEGER) AS n3 FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS g FROM documents WHERE length(text) >= 3) GROUP BY doc_id")
def t8_ngram_sets(spark: SparkSession, d: str) -> DataFrame:
    return with_gram_sets(docs(spark, d).where(F.length("text") >= 3).select("doc_id", "text"), "text", 3).select("doc_id", F.size("g").alias("n3"))


@register("t13_sentences", r"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？!?\n]*(?:[。！？!?]+[”’」』）)"]*|\n|$)'), lambda x: x <> '') AS p FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS i, p[i + 1] AS sentence FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM s)""")
def t13_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(T.sentences(F.col("text")), lambda x: x != "")
    return docs(spark, d).select("doc_id", F.posexplode(parts).alias("i", "sentence"))


@register("t14_fragments", 'SELECT doc_id, CAST(i AS INTEGER) AS "index", CAST(n AS INTEGER) AS "count", CAST(i * 1200 AS INTEGER) AS "start", substr(text, i * 1200 + 1, 1200) AS text FROM (SELECT doc_id, text, n, unnest(range(n)) AS i FROM (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / 1200)) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL))')
def t14_fragments(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text is not null").select("doc_id", F.explode(T.fragments(F.col("text"))).alias("f")).select("doc_id", "f.*")


_SPLIT = """WITH RECURSIVE w(doc_id, piece_no, s, e) AS (
    SELECT doc_id, -1, 0, 0 FROM documents WHERE text <> '' UNION ALL
    SELECT w.doc_id, w.piece_no + 1, w.e, CASE WHEN length(d.text) - w.e <= 2000 THEN length(d.text) ELSE w.e + coalesce(nullif(1000 + length(regexp_extract(substr(d.text, w.e + 1001, 1000), '(?s)^.*\\n')), 1000), 2000) END
    FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE w.e < length(d.text))
    SELECT doc_id, piece_no, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM w WHERE piece_no >= 0"""


@register("t15_newline_split", _SPLIT)
def t15_newline_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(docs(spark, d), lambda t: chunking.newline_split(t, 2000)).drop("text")


@register("t19_citations", r"WITH r AS (SELECT DISTINCT turn, attempt, event_no, t FROM (SELECT turn, attempt, event_no, array_to_string(list_transform(list_filter(item.content, lambda c: c IS NOT NULL), lambda c: coalesce(c.text, '')), '') AS t FROM p05_responses_multimessage WHERE item.content IS NOT NULL)) SELECT turn, attempt, event_no, CAST(unnest(regexp_extract_all(t, '\[E0*(\d+)\]', 1)) AS INTEGER) AS cited FROM r")
def t19_citations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "p05_responses_multimessage").where("item.content is not null")
    body = F.array_join(F.transform(F.filter("item.content", lambda c: c.isNotNull()), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    return r.select("turn", "attempt", "event_no", body.alias("t")).distinct().select("turn", "attempt", "event_no", F.explode(T.citations(F.col("t"))).alias("cited"))


_SAID = "r AS (SELECT DISTINCT turn, attempt, event_no, array_to_string(list_transform(list_filter(item.content, lambda c: c IS NOT NULL), lambda c: coalesce(c.text, '')), '') AS t FROM p05_responses_multimessage WHERE item.content IS NOT NULL AND item.phase = 'final_answer')"


@register("t19_citation_check", rf"WITH {_SAID}, x AS (SELECT turn, attempt, event_no, list_transform(regexp_extract_all(t, '\[E0*(\d{{1,9}})\]', 1), lambda x: CAST(x AS INTEGER)) AS cited, len(regexp_extract_all(t, '\[[Ee][^\[\]]*\]')) AS marks, len(regexp_extract_all(t, '\[E\d+\]')) AS well FROM r) SELECT turn, attempt, event_no, CASE WHEN marks > well THEN 'malformed' WHEN len(list_filter(cited, lambda c: c < 1 OR c > 8)) > 0 THEN 'unknown' WHEN len(list_distinct(cited)) < 1 THEN 'too few' ELSE 'fine' END AS state, CAST(len(list_distinct(cited)) AS INTEGER) AS cited FROM x")
def t19_citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Citations of final answers: malformed marks, numbers that no evidence has (here above 8), too few, or fine."""
    r = table(spark, d, "p05_responses_multimessage").where("item.content is not null and item.phase = 'final_answer'")
    t = F.array_join(F.transform(F.filter("item.content", lambda c: c.isNotNull()), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    x = r.select("turn", "attempt", "event_no", t.alias("t")).distinct()
    count = lambda p: F.size(F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1)))
    cited = F.transform(F.regexp_extract_all("t", F.lit(r"\[E0*(\d{1,9})\]"), F.lit(1)), lambda c: c.cast("int"))
    state = F.when(count(r"\[[Ee][^\[\]]*\]") > count(r"\[E\d+\]"), "malformed").when(F.exists("cited", lambda c: (c < 1) | (c > 8)), "unknown").when(F.size("cited") < 1, "too few").otherwise("fine")
    return x.withColumn("cited", cited).select("turn", "attempt", "event_no", state.alias("state"), F.size(F.array_distinct("cited")).alias("cited"))


@register("t20_content_id", r"SELECT doc_id, nullif(regexp_extract('/ys/obc/content/' || split_part(record_key, ':', 3) || '/detail', '^/ys/obc/content/(\d+)/detail(?:[?#].*)?$', 1), '') AS content_id FROM documents")
def t20_content_id(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("/ys/obc/content/"), F.split_part("record_key", F.lit(":"), F.lit(3)), F.lit("/detail"))
    return docs(spark, d).select("doc_id", T.content_id(url).alias("content_id"))


@register("t22_hashes", "SELECT doc_id, sha256(text) AS sha, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents")
def t22_hashes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.sha256(F.col("text")).alias("sha"), F.octet_length("text").alias("bytes"))


# ---- chunking ----------------------------------------------------------------------------------


@register("c1_split_long")
def c1_split_long(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into pieces of at most 384 tokens that end with a sentence where one does."""
    tokens = spark.sparkContext.broadcast(Tokens())
    return chunking.pieces(docs(spark, d), lambda t: chunking.split_long(t, 384, tokens.value)).drop("text")


@register("c2_pack")
def c2_pack(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed to 240 tokens, never above 384."""
    tokens = spark.sparkContext.broadcast(Tokens())
    return chunking.pieces(docs(spark, d), lambda t: chunking.pack(t, 240, 384, tokens.value)).drop("text")


@register("c3_chunks")
def c3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of two grains in tokens."""
    return chunking.chunks(docs(spark, d), tokens=Tokens()).withColumn("granularities", F.array_join("granularities", "+"))


_COVERED = "SELECT doc_id, g AS granularity, true AS contiguous, CAST(length(text) AS INTEGER) AS covered, true AS same_text FROM documents, (SELECT unnest(['micro', 'macro']) AS g) WHERE text <> ''"


@register("c3_coverage", _COVERED)
def c3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the chunks of each grain lie end to end, cover the text and put together give it again."""
    c = chunking.chunks(docs(spark, d), tokens=Tokens()).select("doc_id", F.explode("granularities").alias("granularity"), "start", "end", "text")
    g = c.groupBy("doc_id", "granularity").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("x"))
    n = F.size("x")
    together = F.forall(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.col("x")[i - 1]["start"] == F.col("x")[F.greatest(i - 2, F.lit(0))]["end"])) & (F.col("x")[0]["start"] == 0)
    whole = F.array_join(F.col("x.text"), "")
    return g.join(docs(spark, d).select("doc_id", F.col("text").alias("t")), "doc_id").select("doc_id", "granularity", together.alias("contiguous"), (F.element_at("x", -1)["end"] - F.col("x")[0]["start"]).alias("covered"), (whole == F.col("t")).alias("same_text"))


_GREEDY = """
    s AS ({sizes}),
    f AS (SELECT * FROM s WHERE i = 0),
    z AS (WITH RECURSIVE w(owner, i, batch, used, items) AS (SELECT owner, i, 0, size, 1 FROM f UNION ALL
          SELECT s.owner, s.i, CASE WHEN w.used + s.size > {most} OR w.items >= {count} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + s.size > {most} OR w.items >= {count} THEN s.size ELSE w.used + s.size END,
          CASE WHEN w.used + s.size > {most} OR w.items >= {count} THEN 1 ELSE w.items + 1 END FROM w JOIN s ON s.owner = w.owner AND s.i = w.i + 1) SELECT * FROM w)
"""
_LINE_SIZES = "SELECT doc_id AS owner, i, length(p[i + 1]) + 1 AS size FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"


def greedy_sql(sizes: str, most: int, count: int = 1_000_000_000) -> str:
    """Common tables s (owner, i, size) and z (owner, i, batch) of sequential greedy batches, to stand behind WITH."""
    return _GREEDY.format(sizes=sizes, most=most, count=count)


def _batches(rows: DataFrame, key: str, most: int, count: int | None = None) -> DataFrame:
    """(key, batch, items, size) of sequential greedy batches over rows (key, sizes)."""

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, sizes in enumerate(b.column(1).to_pylist()):
                sums: dict[int, list[int]] = {}
                for size, n in zip(sizes, chunking.greedy_batches(sizes, most, count)):
                    x = sums.setdefault(n, [0, 0])
                    x[0] += 1
                    x[1] += size
                at += [i] * len(sums)
                out += [(n, *x) for n, x in sums.items()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([x[j] for x in out], pa.int32()) for j in range(3))], names=[key, "batch", "items", "size"])

    return rows.select(key, "sizes").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, batch int, items int, size int")


@register("c6_char_batches", f"WITH {greedy_sql(_LINE_SIZES, 1400)} SELECT owner AS doc_id, CAST(batch AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS items, CAST(sum(size) AS INTEGER) AS size FROM z JOIN s USING (owner, i) GROUP BY owner, batch")
def c6_char_batches(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document in sequential batches of at most 1,400 characters."""
    lines = docs(spark, d).where("text is not null").select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.length(x) + 1).alias("sizes"))
    return _batches(lines, "doc_id", 1400)


@register("s21_request_shards", f"WITH {greedy_sql("SELECT record_key AS owner, row_number() OVER (PARTITION BY record_key ORDER BY doc_id) - 1 AS i, octet_length(encode(text)) AS size FROM documents WHERE record_key IS NOT NULL AND text IS NOT NULL", 20000, 12)} SELECT owner AS record_key, CAST(batch AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS items, CAST(sum(size) AS INTEGER) AS size FROM z JOIN s USING (owner, i) GROUP BY owner, batch")
def s21_request_shards(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a record packed in order into shards of at most 12 requests and 20,000 bytes; only the sizes are gathered, not the texts."""
    rows = table(spark, d, "documents").where("record_key is not null and text is not null").select("record_key", "doc_id", F.octet_length("text").alias("size"))
    g = rows.groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("doc_id", "size"))).alias("x"))
    return _batches(g.select("record_key", F.col("x.size").alias("sizes")), "record_key", 20_000, 12)


@register("c5_structured_lines", f"WITH l AS (SELECT doc_id, p[i + 1] AS line, i FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))) SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS kept_chars, max(length(line)) > 200 AS cut_lines FROM l GROUP BY doc_id")
def c5_structured_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines packed into fragments of at most 200 characters: nothing is lost, only lines too long for themselves are cut."""

    def read(text: str) -> list[tuple]:
        lines = text.split("\n")
        fragments = chunking.structured_lines(lines, 200)
        assert all(sum(e - s for _, s, e in f) + len(f) - 1 <= 200 for f in fragments)
        parts = [x for f in fragments for x in f]
        return [(sum(e - s for _, s, e in parts), any(s > 0 for _, s, _ in parts))]

    from ..operators.markup import per_value

    return per_value(docs(spark, d), "doc_id", "text", read, "kept_chars long, cut_lines boolean")


@register("t16_snippets", "SELECT doc_id, CAST(i AS INTEGER) AS snippet, substr(text, i * 1000 + 1, 1000) AS body, CAST(len(string_split(substr(text, 1, i * 1000), chr(10))) - 1 AS INTEGER) AS first_line FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil(length(text) / 1000)) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL)")
def t16_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of 1,000 characters with the number of the line they begin in."""
    f = docs(spark, d).where("text is not null").select("doc_id", "text", F.explode(T.fragments(F.col("text"), 1000)).alias("f"))
    breaks = F.length(F.substring(F.col("text"), F.lit(1), F.col("f.start"))) - F.length(F.replace(F.substring(F.col("text"), F.lit(1), F.col("f.start")), F.lit("\n"), F.lit("")))
    return f.select("doc_id", F.col("f.index").alias("snippet"), F.col("f.text").alias("body"), breaks.alias("first_line"))


@register("t17_stages", r"WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n(?:#\s+|（点位\s*\d+）)'), lambda x: trim(x) <> '') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(i AS INTEGER) AS stage, p[i + 1] AS body FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM p)")
def t17_stages(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into stages at heading lines and numbered places."""
    parts = F.filter(F.split("text", r"\n(?:#\s+|（点位\s*\d+）)", -1), lambda x: F.trim(x) != "")
    return docs(spark, d).where("text is not null").select("doc_id", F.posexplode(parts).alias("stage", "body"))


@register("t18_token_windows")
def t18_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous windows of at most 256 tokens."""
    tokens = spark.sparkContext.broadcast(Tokens())
    return chunking.pieces(docs(spark, d), lambda t: chunking.token_windows(t, 256, tokens.value)).drop("text")


@register("t21_byte_estimate", "SELECT doc_id, CAST(octet_length(encode(to_json({'doc_id': doc_id, 'lang': coalesce(lang, ''), 'title': coalesce(title, '')}))) AS INTEGER) AS bytes FROM documents")
def t21_byte_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The size of a document's head as the UTF-8 bytes of its JSON, keys in order."""
    head = F.to_json(F.struct("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("title", F.lit("")).alias("title")))
    return table(spark, d, "documents").select("doc_id", F.octet_length(head).alias("bytes"))


@register("t5_words", rf"SELECT DISTINCT id, array_to_string(regexp_extract_all(lower(question), '({"|".join(WORDS)}|[a-z0-9]+|[\x{{3400}}-\x{{9fff}}])'), ' ') AS words FROM turns WHERE question IS NOT NULL")
def t5_words(spark: SparkSession, d: str) -> DataFrame:
    """Words by a dictionary, the longest first, single characters elsewhere; marks and blanks are no words."""
    return questions(spark, d).where("text is not null").select("id", F.array_join(T.dictionary_words(F.col("text"), list(WORDS)), " ").alias("words"))


@register("c7_unit_levels", "WITH u AS (SELECT record_key AS record, coalesce(source, '-') AS section, CAST(doc_id AS VARCHAR) AS unit, n_chars AS size FROM documents), s AS (SELECT *, sum(size) OVER (PARTITION BY record, section) AS ss, sum(size) OVER (PARTITION BY record) AS rs FROM u WHERE record IS NOT NULL) SELECT record, section, unit, size, CASE WHEN rs <= 20000 THEN 'record' WHEN ss <= 20000 THEN 'section' ELSE 'unit' END AS level, CASE WHEN rs <= 20000 THEN record WHEN ss <= 20000 THEN record || '/' || section ELSE record || '/' || section || '/' || unit END AS pack, size > 20000 AS oversize FROM s")
def c7_unit_levels(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").where("record_key is not null").select(F.col("record_key").alias("record"), F.coalesce("source", F.lit("-")).alias("section"), F.col("doc_id").cast("string").alias("unit"), F.col("n_chars").alias("size"))
    return chunking.unit_levels(u, 20_000)


@register("c11_aliases", "WITH g AS (SELECT min(doc_id) AS key, count(*) AS n, list_sort(list(doc_id)) AS l FROM documents GROUP BY coalesce(source, ''), coalesce(text, '')) SELECT key, array_to_string(l[2:], ' ') AS aliases FROM g WHERE n > 1")
def c11_aliases(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fold_aliases(docs(spark, d), "doc_id", "source", "text").select("key", F.array_join(F.col("aliases").cast("array<string>"), " ").alias("aliases"))


# ---- duplicates --------------------------------------------------------------------------------


@register("u1_exact_groups", f"WITH n AS (SELECT doc_id AS key, {folded_sql('text')} AS t FROM documents) SELECT key, min(key) OVER (PARTITION BY t) AS survivor, count(*) OVER (PARTITION BY t) AS copies FROM n")
def u1_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.exact_groups(docs(spark, d), "doc_id", nfkc_fold("text"))


_GRAMS = "g AS (SELECT DISTINCT key, unnest(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS g FROM b WHERE length(t) >= 3), n AS (SELECT key, count(*) AS n FROM g GROUP BY key), c AS (SELECT x.key AS a, y.key AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.key < y.key GROUP BY ALL), s AS (SELECT a, b, shared, p.n + q.n - shared AS either FROM c JOIN n p ON p.key = a JOIN n q ON q.key = b)"
_Q_BASE = "b AS (SELECT DISTINCT id AS key, question AS t FROM turns)"


@register("u2_near_pairs", f"WITH b AS (SELECT doc_id AS key, text AS t FROM documents), {_GRAMS} SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(either AS INTEGER) AS either FROM s WHERE shared * 100 >= either * 80")
def u2_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose 3-gram sets have a Jaccard similarity of 0.80 or more."""
    return dedupe.similar_pairs(docs(spark, d), "doc_id", "text", 3, 80)


@register("u2_near_questions", f"WITH {_Q_BASE}, {_GRAMS} SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(either AS INTEGER) AS either FROM s WHERE shared * 100 >= either * 50")
def u2_near_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose 3-gram sets have a Jaccard similarity of 0.50 or more."""
    return dedupe.similar_pairs(questions(spark, d), "id", "text", 3, 50)


@register("u3_survivors", f"""WITH RECURSIVE b AS (SELECT DISTINCT id AS key, question AS t FROM turns), {_GRAMS}, e AS (SELECT a, b FROM s WHERE shared * 100 >= either * 50), o AS (SELECT key, row_number() OVER (ORDER BY key) AS i FROM (SELECT DISTINCT key FROM b)),
    near AS (SELECT o.i, list(p.i) AS before FROM e JOIN o ON o.key = e.b JOIN o p ON p.key = e.a GROUP BY o.i), w(i, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT w.i + 1, CASE WHEN n.before IS NOT NULL AND list_has_any(n.before, w.kept) THEN w.kept ELSE list_append(w.kept, w.i + 1) END FROM w JOIN o ON o.i = w.i + 1 LEFT JOIN near n ON n.i = o.i)
    SELECT o.key, list_contains((SELECT arg_max(kept, i) FROM w), o.i) AS kept FROM o""")
def u3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Questions in order of their keys, a later one rejected if it is close to a kept one."""
    q = questions(spark, d)
    return dedupe.greedy_survivors(q.select(F.col("id").alias("key")), dedupe.similar_pairs(q, "id", "text", 3, 50).select("a", "b"))


_SQUEEZED = r"a AS (SELECT doc_id AS k, regexp_replace(text, '\s+', '', 'g') AS t FROM documents), i AS (SELECT item_id AS q, regexp_replace({c}, '\s+', '', 'g') AS t FROM eval_items)"
_WINDOWS = "w AS (SELECT DISTINCT k, unnest(list_transform(range(1, length(t) - {n} + 2), lambda j: substr(t, j, {n}))) AS w FROM a WHERE length(t) >= {n}), v AS (SELECT DISTINCT q, unnest(list_transform(range(1, length(t) - {n} + 2), lambda j: substr(t, j, {n}))) AS w FROM i WHERE length(t) >= {n})"


@register("u4_contaminated", f"WITH {_SQUEEZED.format(c='text')}, {_WINDOWS.format(n=20)} SELECT DISTINCT k AS doc_id, q AS item_id FROM w JOIN v USING (w)")
def u4_contaminated(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a run of 20 characters with an item."""
    return dedupe.contaminated(docs(spark, d), "doc_id", table(spark, d, "eval_items"), "item_id", 20)


@register("u4_rejected", f"WITH a AS (SELECT DISTINCT id AS k, regexp_replace(question, '\\s+', '', 'g') AS t FROM turns WHERE question IS NOT NULL), i AS (SELECT item_id AS q, regexp_replace(query, '\\s+', '', 'g') AS t FROM eval_items), {_WINDOWS.format(n=8)}, ga AS (SELECT DISTINCT k, unnest(list_distinct(list_transform(range(1, length(t) - 1), lambda j: substr(t, j, 3)))) AS g FROM a WHERE length(t) >= 3), gi AS (SELECT DISTINCT q, unnest(list_distinct(list_transform(range(1, length(t) - 1), lambda j: substr(t, j, 3)))) AS g FROM i WHERE length(t) >= 3), na AS (SELECT k, count(*) AS n FROM ga GROUP BY k), ni AS (SELECT q, count(*) AS n FROM gi GROUP BY q), c AS (SELECT k, q, count(*) AS c FROM ga JOIN gi USING (g) GROUP BY ALL), al AS (SELECT k, q, 1 AS r FROM a JOIN i ON a.t = i.t WHERE length(a.t) >= 3 UNION ALL SELECT DISTINCT k, q, 2 FROM w JOIN v USING (w) UNION ALL SELECT c.k, c.q, 3 FROM c JOIN na ON na.k = c.k JOIN ni ON ni.q = c.q WHERE c.c * 100 >= (na.n + ni.n - c.c) * 50) SELECT k AS id, q AS item_id, ['exact', 'window', 'similar'][min(r)] AS reason FROM al GROUP BY k, q")
def u4_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Questions rejected beside the items' queries: equal, sharing eight characters, or similar by half of their 3-grams."""
    rows = table(spark, d, "turns").where("question is not null").select("id", F.col("question").alias("text")).distinct()
    return dedupe.rejected(rows, "id", table(spark, d, "eval_items").select("item_id", F.col("query").alias("text")), "item_id")


@register("u7_visible_aliases", "WITH g AS (SELECT text, coalesce(title, '') AS title, min(doc_id) AS kept, max(doc_id) AS alias, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) SELECT kept, alias FROM g WHERE n = 2 AND sources = 2")
def u7_visible_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand exactly twice under equal titles and from two sources: the later one is an alias."""
    return dedupe.visible_aliases(docs(spark, d).withColumn("title", F.coalesce("title", F.lit(""))), "doc_id", ["text", "title"], "source")


_LITERAL = r"WITH p AS (SELECT item_id, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: length(x) >= 12))) AS pat FROM eval_items), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents), h AS (SELECT doc_id, item_id, t, pat FROM d JOIN p ON contains(t, pat)), n AS (SELECT doc_id, item_id, pat, t, unnest(range(length(t) - length(pat) + 1)) AS i FROM h) SELECT doc_id, item_id AS pattern_id, CAST(i AS INTEGER) AS start FROM n WHERE substr(t, i + 1, length(pat)) = pat"


@register("u5_literal_matches", _LITERAL)
def u5_literal_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whole paragraphs of at least 12 visible characters of the evaluation items (a fixed set of 200) found literally in documents."""
    items = table(spark, d, "eval_items").select("item_id", "text").collect()
    patterns = dict.fromkeys((r[0], c) for r in items for p in (r[1] or "").splitlines() if len(c := "".join(p.split())) >= 12)
    return dedupe.literal_matches(docs(spark, d), "doc_id", list(patterns))


@register("u6_near_paragraphs")
def u6_near_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Questions close to a query of the evaluation items (a fixed set of 200)."""
    tests = [(r[0], r[1]) for r in table(spark, d, "eval_items").select("item_id", "query").collect()]
    rows = table(spark, d, "turns").select(F.col("id").alias("key"), F.col("question").alias("text")).distinct()
    return dedupe.near_paragraphs(rows, tests, least=0.6, chars=12)


@register("u6_item_paragraphs")
def u6_item_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents close to one of an evaluation item, with the limits of the reference."""
    tests = [(r[0], p) for r in table(spark, d, "eval_items").select("item_id", "text").collect() for p in (r[1] or "").splitlines()]
    return dedupe.near_paragraphs(dedupe.paragraphs(docs(spark, d), "doc_id"), tests)


@register("u8_repeats", "SELECT question, count(*) AS n, count(DISTINCT session) AS sessions FROM turns GROUP BY question HAVING count(*) > 1")
def u8_repeats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").groupBy("question").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions")).where("n > 1")
