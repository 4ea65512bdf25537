"""Queries of HTML values: visible text, blocks, table grids, layout edits, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup, shapes
from ..session import table
from .registry import register
from .nested import _DETAIL

_RICH = f"""{_DETAIL}, h AS (SELECT root_id, child AS pointer, json_extract_string(v, '$.data') AS data FROM detail WHERE a = 'components'),
    w AS (SELECT DISTINCT root_id || ' ' || pointer AS place, json_extract_string(data, '$.rich_text') AS html FROM h WHERE json_valid(data))"""


def rich_values(spark: SparkSession, d: str) -> DataFrame:
    """(place, html): the markup that page components hold in their data, itself JSON in a string."""
    nodes = shapes.page_nodes(table(spark, d, "obc_detail")).where("array_name = 'components'")
    html = F.get_json_object(F.col("fields")["data"], "$.rich_text")
    return nodes.select(F.concat_ws(" ", "root_id", "pointer").alias("place"), html.alias("html")).where("html is not null").distinct()


@register("t9_rich_text", rf"WITH {_RICH} SELECT place, trim(regexp_replace(regexp_replace(replace(html, '</p>', chr(10)), '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), chr(10) || ' ') AS text, CAST(0 AS INTEGER) AS links FROM w WHERE html IS NOT NULL")
def t9_rich_text(spark: SparkSession, d: str) -> DataFrame:
    def read(html: str) -> list[tuple]:
        got = markup.rich_text(html)
        return [(got["text"], len(got["links"]))]

    return markup.per_value(rich_values(spark, d), "place", "html", read, "text string, links int")


@register("t10_blocks", rf"WITH {_RICH}, ps AS (SELECT place, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS p FROM w WHERE html IS NOT NULL) SELECT place, CAST(i AS INTEGER) AS block_no, 'paragraph' AS kind, p[i + 1] AS text FROM (SELECT place, p, unnest(range(len(p))) AS i FROM ps)")
def t10_blocks(spark: SparkSession, d: str) -> DataFrame:
    read = lambda html: [(b["block_no"], b["kind"], b["text"]) for b in markup.blocks(html)]
    return markup.per_value(rich_values(spark, d), "place", "html", read, "block_no int, kind string, text string")


def nation_tables(spark: SparkSession, d: str) -> DataFrame:
    """(region, html): a table a region whose first cell reaches over the rows of its nations."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    first = F.concat(F.lit('<td rowspan="'), F.size("n").cast("string"), F.lit('">'), F.col("r_name"), F.lit("</td>"))
    lines = F.transform("n", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit("<th>"), x["n_nationkey"].cast("string"), F.lit("</th><td colspan=2> "), x["n_name"], F.lit(" </td></tr>")))
    return g.select("r_name", F.concat(F.lit("<table><tbody>"), F.array_join(lines, "\n"), F.lit("</tbody></table>")).alias("html"))


@register(
    "t11_table_cells",
    """WITH n AS (SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, CAST(i AS INTEGER) AS "row", CAST(c AS INTEGER) AS "column", c = 1 AS header, CASE c WHEN 0 THEN r_name WHEN 1 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS text
    FROM n, (SELECT unnest([0, 1, 2]) AS c) WHERE c > 0 OR i = 0""",
)
def t11_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of generated tables with the columns they stand in, one cell reaching over several rows."""
    read = lambda html: [(c["row"], c["column"], c["header"], c["text"]) for c in markup.table_cells(html)]
    return markup.per_value(nation_tables(spark, d), "r_name", "html", read, "row int, column int, header boolean, text string")


@register("t12_layout_edits", "SELECT doc_id, 'projected' AS status, text || chr(10) AS shown FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<')")
def t12_layout_edits(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents wrapped in layout tags, and the replayed edits that take the tags out again."""

    def read(html: str) -> list[tuple]:
        status, edits = markup.layout_edits(html)
        return [(status, markup.apply_edits(html, edits))]

    rows = table(spark, d, "documents").where("text is not null and not contains(text, '<')")
    html = F.concat(F.lit("<div><p>"), F.replace("text", F.lit("\n"), F.lit("<br>")), F.lit("</p></div>"))
    return markup.per_value(rows.select("doc_id", html.alias("html")), "doc_id", "html", read, "status string, shown string")


def fold_kind(html: str, summary: str, placeholder: str) -> str:
    """What a fold (details with a summary) holds: "placeholder" if only media and placeholder words stand under the given summary, "nested" if a heading or another fold, else "text"."""
    import re

    nodes = markup.Nodes(html)
    kids = nodes.children()
    outer = next((i for i, t in enumerate(nodes.tags) if t == "details"), None)
    if outer is None:
        return "none"
    head = [i for i in kids.get(outer, []) if nodes.tags[i] == "summary"]
    rest = [i for i in kids.get(outer, []) if i not in head]
    if any(t == "details" or re.fullmatch("h[1-6]", t or "") for t in nodes.tags[outer + 1 :]):
        return "nested"
    shown = markup.visible_text(nodes, rest).split("\n")
    if head and markup.visible_text(nodes, kids.get(head[0], [])) == summary and any(shown) and all(re.fullmatch(placeholder, x) for x in shown):
        return "placeholder"
    return "text"


_FOLD = "SELECT id, campaign, question, sequence % 4 AS v FROM (SELECT DISTINCT id, campaign, question, sequence FROM turns WHERE question IS NOT NULL AND NOT contains(question, '<') AND trim(question) <> '')"


@register("folds", f"SELECT id, CASE v WHEN 0 THEN 'placeholder' WHEN 1 THEN 'nested' WHEN 2 THEN 'text' ELSE 'none' END AS fold FROM ({_FOLD})")
def folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds built from turns: with audio placeholders only, with a heading inside, with text, and no fold."""
    t = table(spark, d, "turns").where("question is not null and not contains(question, '<') and trim(question) <> ''").select("id", "question", "sequence").distinct()
    fold = lambda body: F.concat(F.lit("<details><summary>voice</summary>"), body, F.lit("</details>"))
    audio = F.concat(F.lit("<p>audio "), F.col("sequence").cast("string"), F.lit("</p><audio src=x></audio>"))
    html = F.when(F.col("sequence") % 4 == 0, fold(audio)).when(F.col("sequence") % 4 == 1, fold(F.concat(F.lit("<h3>part</h3>"), F.col("question")))).when(F.col("sequence") % 4 == 2, fold(F.concat(F.lit("<p>"), F.col("question"), F.lit("</p>")))).otherwise(F.concat(F.lit("<p>"), F.col("question"), F.lit("</p>")))
    return markup.per_value(t.select("id", html.alias("html")), "id", "html", lambda h: [(fold_kind(h, "voice", r"audio \d+"),)], "fold string")
