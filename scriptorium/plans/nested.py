"""Queries of the nested-record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from ..session import table
from .registry import register

_DETAIL = """
    good AS (SELECT content_key, fetched_at, body, row_number() OVER (PARTITION BY content_key ORDER BY fetched_at DESC NULLS LAST, body) AS n
             FROM obc_detail WHERE ok AND http_status = 200 AND content_key IS NOT NULL AND json_valid(body) AND json_type(body, '$.retcode') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(body, '$.retcode') AS BIGINT) = 0),
    page AS (SELECT json_extract_string(body, '$.data.page.id') AS root_id, json_extract(body, '$.data.page') AS p FROM good WHERE n = 1 AND json_extract_string(body, '$.data.page.id') IS NOT NULL),
    m AS (SELECT root_id, '/data/page' AS parent, '/data/page/modules/' || i AS child, json_extract(p, '$.modules[' || i || ']') AS v, 'modules' AS a
          FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(p, '$.modules'), 0) AS BIGINT))) AS i FROM page)),
    c AS (SELECT root_id, child AS parent, child || '/components/' || i AS child, json_extract(v, '$.components[' || i || ']') AS v, 'components' AS a
          FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(v, '$.components'), 0) AS BIGINT))) AS i FROM m)),
    t AS (SELECT root_id, '/data/page/template_layout' AS parent, '/data/page/template_layout/tab/' || i AS child, json_extract(p, '$.template_layout.tab[' || i || ']') AS v, 'tab' AS a
          FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(p, '$.template_layout.tab'), 0) AS BIGINT))) AS i FROM page)),
    g AS (SELECT root_id, child AS parent, child || '/module_group/' || i AS child, json_extract(v, '$.module_group[' || i || ']') AS v, 'module_group' AS a
          FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(v, '$.module_group'), 0) AS BIGINT))) AS i FROM t)),
    x AS (SELECT root_id, child AS parent, child || '/module/' || i AS child, json_extract(v, '$.module[' || i || ']') AS v, 'module' AS a
          FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(v, '$.module'), 0) AS BIGINT))) AS i FROM g)),
    detail AS (SELECT * FROM (SELECT * FROM m UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t UNION ALL SELECT * FROM g UNION ALL SELECT * FROM x) WHERE json_type(v) = 'OBJECT')
"""  # noqa: E501


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """The page objects, routed to the tables of their arrays and variants."""
    return shapes.routed(shapes.page_nodes(table(spark, d, "obc_detail")))


@register(
    "p4_found",
    f"""
    WITH {_DETAIL},
    r AS (SELECT * FROM canonical_records QUALIFY built_at IS NOT DISTINCT FROM max(built_at) OVER (PARTITION BY record_id)),
    s AS (SELECT record_id, unnest(sections) AS s FROM r),
    l AS (SELECT record_id, lineage FROM r UNION ALL SELECT record_id, s.lineage FROM s
          UNION ALL SELECT record_id, z.lineage FROM (SELECT record_id, unnest(s.component_contexts) AS z FROM s)
          UNION ALL SELECT record_id, z.lineage FROM (SELECT record_id, unnest(s.units) AS z FROM s)),
    k AS (SELECT record_id, lineage.parsed_json_pointer AS parent, unnest(lineage.raw_refs) AS ref FROM l)
    SELECT DISTINCT 'canonical' AS origin, record_id AS root_id, parent AS parent_pointer, ref.json_pointer AS child_pointer FROM k
    WHERE record_id IS NOT NULL AND parent IS NOT NULL AND ref.json_pointer IS NOT NULL
    UNION SELECT DISTINCT 'detail', root_id, parent, child FROM detail
    """,
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    links = shapes.lineage_links(table(spark, d, "canonical_records")).select(F.lit("canonical").alias("origin"), F.col("record_id").alias("root_id"), "parent_pointer", "child_pointer")
    nodes = page_tables(spark, d).select(F.lit("detail").alias("origin"), "root_id", "parent_pointer", F.col("pointer").alias("child_pointer")).distinct()
    return links.unionByName(nodes)


@register("p4_shapes")
def p4_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Structural variants of the page objects."""
    return shapes.shape_counts(page_tables(spark, d))


_KEYS = f"""
    WITH {_DETAIL}, o AS (SELECT a, child, v, unnest(json_keys(v)) AS key FROM (SELECT DISTINCT root_id, a, child, v FROM detail)),
    k AS (SELECT a, key, json_type(v, '$."' || key || '"') AS t, json_extract(v, '$."' || key || '"') AS x FROM o),
    n AS (SELECT a, key, CASE WHEN t = 'NULL' THEN NULL WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'bool' WHEN t = 'OBJECT' THEN 'object'
          WHEN t = 'ARRAY' THEN CASE WHEN len(list_filter(from_json(x, '["JSON"]'), lambda y: json_type(y) IN ('OBJECT', 'ARRAY'))) > 0 THEN 'array' ELSE 'scalars' END ELSE 'number' END AS kind FROM k)
    SELECT a AS array_name, key, CASE count(DISTINCT kind) WHEN 0 THEN 'null' WHEN 1 THEN max(kind) ELSE 'mixed' END AS kind, count(*) AS n FROM n GROUP BY a, key
"""


@register("p4_keys", _KEYS)
def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which keys the objects of each array have, with their types."""
    return shapes.key_catalog(page_tables(spark, d)).select("array_name", "key", "kind", "n")


def _array_sql(array: str, **columns: str) -> str:
    return f"WITH {_DETAIL} SELECT root_id, child AS pointer, parent AS parent_pointer, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM detail WHERE a = '{array}'"


def _string(key: str) -> str:
    return f"json_extract_string(v, '$.{key}')"


def _array_table(spark: SparkSession, d: str, array: str, *columns: str) -> DataFrame:
    found = shapes.subtype_table(page_tables(spark, d), array)
    return found.select("root_id", "pointer", "parent_pointer", *(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns))


@register("p4_components", _array_sql("components", component_id=_string("component_id"), layout=_string("layout")))
def p4_components(spark: SparkSession, d: str) -> DataFrame:
    """The components as a typed table with the link to their module."""
    return _array_table(spark, d, "components", "component_id", "layout")


@register("p4_modules", _array_sql("modules", id=_string("id"), name=_string("name"), is_submodule="CAST(json_extract(v, '$.is_submodule') AS BOOLEAN)"))
def p4_modules(spark: SparkSession, d: str) -> DataFrame:
    """The modules as a typed table with the link to their page."""
    return _array_table(spark, d, "modules", "id", "name", "is_submodule")


@register("p4_module_groups", _array_sql("module_group", module_group_id=_string("module_group_id"), layout=_string("layout")))
def p4_module_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of a layout as a typed table with the link to their tab."""
    return _array_table(spark, d, "module_group", "module_group_id", "layout")


@register("p4_placements", _array_sql("module", id=_string("id"), pos=_string("pos")))
def p4_placements(spark: SparkSession, d: str) -> DataFrame:
    """The placed modules of a layout as a typed table with the link to their group."""
    return _array_table(spark, d, "module", "id", "pos")


@register(
    "p4_lineages",
    """
    WITH r AS (SELECT DISTINCT record_id, built_at, lineage, sections FROM canonical_records WHERE record_id IS NOT NULL),
    s AS (SELECT record_id, unnest(sections) AS s FROM r),
    l AS (SELECT 'record' AS level, lineage AS l FROM r UNION ALL SELECT 'section', s.lineage FROM s UNION ALL SELECT 'component', z.lineage FROM (SELECT unnest(s.component_contexts) AS z FROM s) UNION ALL SELECT 'unit', z.lineage FROM (SELECT unnest(s.units) AS z FROM s))
    SELECT level, '{parent_pointer:' || CASE WHEN l.parsed_json_pointer IS NULL THEN 'null' ELSE 'string' END || ',refs:' || CASE WHEN l.raw_refs IS NULL THEN 'null'
        ELSE '[' || array_to_string(list_sort(list_distinct(list_transform(l.raw_refs, lambda x: CASE WHEN x.json_pointer IS NULL THEN 'null' ELSE 'string' END))), '|') || ']' END || '}' AS shape, count(*) AS n FROM l GROUP BY ALL
    """,
)
def p4_lineages(spark: SparkSession, d: str) -> DataFrame:
    """Structural variants of the lineages of all builds, by level."""
    return shapes.lineage_nodes(table(spark, d, "canonical_records").distinct()).groupBy("level", "shape").agg(F.count("*").alias("n"))
