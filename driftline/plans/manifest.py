"""Queries over table descriptors derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog
from driftline.sources import manifest as M

catalog = Catalog()

TABLES = f"({I.MANIFEST_SQL}) m"
USER_TABLES = "schema <> 'cdc' AND name NOT IN (" + ", ".join(f"'{t}'" for t in M.BOOKKEEPING_TABLES) + ")"


@catalog.add("list_tables", f"SELECT schema, name FROM {TABLES} WHERE {USER_TABLES}")
def list_tables(spark, sf):
    return M.list_tables(I.manifest(spark, sf)).select("schema", "name")


INCLUDE = ("RED_WIDGET_1", "dbo.blue_bolt_2", "sales.small_ring_0", "small_ring_0", "missing")
EXCLUDE = ("dbo.ddl_history", "DDL_HISTORY", "red_widget_1")


@catalog.add("filter_tables", f"""SELECT schema, name, 'listed' AS kind FROM {TABLES}
WHERE (lower(name) IN ('red_widget_1', 'small_ring_0', 'missing') OR lower(schema || '.' || name) IN ('dbo.blue_bolt_2', 'sales.small_ring_0'))
  AND lower(name) NOT IN ('ddl_history', 'red_widget_1')
UNION ALL SELECT schema, name, 'all but excluded' FROM {TABLES} WHERE lower(name) NOT IN ('ddl_history', 'red_widget_1')
UNION ALL SELECT schema, name, 'all' FROM {TABLES}""")
def filter_tables(spark, sf):
    """Include then exclude, exclude alone, and empty lists."""
    manifest = I.manifest(spark, sf)
    shown = lambda df, kind: df.select("schema", "name", F.lit(kind).alias("kind"))
    return (
        shown(M.filter_tables(manifest, INCLUDE, EXCLUDE), "listed")
        .union(shown(M.filter_tables(manifest, None, EXCLUDE), "all but excluded"))
        .union(shown(M.filter_tables(manifest, [], []), "all"))
    )


@catalog.add("filter_tables_by", f"""WITH m AS (SELECT * FROM {TABLES}),
inc AS (SELECT DISTINCT upper(schema || '.' || name) AS entry FROM m WHERE index_count <> 3),
exc AS (SELECT DISTINCT name AS entry FROM m WHERE index_count = 1)
SELECT schema, name FROM m WHERE upper(schema || '.' || name) IN (FROM inc) AND name NOT IN (FROM exc)""")
def filter_tables_by(spark, sf):
    """Long lists held as tables."""
    manifest = I.manifest(spark, sf)
    include = manifest.filter("index_count <> 3").select(F.upper(F.concat_ws(".", "schema", "name")).alias("entry"))
    exclude = manifest.filter("index_count = 1").select(F.col("name").alias("entry"))
    return M.filter_tables_by(manifest, include, exclude).select("schema", "name")


@catalog.add("eligible_tables", f"SELECT schema, name, CASE WHEN pk IS NOT NULL AND capture_instance IS NOT NULL THEN 'enabled' ELSE 'skipped' END AS capture_status FROM {TABLES}")
def eligible_tables(spark, sf):
    return M.eligible_tables(I.manifest(spark, sf)).select("schema", "name", "capture_status")


@catalog.add("key_audit", f"""SELECT schema, name, index_count, CASE WHEN index_count = 0 THEN 'no primary index' ELSE 'several primary indexes' END AS finding
FROM {TABLES} WHERE index_count <> 1""")
def key_audit(spark, sf):
    return M.key_audit(I.manifest(spark, sf))


@catalog.add("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return M.duplicate_keys(I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@catalog.add("distinct_field", "SELECT DISTINCT coalesce(CAST(CASE WHEN l_quantity > 45 THEN NULL ELSE l_suppkey END AS VARCHAR), '') AS value FROM lineitem")
def distinct_field(spark, sf):
    lines = I.table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 45, F.col("l_suppkey")).alias("s"))
    return M.distinct_field(lines, "s")


@catalog.add("tables_only_right", f"SELECT DISTINCT name FROM {TABLES} WHERE index_count = 2 AND lower(name) NOT IN (SELECT lower(name) FROM {TABLES} WHERE index_count <> 2)")
def tables_only_right(spark, sf):
    """Names of one part of the manifest that the other lacks; the left is upper-cased."""
    manifest = I.manifest(spark, sf)
    left = manifest.filter("index_count <> 2").select(F.upper("name").alias("name"))
    return M.tables_only_right(left, manifest.filter("index_count = 2"))
