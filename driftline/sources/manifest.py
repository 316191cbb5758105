"""Table descriptors: listing, filtering, eligibility, key audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Change-capture bookkeeping, never user tables (fixed values).
CAPTURE_SCHEMA_NAME = "cdc"
BOOKKEEPING_TABLES = ("systranschemas", "lsn_time_mapping", "ddl_history", "change_tables",
                      "captured_columns", "index_columns")


def list_tables(manifest: DataFrame) -> DataFrame:
    """User tables: outside the capture schema and not bookkeeping."""
    return manifest.filter(
        (F.col("schema") != CAPTURE_SCHEMA_NAME) & ~F.col("name").isin(*BOOKKEEPING_TABLES))


def _named(manifest: DataFrame, names):
    """Entries match the bare name or ``schema.name``, any case."""
    wanted = [n.lower() for n in names]
    qualified = F.lower(F.concat_ws(".", "schema", "name"))
    return F.lower("name").isin(*wanted) | qualified.isin(*wanted)


def filter_tables(manifest: DataFrame, include=None, exclude=None) -> DataFrame:
    """Include list, then exclude list; an absent or empty list filters nothing."""
    if include:
        manifest = manifest.filter(_named(manifest, include))
    if exclude:
        manifest = manifest.filter(~_named(manifest, exclude))
    return manifest


def filter_tables_by(manifest: DataFrame, include: DataFrame | None = None,
                     exclude: DataFrame | None = None) -> DataFrame:
    """The same with long lists held as DataFrames of one column ``entry``."""
    for entries, keep in ((include, True), (exclude, False)):
        if entries is None:
            continue
        wanted = entries.select(F.lower("entry").alias("entry")).distinct()
        names = manifest.select("schema", "name").distinct()
        bare = names.join(wanted, F.lower("name") == F.col("entry"), "left_semi")
        qualified = names.join(wanted, F.lower(F.concat_ws(".", "schema", "name")) == F.col("entry"), "left_semi")
        hits = bare.union(qualified).distinct()
        manifest = manifest.join(hits, ["schema", "name"], "left_semi" if keep else "left_anti")
    return manifest


def eligible_tables(manifest: DataFrame) -> DataFrame:
    """Tables with ``capture_status``: enabled with a key and an instance, otherwise skipped."""
    enabled = (F.size("pk_columns") > 0) & F.col("capture_instance").isNotNull() & (F.col("capture_instance") != "")
    return manifest.withColumn("capture_status", F.when(enabled, "enabled").otherwise("skipped"))


def require_eligible(manifest: DataFrame, include=None) -> DataFrame:
    """Eligible tables; an include list that leaves none is an error."""
    enabled = eligible_tables(filter_tables(manifest, include)).filter("capture_status = 'enabled'")
    if include and enabled.isEmpty():
        raise ValueError("no included table has a primary key and a capture instance")
    return enabled


def key_audit(manifest: DataFrame) -> DataFrame:
    """Tables without a primary index or with more than one."""
    finding = F.when(F.col("index_count") == 0, "no primary index").when(
        F.col("index_count") > 1, "several primary indexes")
    return manifest.select("schema", "name", "index_count", finding.alias("finding")).filter(
        "finding IS NOT NULL")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def distinct_field(df: DataFrame, field: str) -> DataFrame:
    """Distinct text values of a column, null as empty; an absent column is an error."""
    if field not in df.columns:
        raise ValueError(f"no column {field}")
    return df.select(F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")).alias("value")).distinct()


def tables_only_right(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Names on the right and not on the left, any case, sorted."""
    lowered = lambda df: df.select(F.lower(name).alias("_key"))
    firsts = right.groupBy(F.lower(name).alias("_key")).agg(F.min(name).alias(name))
    return firsts.join(lowered(left).distinct(), "_key", "left_anti").select(name).orderBy(name)
