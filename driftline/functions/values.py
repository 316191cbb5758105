"""Values as ``struct<kind, val>``: building, equality, difference kinds, normalization.

``kind`` is the stored type (string, bigint, decimal, double, boolean, timestamp, binary,
object, array); a null value is a null struct field, or an absent map key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import base64_text, matches_any_pattern
from driftline.model import DEFAULT_EXCLUDED_COLUMNS, DEFAULT_TOLERANCE_MICROS, VALUE_TYPE

NUMBER_KINDS = ("bigint", "decimal", "double")
EPSILON = 1e-6
# Microseconds from 0001-01-01 to 1970-01-01: tolerance windows are counted from year 1.
EPOCH_OFFSET_MICROS = 62_135_596_800_000_000
TIME_NAME_PARTS = ("date", "time", "created", "modified")


def kind_of(dtype: T.DataType) -> str:
    """The stored kind of a Spark type; an unmapped type is an error."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    raise TypeError(f"no value kind for type {dtype.simpleString()}")


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_sql(expr: str, dtype: T.DataType) -> str:
    """SQL of a typed expression as a value struct; null stays null.

    Per-column expressions are generated as SQL text: a wide table then costs one parse
    instead of thousands of calls into the JVM.
    """
    if isinstance(dtype, T.BinaryType):
        text = f"replace(base64({expr}), '\\r\\n', '')"
    elif isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        text = f"to_json({expr})"
    else:
        text = f"CAST({expr} AS STRING)"
    return f"IF({expr} IS NULL, NULL, named_struct('kind', '{kind_of(dtype)}', 'val', {text}))"


def typed_value(name: str, dtype: T.DataType) -> Column:
    """A typed column as a value struct."""
    return F.expr(value_sql(quote_name(name), dtype))


def variant_value(variant: Column, exact: Column | None = None) -> Column:
    """A JSON variant as a value struct; JSON null becomes null.

    A variant holds numbers of more than 38 digits or with an exponent as doubles;
    ``exact`` is their text in the document.
    """
    schema = F.schema_of_variant(variant)
    kind = (
        F.when(schema == "STRING", "string")
        .when(schema == "BIGINT", "bigint")
        .when(schema.startswith("DECIMAL"), "decimal")
        .when(schema.isin("DOUBLE", "FLOAT"), "double")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("string")
    )
    text = F.when(kind.isin("object", "array"), F.to_json(variant)).otherwise(
        F.try_variant_get(variant, "$", "string"))
    if exact is not None:
        text = F.when(kind == "double", F.coalesce(exact, text)).otherwise(text)
    value = F.struct(kind.alias("kind"), text.alias("val"))
    return F.when(variant.isNotNull() & (schema != "VOID"), value).otherwise(
        F.lit(None).cast(VALUE_TYPE))


def field_map(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Typed columns as ``map<string, struct<kind, val>>``."""
    pairs = [f"{quote_text(c)}, {value_sql(quote_name(c), df.schema[c].dataType)}" for c in columns or df.columns]
    return F.expr(f"map({', '.join(pairs)})")


_NUMBERS = ", ".join(f"'{k}'" for k in NUMBER_KINDS)


def _number_equal_sql(left: str, right: str) -> str:
    """SQL of the equality of two number texts, exact at any length.

    Plain notation compares without trailing zeros. A number with an exponent must agree
    as a double and, where it fits one, as a decimal.
    """
    plain = lambda v: (
        f"regexp_replace(regexp_replace({v}, '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')")
    same = lambda t: f"try_cast({left} AS {t}) = try_cast({right} AS {t})"
    return (f"IF({left} RLIKE '[eE]' OR {right} RLIKE '[eE]', {same('DOUBLE')} AND coalesce({same('DECIMAL(38,18)')}, true) "
            f"AND coalesce({same('DECIMAL(38,0)')}, true), {plain(left)} = {plain(right)})")


def json_equal_sql(left: str, right: str) -> str:
    """SQL of the JSON equality of two value structs.

    Null equals null, kinds must agree, numbers compare by value (``1.0 = 1.00``),
    everything else as text.
    """
    kind = lambda v: (
        f"CASE WHEN {v}.kind IN ({_NUMBERS}) THEN 'number' "
        f"WHEN {v}.kind IN ('timestamp', 'binary') THEN 'string' ELSE {v}.kind END")
    return (f"({kind(left)} <=> {kind(right)} AND ({left}.val <=> {right}.val OR coalesce("
            f"{left}.kind IN ({_NUMBERS}) AND {_number_equal_sql(left + '.val', right + '.val')}, false)))")


def json_equal(left: str, right: str) -> Column:
    """Whether two value structs, given as SQL expressions, are equal as JSON values."""
    return F.expr(json_equal_sql(left, right))


def value_equal_eps(left: Column, right: Column) -> Column:
    """Equality of two typed columns, with a tolerance for doubles; null equals null."""
    near = F.abs(left - right) < EPSILON
    return left.eqNullSafe(right) | F.coalesce(near, F.lit(False))


def value_equal_sql(left: str, right: str) -> str:
    """SQL of the typed equality of two value structs: doubles within a tolerance, else kind and text."""
    number = lambda v: f"try_cast({v}.val AS DOUBLE)"
    return (f"(({left}.kind <=> {right}.kind AND {left}.val <=> {right}.val) OR coalesce({left}.kind = 'double' "
            f"AND {right}.kind = 'double' AND abs({number(left)} - {number(right)}) < {EPSILON:.6f}, false))")


def difference_type_sql(left: str, right: str) -> str:
    return (f"CASE WHEN {left}.val IS NULL THEN 'Added' WHEN {right}.val IS NULL THEN 'Removed' "
            f"WHEN {left}.kind <> {right}.kind THEN 'TypeChanged' ELSE 'ValueChanged' END")


def difference_type(left: str, right: str) -> Column:
    """Added, Removed, TypeChanged or ValueChanged for two unequal value structs."""
    return F.expr(difference_type_sql(left, right))


def read_utc(ts: Column) -> Column:
    """A timestamp without a zone, declared to be UTC, as an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")).cast("timestamp")


def null_defaults(df: DataFrame, guid_columns=(), keep_nulls: bool = False) -> DataFrame:
    """Nulls as the default of their type; text stays null."""
    if keep_nulls:
        return df
    filled = {}
    for f in df.schema:
        kind = kind_of(f.dataType)
        if f.name in guid_columns:
            default = F.lit("00000000-0000-0000-0000-000000000000")
        elif kind in NUMBER_KINDS:
            default = F.lit(0).cast(f.dataType)
        elif kind == "boolean":
            default = F.lit(False)
        elif kind == "timestamp":
            default = F.lit("0001-01-01 00:00:00").cast(f.dataType)
        else:
            continue
        filled[f.name] = F.coalesce(F.col(quote_name(f.name)), default)
    return df.withColumns(filled) if filled else df


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_to_window(ts: Column, window_micros: int) -> Column:
    """A timestamp floored to a window counted from 0001-01-01."""
    if window_micros <= 0:
        return ts
    ticks = micros(ts) + F.lit(EPOCH_OFFSET_MICROS)
    floored = ticks - F.pmod(ticks, F.lit(window_micros))
    return F.timestamp_micros(floored - F.lit(EPOCH_OFFSET_MICROS))


def is_time_name(name: str) -> bool:
    return any(part in name.lower() for part in TIME_NAME_PARTS)


def normalize_column(name: str, dtype: T.DataType, window_micros: int = DEFAULT_TOLERANCE_MICROS) -> Column:
    """One typed column in its normalized form."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and is_time_name(name):
        return floor_to_window(col.cast("timestamp"), window_micros)
    if isinstance(dtype, T.BinaryType):
        return base64_text(col)
    if isinstance(dtype, T.DecimalType):
        return F.bround(col, 6) if dtype.scale > 6 else col
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.bround(col.cast("double"), 6)
    return col


def keep_columns(columns: list[str], excluded=DEFAULT_EXCLUDED_COLUMNS, patterns=()) -> list[str]:
    """The columns a normalized comparison keeps, resolved before the scan is planned."""
    dropped = {c.lower() for c in excluded}
    return [c for c in columns if c.lower() not in dropped and not matches_any_pattern(c, patterns)]


def normalize_columns(df: DataFrame, window_micros: int = DEFAULT_TOLERANCE_MICROS,
                      excluded=DEFAULT_EXCLUDED_COLUMNS, patterns=()) -> DataFrame:
    """Drop excluded columns and normalize the rest of a typed table."""
    return df.select(*[
        normalize_column(c, df.schema[c].dataType, window_micros).alias(c)
        for c in keep_columns(df.columns, excluded, patterns)
    ])


def normalize_value(name: Column, value: Column, window_micros: int = DEFAULT_TOLERANCE_MICROS) -> Column:
    """A value struct in its normalized form, for records whose types are known per value."""
    kind, val = value["kind"], value["val"]
    timely = name.rlike("(?i)" + "|".join(TIME_NAME_PARTS))
    stamp = floor_to_window(F.try_to_timestamp(val), window_micros)
    text = (
        F.when((kind == "timestamp") & timely, F.coalesce(stamp.cast("string"), val))
        .when(kind == "decimal", F.coalesce(
            F.bround(val.try_cast("decimal(38,12)"), 6).cast("string"), val))
        .when(kind == "double", F.coalesce(F.bround(val.try_cast("double"), 6).cast("string"), val))
        .otherwise(val)
    )
    return F.when(value.isNotNull(), F.struct(kind.alias("kind"), text.alias("val")))


def changed_unless_recent_sql(left: str, right: str, now: str | None = None) -> str:
    differs = f"NOT ({left}.kind <=> {right}.kind AND {left}.val <=> {right}.val)"
    if now is None:
        return differs
    return (f"({differs} AND NOT coalesce({left}.kind = 'timestamp' AND try_cast({right}.val AS TIMESTAMP) "
            f"BETWEEN {now} - INTERVAL 1 DAY AND {now} + INTERVAL 1 DAY, false))")


def changed_unless_recent(left: str, right: str, now: str | None = None) -> Column:
    """True where two value structs differ.

    With ``now`` (a SQL timestamp) given, a differing timestamp counts only if the right
    value lies more than a day from ``now``.
    """
    return F.expr(changed_unless_recent_sql(left, right, now))
