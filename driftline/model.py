"""Names, codes and schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Change operation codes (fixed values).
DELETE = 1
INSERT = 2
UPDATE_BEFORE = 3
UPDATE_AFTER = 4

# Record metadata fields (fixed values).
OPERATION_FIELD = "__$operation"
LSN_FIELD = "__$start_lsn"
TABLE_FIELD = "__$table"
KEY_FIELD = "__$primary_key"

# Columns left out of a normalized comparison by default (fixed values).
DEFAULT_EXCLUDED_COLUMNS = (
    "__$start_lsn", "__$end_lsn", "__$seqval", "__$update_mask",
    "LastModified", "CreatedDate", "Timestamp", "ModifiedDate",
)

# Default tolerance window of a normalized comparison: 24 hours, in microseconds.
DEFAULT_TOLERANCE_MICROS = 24 * 3600 * 1_000_000

# Failure kinds of a capture comparison (fixed values).
MISSING_TABLE = "MissingTable"
EXTRA_TABLE = "ExtraTable"
RECORD_COUNT_MISMATCH = "RecordCountMismatch"
MISSING_RECORD = "MissingRecord"
EXTRA_RECORD = "ExtraRecord"
OPERATION_MISMATCH = "OperationMismatch"
FIELD_MISMATCH = "FieldMismatch"

VALUE_TYPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("val", T.StringType()),
])

CAPTURE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("pk", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), VALUE_TYPE)),
])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("catalog", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("pk_columns", T.ArrayType(T.StringType())),
    T.StructField("capture_instance", T.StringType()),
])

TRACE_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("login_name", T.StringType()),
    T.StructField("application_name", T.StringType()),
    T.StructField("host_name", T.StringType()),
    T.StructField("spid", T.IntegerType()),
    T.StructField("duration", T.LongType()),
    T.StructField("cpu_time", T.LongType()),
    T.StructField("reads", T.LongType()),
    T.StructField("writes", T.LongType()),
    T.StructField("sql_text", T.StringType()),
    T.StructField("tsql_stack", T.StringType()),
    T.StructField("plan_handle", T.BinaryType()),
    T.StructField("request_id", T.IntegerType()),
    T.StructField("client_connection_id", T.StringType()),
    T.StructField("transaction_id", T.LongType()),
    T.StructField("statement", T.StringType()),
    T.StructField("execution_order", T.LongType()),
    T.StructField("is_replayable", T.BooleanType()),
])
