"""Record keys, LSN text and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import base64_text
from driftline.functions.values import quote_name, quote_text
from driftline.model import KEY_FIELD

# Names looked up, in this order, as the natural key of a record (fixed values).
KEY_NAMES = ("Id", "ID", "id", "Key", "KEY", "key")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def sha256_base64(text: Column) -> Column:
    return base64_text(F.unhex(sha256_hex(text)))


def lsn_hex(lsn: Column) -> Column:
    return F.hex(lsn)


def lsn_base64(lsn: Column) -> Column:
    return base64_text(lsn)


def pk_value(fields: Column) -> Column:
    """Key text of a capture record: null reads ``null``, an absent field ``unknown``."""
    key = F.lit(KEY_FIELD)
    return F.when(F.map_contains_key(fields, key),
                  F.coalesce(fields[key]["val"], F.lit("null"))).otherwise("unknown")


def key_text_sql(parts: list[str], null: str) -> str:
    """SQL of the parts of a key, given as SQL of texts, as one text joined by ``|``.

    No other parts give the same text: of several parts, backslashes and bars inside are
    written behind a backslash, and so is a text that reads like ``null``, the mark of a null.
    """
    mark = quote_text(null)
    if len(parts) == 1:
        return f"coalesce({parts[0]}, {mark})"
    return f"concat_ws('|', {', '.join(f'coalesce({_escaped_sql(p, null)}, {mark})' for p in parts)})"


def _escaped_sql(part: str, null: str) -> str:
    escaped = rf"replace(replace({part}, r'\', r'\\'), '|', r'\|')"
    return rf"IF({part} = {quote_text(null)}, r'\' || {part}, {escaped})"


def key_columns_value(columns: list[str]) -> Column:
    """All key columns as one text; parts joined by ``|``, null parts read ``<null>``."""
    return F.expr(key_text_sql([f"CAST({quote_name(c)} AS STRING)" for c in columns], "<null>"))


def profile_key_sql(fields: str, columns: str, parity: bool = False) -> str:
    """SQL of a record's key from its key fields; an absent field reads ``<null>``.

    ``columns`` is an array of names. Parts are written as ``key_text_sql`` has them;
    ``parity`` joins them as they are, without a separator.
    """
    value = f"coalesce({fields}[c].val, '')"
    if parity:
        return f"array_join(transform({columns}, c -> IF(map_contains_key({fields}, c), {value}, '<null>')), '')"
    text = f"IF(size({columns}) > 1, {_escaped_sql(value, '<null>')}, {value})"
    return f"array_join(transform({columns}, c -> IF(map_contains_key({fields}, c), {text}, '<null>')), '|')"


def natural_key(fields: Column) -> Column:
    """First non-null natural key as ``name:value``, else null."""
    return F.coalesce(*[
        F.concat(F.lit(f"{name}:"), F.try_element_at(fields, F.lit(name))["val"]) for name in KEY_NAMES
    ])


def row_key(fields: Column) -> Column:
    """The natural key, else a short digest of all fields: a label, which different rows may share."""
    entries = F.array_sort(F.map_entries(fields))
    text = F.concat_ws("", F.transform(
        entries, lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"]["val"], F.lit("NULL")), F.lit(";"))))
    return F.coalesce(natural_key(fields), F.upper(F.substring(sha256_hex(text), 1, 16)))


def row_digest(fields: Column) -> Column:
    """Full digest of all fields with their kinds; nulls and separators inside values are told apart."""
    entries = F.array_sort(F.map_entries(fields))
    return F.unhex(sha256_hex(F.to_json(F.transform(entries, lambda e: F.array(
        e["key"], e["value"]["kind"], e["value"]["val"])))))
