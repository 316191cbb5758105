"""Rules that classify traced statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import is_blank, like_match, trim_blank

# Statement fragments (fixed values).
SYSTEM_FRAGMENTS = ("SYS.", "INFORMATION_SCHEMA", "CDC.", "__$", "XE_", "EXTENDED_EVENTS")
MAINTENANCE_FRAGMENTS = ("BACKUP", "RESTORE")
REPLAYABLE_STARTS = ("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "EXEC")


def _contains_any(text: Column, fragments) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | text.contains(fragment)
    return found


def _starts_any(text: Column, words) -> Column:
    return text.rlike("^(" + "|".join(words) + ")")


def is_system(sql: Column) -> Column:
    """Whether a statement touches system objects."""
    return F.coalesce(_contains_any(F.upper(sql), SYSTEM_FRAGMENTS), F.lit(False))


def is_replayable(sql: Column) -> Column:
    """Whether a statement changes data or schema and may be replayed."""
    text = F.upper(trim_blank(sql))
    allowed = (
        _starts_any(text, REPLAYABLE_STARTS)
        & ~_contains_any(text, SYSTEM_FRAGMENTS + MAINTENANCE_FRAGMENTS)
    )
    return F.coalesce(allowed, F.lit(False))


def skip_statement(sql: Column, skip_select: bool = True, skip_system: bool = True,
                   exclude_patterns=()) -> Column:
    """Whether the replay options leave a statement out."""
    text = F.upper(trim_blank(sql))
    skip = is_blank(sql)
    if skip_select:
        skip = skip | text.startswith("SELECT")
    if skip_system:
        skip = skip | _contains_any(text, SYSTEM_FRAGMENTS)
    for pattern in exclude_patterns:
        if not pattern.strip():
            continue
        skip = skip | (like_match(text, pattern) if "%" in pattern else text.contains(pattern.upper()))
    return F.coalesce(skip, F.lit(True))
