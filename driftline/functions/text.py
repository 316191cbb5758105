"""Text functions: patterns, statement cleaning, labels and formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Any character a text trim removes: ASCII whitespace, next-line and all Unicode separators.
BLANK = r"[\s\x0B\x85\p{Z}]"


def trim_blank(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | col.rlike(rf"^{BLANK}*$")


def wildcard_regex(pattern: str, wildcards: dict[str, str]) -> str:
    """A user pattern as an anchored regular expression, all other characters literal."""
    return "^" + "".join(wildcards.get(ch, re.escape(ch)) for ch in pattern) + "$"


def column_pattern_regex(pattern: str) -> str:
    """Column exclusion pattern: ``*`` and ``?`` anchor it, otherwise it is a substring."""
    if "*" in pattern or "?" in pattern:
        return wildcard_regex(pattern, {"*": ".*", "?": "."})
    return re.escape(pattern)


def matches_any_pattern(name: str, patterns) -> bool:
    return any(re.search(column_pattern_regex(p), name, re.IGNORECASE) for p in patterns if p.strip())


def wildcard_match(col: Column, pattern: str) -> Column:
    """``*`` and ``?`` wildcards, anchored, any case."""
    return col.rlike("(?i)" + wildcard_regex(pattern, {"*": ".*", "?": "."}))


def like_match(col: Column, pattern: str) -> Column:
    """``%`` wildcard, anchored, any case; ``_`` is literal."""
    return col.rlike("(?i)" + wildcard_regex(pattern, {"%": ".*"}))


def clean_sql(sql: Column) -> Column:
    """Replay form of a statement: no trace comments, single spaces, DML and DDL end in ``;``."""
    text = trim_blank(sql)
    text = F.regexp_replace(text, r"(?i)--\s*exec sp_executesql[^\n]*", "")
    text = F.regexp_replace(text, rf"{BLANK}+", " ")
    needs_end = (
        text.rlike("(?i)^(insert|update|delete|merge|create|alter|drop)")
        & ~text.endswith(";")
        & ~text.rlike(r"(?i)(^|\W)go$")
    )
    cleaned = F.when(needs_end, F.concat(text, F.lit(";"))).otherwise(text)
    return F.when(is_blank(sql), "").otherwise(cleaned)


def format_duration(seconds: Column, watch: bool = False) -> Column:
    """``Nd Nh``, ``Nh Nm``, ``Nm Ns`` or ``Ns``; the watch form shows ``Nh Nm Ns``."""
    total = seconds.cast("bigint")
    day = F.floor(total / 86400).cast("string")
    hour = F.floor(F.pmod(total, F.lit(86400)) / 3600).cast("string")
    minute = F.floor(F.pmod(total, F.lit(3600)) / 60).cast("string")
    second = F.pmod(total, F.lit(60)).cast("string")
    minutes = F.concat(minute, F.lit("m "), second, F.lit("s"))
    short = F.when(total >= 60, minutes).otherwise(F.concat(second, F.lit("s")))
    if watch:
        return F.when(total >= 3600, F.concat(hour, F.lit("h "), minutes)).otherwise(short)
    return (
        F.when(total >= 86400, F.concat(day, F.lit("d "), hour, F.lit("h")))
        .when(total >= 3600, F.concat(hour, F.lit("h "), minute, F.lit("m")))
        .otherwise(short)
    )


def truncate_text(col: Column, length: int) -> Column:
    short = F.concat(F.substring(col, 1, length - 3), F.lit("..."))
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, "").when(
        F.length(col) <= length, col).otherwise(short)


def pad_or_truncate_right(col: Column, length: int) -> Column:
    return F.rpad(col, length, " ")


def pad_or_truncate_left(col: Column, length: int) -> Column:
    return F.lpad(col, length, " ")


# Status labels (fixed values).
STATUS_LABELS = {
    "completed": "✓ Completed",
    "failed": "✗ Failed",
    "cancelled": "⊗ Cancelled",
    "running": "⟳ Running",
    "pending": "○ Pending",
}
TERMINAL_STATES = ("completed", "failed", "cancelled")


def status_label(status: Column, success: Column) -> Column:
    label = F.when(is_blank(status), F.when(success, STATUS_LABELS["completed"]).otherwise(
        STATUS_LABELS["failed"]))
    for name, text in STATUS_LABELS.items():
        label = label.when(F.lower(status) == name, text)
    return label.otherwise(status)


def is_terminal(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*TERMINAL_STATES), F.lit(False))


def default_text(preferred: Column, default: Column) -> Column:
    return F.coalesce(preferred, default)


def lower_first(col: Column) -> Column:
    return F.concat(F.lower(F.substring(col, 1, 1)), F.substr(col, F.lit(2)))


def make_key(*parts: Column) -> Column:
    """Two or three parts joined by ``_``; a null part is empty text."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def equals_ignore_case(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def contains_ignore_case(col: Column, part: Column) -> Column:
    return F.coalesce(F.contains(F.lower(col), F.lower(part)), F.lit(False))


def starts_with_ignore_case(col: Column, part: Column) -> Column:
    return F.startswith(F.lower(col), F.lower(part))


def ends_with_ignore_case(col: Column, part: Column) -> Column:
    return F.endswith(F.lower(col), F.lower(part))


def base64_text(col: Column) -> Column:
    """Base64 of bytes on one line, whatever line length the session is set to."""
    return F.replace(F.base64(col), F.lit("\r\n"), F.lit(""))


def to_base64(col: Column) -> Column:
    return base64_text(F.encode(col, "UTF-8"))


def from_base64(col: Column) -> Column:
    return F.decode(F.unbase64(col), "UTF-8")


def strip_ws_lower(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"[ \r\n\t]", ""))


def document_number(prefix: str, year: Column, number: Column) -> Column:
    """``XX-YYYY-NNN``, zero-padded to three digits; larger numbers keep all their digits."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.concat(F.lit(prefix + "-"), year.cast("string"), F.lit("-"), padded)
