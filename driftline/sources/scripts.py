"""Statements of script files, split where a lexer may, in ranges that many tasks read.

Whether a ``;`` separates statements depends on the quotes and comments opened before it. A lexer has few states
between lines; so each range of a file first tells, for every state that it might start in, the state it ends in. These
small functions are composed in the order of the ranges, and every range is then split from the state it really
starts in. Only the statements that go over the end of a range are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.text import trim_blank
from driftline.sources.documents import add_up

#: The lexer's states between lines: outside, in '...', in "...", in [...], in a comment.
_OUTSIDE, _STATES = 0, range(5)
_OPENS = {"'": 1, '"': 2, "[": 3, "/*": 4}
_CLOSES = {1: "'", 2: '"', 3: "]", 4: "*/"}
_SPECIAL = re.compile(r"'|\"|\[|/\*|--|;")
_GO = re.compile(r"[ \t]*go[ \t]*\r?", re.IGNORECASE)


def lex_line(line: str, state: int) -> tuple[list[int] | None, int]:
    """Where ``;`` separates statements in a line that starts in ``state``, and the state behind it.

    None stands for a line that is a separator itself, ``GO`` alone.
    """
    if state == _OUTSIDE and _GO.fullmatch(line):
        return None, state
    cuts, at = [], 0
    while at < len(line):
        if state != _OUTSIDE:
            end = line.find(_CLOSES[state], at)
            if end < 0:
                break
            if state == 3 and line.startswith("]]", end):  # stands for one bracket of the name
                at = end + 2
                continue
            at, state = end + len(_CLOSES[state]), _OUTSIDE
            continue
        found = _SPECIAL.search(line, at)
        if found is None or found[0] == "--":
            break
        at = found.end()
        if found[0] == ";":
            cuts.append(found.start())
        else:
            state = _OPENS[found[0]]
    return cuts, state


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], list[str]]]:
    """(file, block), places and lines of each run of lines of one range."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        places, lines = batch.column("pos").to_pylist(), batch.column("line").to_pylist()
        first = 0
        for last in range(1, len(keys) + 1):
            if last == len(keys) or keys[last] != keys[first]:
                yield keys[first], places[first:last], lines[first:last]
                first = last


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of lines as functions of the state; a range may be several runs, in the order of ``pos``."""
    for (file, block), places, lines in _ranges(batches):
        ends = list(_STATES)
        for line in lines:
            if _SPECIAL.search(line) or "]" in line or "*/" in line:
                behind = {state: lex_line(line, state)[1] for state in set(ends)}
                ends = [behind[state] for state in ends]
        yield pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([places[0]], pa.int64()), pa.array([ends], pa.list_(pa.int32()))],
            ["file", "block", "pos", "ends"])


def _composed(runs: pa.Table) -> pa.Table:
    """The state in which each range of a file starts; one row per run of lines, so few to a file."""
    order = runs.select(["block", "pos", "ends"]).sort_by([("block", "ascending"), ("pos", "ascending")]).to_pylist()
    state, starts = _OUTSIDE, {}
    for run in order:
        starts.setdefault(run["block"], state)
        state = run["ends"][state]
    return pa.table({"file": pa.array([runs["file"][0].as_py()] * len(starts)), "block": pa.array(list(starts), pa.int64()),
                     "state": pa.array(list(starts.values()), pa.int32())})


def _one_script(lines: DataFrame) -> DataFrame:
    """The lines of a folder's files as those of one file; its ranges are numbered by file and place."""
    ranges = lines.select(F.regexp_replace("file", "[^/]*$", "").alias("folder"), "file", "block").distinct()
    order = Window.partitionBy("folder").orderBy("file", "block")
    numbered = ranges.withColumn("number", F.row_number().over(order).cast("bigint"))
    return lines.join(F.broadcast(numbered), ["file", "block"]).select(
        F.col("folder").alias("file"), F.col("number").alias("block"), "pos", "line")


_FRAGMENTS = "file string, block bigint, pos bigint, fragment string, ends boolean"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each range between separators, in order; the last of a range has none behind it."""
    current, state, number, parts = None, _OUTSIDE, 0, []
    out: list[tuple] = []

    def close(ends: bool) -> None:
        nonlocal number, parts
        out.append((*current, number, "\n".join(parts), ends))
        number, parts = number + 1, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "pos", "fragment", "ends"])

    for rows in batches:
        starts = rows.column("state").to_pylist()
        at = 0
        for key, _, lines in _ranges([rows]):
            if key != current:
                if current is not None:
                    close(False)
                current, state, number, parts = key, starts[at], 0, []
            at += len(lines)
            for line in lines:
                cuts, state = lex_line(line, state)
                if cuts is None:
                    # The separator takes its line; what follows starts on the next.
                    close(True)
                    continue
                start = 0
                for cut in cuts:
                    parts.append(line[start:cut])
                    close(True)
                    start = cut + 1
                parts.append(line[start:])
        if out:
            yield batch()
    if current is not None:
        close(False)
        yield batch()


def read_statements(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """``file, event_id, execution_order, sql_text``: the statements of script files of any size, in order.

    Statements end at ``;`` and at ``GO`` alone on a line, but not inside single or double quotes, brackets and comments,
    which may go over lines; a quote or closing bracket doubled inside its own stays inside. Statements are numbered by position within
    their file before blank ones are dropped. An open quote or comment at the end of a file reaches to its end.
    Files must be uncompressed to be read in ranges of ``spark.sql.files.maxPartitionBytes``; a statement is put together
    in one task. With ``parts`` the files of a folder are one script in the order of their names, as Spark writes
    a table: each goes on where the one before ends, on a new line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    if parts:
        lines = _one_script(lines)
    runs = lines.mapInArrow(_transitions, "file string, block bigint, pos bigint, ends array<int>")
    starts = runs.groupBy("file").applyInArrow(_composed, "file string, block bigint, state int")
    placed = lines.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "pos")
    fragments = placed.select("file", "block", "pos", "line", "state").mapInArrow(_fragments, _FRAGMENTS)
    fragments = add_up(fragments, number=F.col("ends"))
    whole = fragments.where("ends AND pos > 0").select("file", "number", F.col("fragment").alias("text"))
    several = fragments.where("NOT (ends AND pos > 0)").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("block", "pos", "fragment"))), lambda x: x["fragment"]), "\n").alias("text"))
    order = (F.col("number") + 1).cast("bigint")
    return whole.unionByName(several).select(
        "file", order.alias("event_id"), order.alias("execution_order"), trim_blank(F.col("text")).alias("sql_text")).where(
        "sql_text <> ''")
