"""Documents and scripts read in ranges of a few bytes equal the same files read whole."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftline.functions.text import trim_blank
from driftline.sources import captures
from driftline.sources.documents import split_documents
from driftline.sources.scripts import lex_line, read_statements


@pytest.fixture()
def ranges(spark):
    """Sets the bytes of a range."""
    def of(size: int) -> None:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 2 else 4)
    if kind <= 2:
        return "".join(rng.choice('ab{}[]":,\\é\n ') for _ in range(rng.randint(0, 9)))
    if kind == 3:
        return rng.choice([None, 1, 2.5, True, -17])
    if kind == 4:
        return ""
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{rng.choice(['{', '}', chr(34), ' '])}{i}": value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def document(rng):
    names = ('t"', "{", "[", "\\", "ü")
    return {f"{names[i]}{i}": rng.choice([[], None]) if rng.random() < 0.3 else [
        {f"f{j}": value(rng) for j in range(rng.randint(0, 4))} for _ in range(rng.randint(1, 5))] for i in range(rng.randint(0, 5))}


@pytest.mark.parametrize("size", [13, 40, 1 << 20])
def test_documents_in_ranges(spark, ranges, tmp_path, size):
    rng, expected = random.Random(size), []
    for number in range(4):
        found = document(rng)
        text = json.dumps(found, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        (tmp_path / f"f{number}").write_text(text + rng.choice(["", "\n", " \n\n"]))
        expected += [(f"f{number}", t, i, json.dumps(r, sort_keys=True)) for t, rows in found.items() for i, r in enumerate(rows or [])]
    ranges(size)
    rows = split_documents(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.table_name, r.ordinal, json.dumps(json.loads(r.record), sort_keys=True))
                  for r in rows) == sorted(expected)


def test_a_document_is_many_tasks(spark, ranges, tmp_path):
    rows = [{"__$primary_key": i, "v": f"text {i} }} {{"} for i in range(2000)]
    (tmp_path / "big.json").write_text(json.dumps({"a": rows, "none": [], "b": rows[::-1]}))
    ranges(4096)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = captures.read_profile(spark, str(tmp_path))
    whole = captures.parse_capture_json(spark.read.text(str(tmp_path), wholetext=True), "value").select(got.columns)
    key = lambda r: (r.table_name, r.ordinal)
    assert sorted(got.collect(), key=key) == sorted(whole.collect(), key=key)


@pytest.mark.parametrize("text", [
    '{"a":[{"x":1}]', '{"a":[{"x":1}', '{"a":[{"x":1}{"x":2}]}', '{"a":[{"x":1}],"a":[{}]}', '{"a":{"x":1}}', '[{"x":1}]',
    '{"a":[1]}', "x", '{"a":[{"x":"1}]}', '{"a":[{"x":1}]} {"b":[]}', '{"a":[{"x":[1}]}', '{"a":[{"x":1}]]}', '{"a":[{"x":1]}}'])
def test_bad_documents_are_errors(spark, ranges, tmp_path, text):
    (tmp_path / "bad").write_text(text)
    ranges(7)
    with pytest.raises(PySparkException, match="not a"):
        captures.read_profile(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text", ["", "{}", ' {"a":null} \n', '{"a":[], "b": [ ]}'])
def test_documents_without_records(spark, tmp_path, text):
    (tmp_path / "empty").write_text(text)
    assert captures.read_profile(spark, str(tmp_path)).count() == 0


def sequential(text):
    """Statements of a script, one state through all lines."""
    found, parts, state = [], [], 0
    for line in (text[:-1] if text.endswith("\n") else text).split("\n"):
        cuts, state = lex_line(line, state)
        if cuts is None:
            found.append("\n".join(parts))
            parts = []
            continue
        start = 0
        for cut in cuts:
            found.append("\n".join([*parts, line[start:cut]]))
            parts, start = [], cut + 1
        parts.append(line[start:])
    return [*found, "\n".join(parts)]


@pytest.mark.parametrize("size", [5, 23, 1 << 20])
def test_scripts_in_ranges(spark, ranges, tmp_path, size):
    rng, expected = random.Random(size), []
    for number in range(5):
        text = "".join(rng.choice(["a", ";", "'", '"', "[", "]", "/*", "*/", "--", "\n", "\nGO\n", "\n go\t\r\n", " ", "it''s", "é"])
                       for _ in range(rng.randint(0, 60)))
        (tmp_path / f"f{number}").write_text(text, newline="")
        expected += [(f"f{number}", i + 1, s) for i, s in enumerate(sequential(text))]
    trimmed = spark.createDataFrame(expected, "file string, execution_order long, sql_text string").withColumn(
        "sql_text", trim_blank(F.col("sql_text"))).where("sql_text <> ''")
    ranges(size)
    got = read_statements(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert sorted(map(tuple, got.select("file", "execution_order", "sql_text").collect())) == sorted(map(tuple, trimmed.collect()))


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_a_script_in_parts(spark, ranges, tmp_path, size):
    rng = random.Random(size)
    for _ in range(4):
        folder = tmp_path / f"s{rng.random()}"
        folder.mkdir()
        parts = ["\n".join("".join(rng.choice(["a", ";", "'", "[", "]", "/*", "*/", "é", "\nGO\n"]) for _ in range(rng.randint(0, 9)))
                           for _ in range(rng.randint(0, 4))) for _ in range(5)]
        for number, text in enumerate(parts):
            (folder / f"part-{number:05d}.txt").write_text(text + "\n" * bool(text), newline="")
        whole = sequential("".join(text + "\n" * bool(text) for text in parts))
        ranges(size)
        got = read_statements(spark, str(folder), parts=True)
        trimmed = spark.createDataFrame([(i + 1, s) for i, s in enumerate(whole)], "execution_order long, sql_text string").withColumn(
            "sql_text", trim_blank(F.col("sql_text"))).where("sql_text <> ''")
        assert sorted(map(tuple, got.select("execution_order", "sql_text").collect())) == sorted(map(tuple, trimmed.collect()))


def test_lexer():
    assert lex_line("a;'b;c';d", 0) == ([1, 7], 0)
    assert lex_line("it;", 1) == ([], 1) and lex_line("it';", 1) == ([3], 0)
    assert lex_line("x /* ;", 0) == ([], 4) and lex_line("*/ ; -- ';", 4) == ([3], 0)
    assert lex_line("[a;b]]c;];", 0) == ([9], 0) and lex_line("[a;b]", 0) == ([], 0)
    assert lex_line(" Go\r", 0) == (None, 0) and lex_line("GO", 1) == ([], 1) and lex_line("GO 2", 0) == ([], 0)
