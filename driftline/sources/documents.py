"""One JSON document of any size as rows of its records, read by many tasks.

A document ``{table: [record, ...], ...}`` is read as pieces that end with a closing brace, each task its byte range.
Whether a piece starts inside a text and how deep it lies depends on all pieces before it; both are sums (of quotation
marks, of brackets opened less closed), so each range is summed first, the few sums of a file are added up in order,
and every piece takes what its range and the ranges before it add. No task reads more than its range, and only the
records that go over several pieces are put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A text between quotation marks, to its end or the end of the piece.
_TEXT = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\z)'

_NAME = r'"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"'
_EMPTY = r"(?:null|\[\s*+\])"

#: What may stand before a record: the document's start, a comma, or the end of a table and the name of the next.
_FIRST = rf"^\s*+\{{\s*+(?:{_NAME}\s*+:\s*+{_EMPTY}\s*+,\s*+)*+{_NAME}\s*+:\s*+\[\s*+\{{"
_NEXT = r"^\s*+,\s*+\{"
_NEXT_TABLE = rf"^\s*+\]\s*+(?:,\s*+{_NAME}\s*+:\s*+{_EMPTY}\s*+)*+,\s*+{_NAME}\s*+:\s*+\[\s*+\{{"

#: What may stand before the end of the document.
_NOTHING = rf"^\s*+\{{\s*+(?:{_NAME}\s*+:\s*+{_EMPTY}\s*+(?:,\s*+{_NAME}\s*+:\s*+{_EMPTY}\s*+)*+)?+\z"
_LAST = rf"^\s*+\]\s*+(?:,\s*+{_NAME}\s*+:\s*+{_EMPTY}\s*+)*+\z"

_RANGE = ["file", "block"]


def _count(text: Column, other: str) -> Column:
    """Characters of a text that ``other`` doesn't match."""
    return F.length(F.regexp_replace(text, other, ""))


def add_up(pieces: DataFrame, **values: Column) -> DataFrame:
    """``pieces`` with the sum of each value over all pieces before, of the same file.

    Sums of a range are added up over the ranges of a file, and inside a range over its pieces.
    """
    pieces = pieces.withColumns({f"_{n}": v.cast("bigint") for n, v in values.items()})
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy(*_RANGE).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values]).select(
        *_RANGE, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_range") for n in values])
    inside = Window.partitionBy(*_RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(ranges, _RANGE).withColumns({
        n: F.col(f"_{n}_range") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in values}).drop(
        *[f"_{n}" for n in values], *[f"_{n}_range" for n in values])


def _with_table(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``table``, the last ``header`` up to a piece."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy(*_RANGE).agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("pos"))).alias("_last")).select(
        *_RANGE, F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    inside = Window.partitionBy(*_RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.join(ranges, _RANGE).withColumn(
        "table", F.coalesce(F.last("header", ignorenulls=True).over(inside), "_earlier")).drop("_earlier", "header")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, pos, piece, closes, first, final``: the pieces of the files, and whether a brace follows."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("piece"))
    # Behind the last piece of a file stands a brace, unless with all braces the file would be one byte longer.
    ranges = raw.groupBy(*_RANGE).agg(F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("pos").alias("last"),
                                      F.min("pos").alias("start"), F.any_value("size").alias("size"))
    files = Window.partitionBy("file")
    ranges = ranges.select(
        *_RANGE, F.when(F.max("block").over(files) == F.col("block"), F.col("last")).alias("last"),
        F.when(F.min("block").over(files) == F.col("block"), F.col("start")).alias("start"),
        (F.sum("bytes").over(files) > F.col("size")).alias("open"))
    at = lambda place: F.col("pos").eqNullSafe(F.col(place))
    return raw.drop("size").join(ranges, _RANGE).withColumns({
        "first": at("start"), "final": at("last"), "closes": ~(at("last") & F.col("open"))}).drop("open", "start", "last")


def split_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, table_name, ordinal, record`` of documents ``{table: [record, ...], ...}``, one file each.

    ``record`` is the text of an object and ``ordinal`` its place in its table, from 0. A table without records may be
    an empty array or null. Anything else than such a document, a repeated table or a table name with a closing brace
    too, is an error when the rows are read; an empty file has no rows. Files must be uncompressed to be read in ranges of
    ``spark.sql.files.maxPartitionBytes``.
    """
    bad = lambda why: F.raise_error(F.concat(F.lit(f"not a capture document, {why}: "), "file")).cast("boolean")
    pieces = _pieces(spark, path)
    quotes = _count(F.col("piece"), r'\\[\s\S]|[^"\\]++')
    pieces = add_up(pieces.withColumn("quotes", quotes), quoted=F.col("quotes"))
    inside = F.col("quoted") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "piece"), _TEXT, "")
    ends_inside = (F.col("quoted") + F.col("quotes")) % 2 == 1
    pieces = pieces.withColumns({"inside": inside, "outside": outside, "brace": F.col("closes") & ~ends_inside})
    step = _count(F.col("outside"), r"[^\[{]++") - _count(F.col("outside"), r"[^\]]++") - F.col("brace").cast("int")
    pieces = add_up(pieces.withColumn("step", step).drop("outside", "quotes", "quoted"), depth=F.col("step"))

    after, piece = F.col("depth") + F.col("step"), F.col("piece")
    starts = ~F.col("inside") & ((F.col("depth") == 2) | F.col("first"))
    lead = F.when(starts, F.when(F.col("first"), F.regexp_extract(piece, _FIRST, 0)).otherwise(F.coalesce(
        F.nullif(F.regexp_extract(piece, _NEXT, 0), F.lit("")), F.regexp_extract(piece, _NEXT_TABLE, 0))))
    ending = F.col("brace") & (after == 0) & F.when(F.col("first"), piece.rlike(_NOTHING)).otherwise((F.col("depth") == 2) & piece.rlike(_LAST))
    trailing = ~F.col("closes") & (F.col("depth") == 0) & ~F.col("first") & piece.rlike(r"^\s*\z")
    within = F.col("inside") | (F.col("depth") > 2)
    pieces = pieces.withColumns({"lead": lead, "ends": F.col("brace") & (after == 2)})
    cut_off = ~F.col("closes") | (F.col("final") & (after != 0))
    good = F.when(trailing | ending, True).when(cut_off, bad("it isn't closed")).when(
        starts & (F.col("lead") != ""), (after >= 2) | bad("brackets don't match")).when(
        within, ((after >= 2) | F.col("inside")) | bad("brackets don't match")).otherwise(bad("no record where one should stand"))
    named = F.when(F.col("lead") != "", F.regexp_extract_all("lead", F.lit(_NAME), F.lit(1)))
    pieces = pieces.withColumn("record", F.when(trailing | ending, False).otherwise(good)).withColumn("names", named)
    pieces = add_up(pieces.select(*_RANGE, "pos", "piece", "lead", "ends", "record", "names"), number=F.col("ends"))
    name = F.from_json(F.concat(F.lit('["'), F.element_at("names", -1), F.lit('"]')), "array<string>")[0]
    pieces = _with_table(pieces.withColumn("header", F.when(F.size("names") > 0, F.struct(
        F.col("number").alias("start"), name.alias("name")))))

    # Tables may not come again: the names of a file, few beside its records, are counted.
    again = pieces.where(F.size("names") > 0).select("file", F.explode("names").alias("name")).groupBy("file", "name").agg(
        F.count(F.lit(1)).alias("times")).where("times > 1").groupBy("file").agg(F.count(F.lit(1)).alias("again"))
    pieces = pieces.where("record").select(
        "file", "block", "pos", "number", F.col("table.name").alias("table_name"), (F.col("number") - F.col("table.start")).alias("ordinal"),
        F.when(F.coalesce(F.col("lead"), F.lit("")) != "", F.concat(F.lit("{"), F.substring(F.col("piece"), F.length("lead") + 1, F.length("piece"))))
        .otherwise(F.col("piece")).alias("body"), "ends", (F.coalesce(F.col("lead"), F.lit("")) != "").alias("begins"))
    # The optimizer may parse a record before it filters; of a piece that is none it is to see nothing.
    alone = F.when(F.col("begins") & F.col("ends"), F.concat("body", F.lit("}")))
    whole = pieces.where("begins AND ends").select("file", "table_name", "ordinal", alone.alias("record"))
    several = pieces.where("NOT (begins AND ends)").groupBy("file", "number").agg(
        F.max("table_name").alias("table_name"), F.max("ordinal").alias("ordinal"),
        F.array_sort(F.collect_list(F.struct("block", "pos", "body"))).alias("parts"), F.max("ends").alias("ended"))
    several = several.where(F.col("ended") | bad("it isn't closed")).select(
        "file", "table_name", "ordinal", F.concat(F.array_join(F.col("parts.body"), "}"), F.lit("}")).alias("record"))
    rows = whole.unionByName(several).join(again, "file", "left")
    return rows.where(F.col("again").isNull() | bad("a table comes twice")).select("file", "table_name", "ordinal", "record")
