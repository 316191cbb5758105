"""Chat formatting by rotating the perspective: each speaker in turn is the assistant.

For every participant of a dialogue its turns are rendered once, with that speaker as
``assistant`` and everyone else as a named ``user``; the mask marks the characters the model
should learn, those of the assistant's turns. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Messages of a rendered piece. Longer dialogues are several rows, in the order of ``piece``.
PIECE = 64

#: Marks around a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """``conv_id, speaker, piece, part, n_turns, text, mask, n_learned`` per dialogue, participant and piece.

    A piece holds the turns ``piece * 64 .. piece * 64 + 63``; ``part`` counts on where more than 64
    messages share that range, so no row grows with its dialogue. The dialogue as a participant sees
    it is its texts joined in the order of ``piece, part``. ``mask`` lists ``[start, end)`` character
    ranges in the row's text. Messages are ordered by turn (null first), then speaker, then text;
    repeated messages stay. A null speaker is the participant ``unknown``, null text is empty, a null
    dialogue id is a dialogue of its own. Other columns are ignored; an empty table gives no rows.
    """
    message = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    ranged = message.withColumn("piece", F.floor(F.col("turn") / piece).cast("long"))
    within = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "body")
    numbered = ranged.withColumn("at", F.row_number().over(within) - 1) \
        .withColumn("part", F.floor(F.col("at") / piece).cast("long"))
    # A group has at most ``piece`` messages.
    pieces = numbered.groupBy("conv_id", "piece", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "body"))).alias("said"))

    speakers = message.select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    seen = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def rendered(m):
        mine = m["role"] == F.col("speaker")
        head = F.when(mine, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), m["role"], F.lit("\n")))
        return F.struct(F.concat(head, m["body"], F.lit(CLOSE)).alias("text"), mine.alias("mine"),
                        F.length(head).alias("head"), F.length(m["body"]).alias("size"))

    # The running start of each message, with what it adds to the mask.
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<array<int>>").alias("spans"))

    def grow(held, m):
        start = held["end"] + m["head"]
        return F.struct(
            (held["end"] + F.length(m["text"])).alias("end"),
            F.when(m["mine"], F.concat(held["spans"], F.array(F.array(start, start + m["size"] + len(CLOSE) - 1))))
            .otherwise(held["spans"]).alias("spans"))

    shown = seen.select("conv_id", "speaker", "piece", "part", F.transform("said", rendered).alias("said"))
    return shown.select(
        "conv_id", "speaker", "piece", "part", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda m: m["text"]), "").alias("text"),
        F.aggregate("said", zero, grow)["spans"].alias("spans")).select(
        "conv_id", "speaker", "piece", "part", "n_turns", "text",
        F.to_json("spans").alias("mask"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0))).cast("long").alias("n_learned"))
