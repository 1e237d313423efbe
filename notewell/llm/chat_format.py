"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For each participant of a conversation the dialogue is rendered once with that speaker as
the assistant; all others appear as named users. The mask marks the assistant's words: only
they are trained on. System turns belong to no participant and stay as they are.

A rendering is returned as its turns: one row per turn, with the text of the turn in the
rendering, the places where it and its trained part lie in the whole string, and the mask.
A conversation is thus never gathered into one row or one task, however many turns it has.
Places come from sums per chunk of turns and sums over chunks.

Defined results: rows with a null conversation or a null role are left out; null texts
count as empty; rows repeated exactly stay repeated, in any order between themselves; a
null turn stands first; conversations without a participant give no rows; columns other
than the four used are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_TURNS = 1024  # consecutive turn numbers that are summed in one group
SYSTEM = "system"


def rotate(turns: DataFrame, chunk: int = CHUNK_TURNS) -> DataFrame:
    """One row per conversation, perspective and turn.

    ``segment`` is ``<|role|>`` or ``<|user:name|>``, a line break, the text and ``<|end|>``
    with a line break. ``start`` and ``end`` (characters, end excluded) place it in the whole
    rendering of the perspective; ``mask_start`` and ``mask_end`` place the trained part, which
    is the text and its end mark where the perspective itself speaks, and are null elsewhere.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL AND role IS NOT NULL")
    people = t.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "role", F.lit("|>\n")))
    body = F.concat("text", F.lit("<|end|>\n"))
    rows = (
        t.join(people, "conv_id")
        .withColumn("head", head)
        .withColumn("segment", F.concat("head", body))
        .withColumn("width", F.length("segment").cast("long"))
        .withColumn("chunk", F.floor(F.col("turn") / chunk))
    )
    sums = rows.groupBy("conv_id", "perspective", "chunk").agg(F.sum("width").alias("width"))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "perspective", "chunk", F.coalesce(F.sum("width").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.alias("r").join(sums.alias("s"), (F.col("r.conv_id") == F.col("s.conv_id")) & (F.col("r.perspective") == F.col("s.perspective")) & F.col("r.chunk").eqNullSafe(F.col("s.chunk")))
    placed = joined.select("r.*", "before").withColumn("start", F.col("before") + F.coalesce(F.sum("width").over(within), F.lit(0)))
    trained = F.col("role") == F.col("perspective")
    end = F.col("start") + F.col("width")
    return placed.select(
        "conv_id", "perspective", "turn", F.when(F.col("role") == SYSTEM, "system").when(trained, "assistant").otherwise("user").alias("chat_role"),
        F.when((F.col("role") != SYSTEM) & ~trained, F.col("role")).alias("name"), "segment", "start", end.alias("end"),
        F.when(trained, F.col("start") + F.length("head")).cast("long").alias("mask_start"), F.when(trained, end - 1).cast("long").alias("mask_end"),
    )
