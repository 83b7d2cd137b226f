"""Chat formatting: drops logged conversations that are the start of a longer one, then renders the rest.

Each turn is hashed with its number; running sums of these hashes identify the conversation up to each turn.
A conversation whose last sum is met before the last turn of another one is a snapshot of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are summed, and rendered, in one piece.
CHUNK = 512
SUMS = ["s0", "s1", "s2", "s3"]


def _halves(hashed: Column) -> list[Column]:
    return [hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, length, s0 to s3, last): the running sums of each conversation after each of its turns.

    Four sums of 32-bit hashes, so two different starts have one chance in 2^128 to be equal. Long conversations
    are summed in chunks of turn numbers, and the sums before each chunk are added on.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("turn", "role", "text")]
    hashed = _halves(F.xxhash64(*parts)) + _halves(F.xxhash64(F.lit("second"), *reversed(parts)))
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1))
    own = turns.where(F.col("conv_id").isNotNull()).select("conv_id", chunk.alias("chunk"), "turn", *[h.alias(s) for h, s in zip(hashed, SUMS, strict=True)]).distinct()
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), *SUMS).rowsBetween(Window.unboundedPreceding, 0)
    local = own.select("conv_id", "chunk", F.count("*").over(inside).alias("length"), *[F.sum(s).over(inside).alias(s) for s in SUMS])
    whole = own.groupBy("conv_id", "chunk").agg(F.count("*").alias("length"), *[F.sum(s).alias(s) for s in SUMS])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    all_of = F.sum("length").over(Window.partitionBy("conv_id"))
    carried = whole.select("conv_id", "chunk", all_of.alias("total"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("b_" + c) for c in ("length", *SUMS)])
    full = local.join(carried, ["conv_id", "chunk"]).select("conv_id", "total", *[(F.col(c) + F.col("b_" + c)).alias(c) for c in ("length", *SUMS)])
    return full.select("conv_id", "length", *SUMS, (F.col("length") == F.col("total")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id) of each conversation that is not the start of a longer one; of equal ones, the smallest id."""
    found = prefixes(turns)
    key = ["length", *SUMS]
    logged = found.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    starts = found.where("not last").select(*key).distinct()
    return logged.join(starts, key, "left_anti").select("conv_id")


def render(turns: DataFrame, template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """(conv_id, part, piece, turns, rendered): all turns of a conversation in order; a part for each CHUNK of turn numbers.

    Null roles and texts are empty; rows that repeat a turn count once; null turn numbers come first, in part 0.
    A part with more than CHUNK rows, of null or equal turn numbers, comes in pieces of so many.
    """
    pieces = template.replace("{role}", "\0role\0").replace("{text}", "\0text\0").split("\0")
    turn = F.concat(*[F.coalesce(F.col(p), F.lit("")) if p in ("role", "text") else F.lit(p) for p in pieces if p])
    own = turns.select("conv_id", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(0)).alias("part"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).distinct()
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    own = own.withColumn("piece", F.floor((rank - 1) / CHUNK))
    told = F.sort_array(F.collect_list(F.struct("turn", "role", "text", turn.alias("said"))))
    return own.groupBy("conv_id", "part", "piece").agg(told.alias("told")).select(
        "conv_id", "part", "piece", F.size("told").cast("long").alias("turns"), F.array_join(F.transform("told", lambda x: x["said"]), "").alias("rendered")
    )


def collapse(turns: DataFrame, template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """The maximal conversations, rendered. Rows with a null conv_id belong to none and are left out."""
    kept = maximal(turns)
    return render(turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id", "left_semi"), template)
