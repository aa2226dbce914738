"""Conversation histories: trimming by count and by size, turns, and reassembly of fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trim_by_count(messages: DataFrame, most: int = 40) -> DataFrame:
    """Beyond ``most`` messages: the first two of the system and the last of the others.

    Input and output: conv_id, turn, role, text; output adds ``position`` (system first).
    """
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    whole = Window.partitionBy("conv_id")
    side = Window.partitionBy("conv_id", "is_system")
    ranked = (
        messages.withColumn("is_system", system)
        .withColumn("n", F.count("*").over(whole))
        .withColumn("first", F.row_number().over(side.orderBy("turn")))
        .withColumn("last", F.row_number().over(side.orderBy(F.desc("turn"))))
    )
    kept = ranked.where((F.col("n") <= most) | F.when(F.col("is_system"), F.col("first") <= 2).otherwise(F.col("last") <= max(most - 2, 2)))
    order = whole.orderBy(F.when(F.col("n") > most, ~F.col("is_system")).otherwise(F.lit(True)), "turn")
    return kept.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("position"))


def trim_by_chars(messages: DataFrame, most: int = 120_000) -> DataFrame:
    """Drops the oldest messages, those of the system last, while more than one is over ``most``.

    A message stays if everything that goes after it fits with it, or if it would be the last.
    """
    system = F.coalesce(F.col("role") == "system", F.lit(False)).cast("int")
    leaving = Window.partitionBy("conv_id").orderBy("leaves_late", "turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sized = messages.withColumn("leaves_late", system).withColumn("from_here", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(leaving))
    sized = sized.withColumn("behind", F.count("*").over(leaving))
    return sized.where((F.col("from_here") <= most) | (F.col("behind") == 1)).select("conv_id", "turn", "role", "text")


def turn_counts(messages: DataFrame) -> DataFrame:
    """conv_id, user turns, messages and characters."""
    return messages.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("turns"), F.count("*").alias("messages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
    )


def fragments(messages: DataFrame, size: int = 16) -> DataFrame:
    """Messages cut into fragments, as a stream delivers them: conv_id, turn, seq, fragment."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / size) - 1, F.lit(0)).cast("int"))
    cut = messages.where("text is not null").select("conv_id", "turn", "text", F.explode(starts).alias("seq"))
    return cut.select("conv_id", "turn", "seq", F.substring("text", F.col("seq") * size + 1, F.lit(size)).alias("fragment"))


def reassemble(parts: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Fragments joined in order of ``seq``."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "fragment")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["fragment"]), "").alias("text"))


def instruct(messages: DataFrame, said: DataFrame) -> DataFrame:
    """``messages`` with an instruction of the system after each conversation's leading ones of the system.

    ``said`` has conv_id and instruction (null: none). Output: conv_id, turn, part, role, text; an
    instruction (part 0) goes before the message (part 1) of its turn, or after the last turn.
    """
    other = F.coalesce(F.col("role") != "system", F.lit(True))
    places = messages.groupBy("conv_id").agg(F.coalesce(F.min(F.when(other, F.col("turn"))), F.max("turn") + 1).alias("turn"))
    added = places.join(said.where(F.col("instruction").isNotNull()), "conv_id").select("conv_id", "turn", F.lit(0).alias("part"), F.lit("system").alias("role"), F.col("instruction").alias("text"))
    return messages.select("conv_id", "turn", F.lit(1).alias("part"), "role", "text").unionByName(added)


def appended(history: DataFrame, new: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text: each conversation's stored messages and the new ones after them.

    Both have conv_id, turn, role and text; ``turn`` orders each of them (nulls first) and is kept.
    Conversations that only one of them has stay as they are. One conversation is ordered in one task.
    """
    names = ["conv_id", "turn", "role", "text"]
    both = history.select(*names, F.lit(0).alias("_late")).unionByName(new.select(*names, F.lit(1).alias("_late")))
    order = Window.partitionBy("conv_id").orderBy("_late", "turn", "role", "text")
    return both.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "turn", "role", "text")
