"""Conversations: sizes, compaction, repair, trimming. Turns are ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.text import utf8_size

def message_sizes(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", "role", utf8_size(F.col("text")).cast("long").alias("size"))


def compaction_cut(turns: DataFrame, trigger: int, keep: int) -> DataFrame:
    """Conversations over ``trigger`` bytes to the turn their kept tail begins at: the oldest user turn,
    from the end, within ``keep`` bytes, or else the newest user turn."""
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sized = message_sizes(turns).withColumn("tail", F.sum("size").over(back))
    user = F.col("role") == "user"
    cut = sized.groupBy("conv_id").agg(
        F.sum("size").alias("total"),
        F.coalesce(F.min(F.when(user & (F.col("tail") <= keep), F.col("turn"))), F.max(F.when(user, F.col("turn")))).alias("cut"),
    )
    return cut.filter(F.col("total") > trigger)


def unanswered(turns: DataFrame) -> DataFrame:
    """User turns that no other role follows."""
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("after", after).filter("role = 'user' AND coalesce(after, 'user') = 'user'").select("conv_id", "turn")


def repaired(turns: DataFrame) -> DataFrame:
    return turns.join(unanswered(turns), ["conv_id", "turn"], "left_anti")


def trimmed(turns: DataFrame, most: int = 40) -> DataFrame:
    """Conversations of over ``most`` turns from the first user turn of their last ``most``; untrimmed
    without one."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    numbered = turns.withColumn("place", place)
    starts = numbered.groupBy("conv_id").agg(F.max("place").alias("n"), F.min(F.when((F.col("place") <= most) & (F.col("role") == "user"), F.col("turn"))).alias("start"))
    return numbered.join(starts, "conv_id").filter(F.col("start").isNull() | (F.col("n") <= most) | (F.col("turn") >= F.col("start"))).select("conv_id", "turn", "role")


def squashed(turns: DataFrame, role: str, newest: int = 2, most: int = 1000) -> DataFrame:
    """Texts of a role cut to ``most`` characters, but for its ``newest`` turns."""
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.col("turn").desc()))
    text = F.when((F.col("role") == role) & (F.col("place") > newest), F.substring("text", 1, most)).otherwise(F.col("text"))
    return turns.withColumn("place", place).select("conv_id", "turn", "role", text.alias("text"))


def newest(turns: DataFrame, k: int) -> DataFrame:
    """The last turns of each conversation: a top-k, so the limit is the feature."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("place", place).filter(F.col("place") <= k)


def within_budget(pages: DataFrame, pages_most: int, chars: int) -> DataFrame:
    """The first pages of each document whose running length stays within ``chars``."""
    order = Window.partitionBy("doc_id").orderBy("page_index")
    return pages.withColumn("upto", F.sum(F.length("text")).over(order)).filter((F.col("upto") <= chars) & (F.col("page_index") < pages_most)).select("doc_id", "page_index", "upto")


def search(pages: DataFrame, needle: str, most: int = 20) -> DataFrame:
    """The first hit of each page, for each document's first ``most`` pages with one, with its surroundings."""
    from leafspark.functions.text import snippet

    at = F.instr(F.lower("text"), needle.lower())
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index"))
    hits = pages.withColumn("at", at).filter("at > 0").withColumn("place", place)
    return hits.filter(F.col("place") <= most).select("doc_id", "page_index", "at", snippet(F.col("text"), F.col("at")).alias("snippet"))
