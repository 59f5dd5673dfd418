"""Conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


def normalize_turns(df: DataFrame, most: int = 14, each: int = 8000, total: int = 32000) -> DataFrame:
    """The newest turns of each conversation within the budgets.

    Of the last ``most`` turns those of user and assistant with text stay, trimmed to ``each`` characters; a turn
    that repeats the one before is dropped; newest first, turns stay while the running length is within ``total``.
    Conversations without a user turn are dropped.
    """
    text = F.left(F.trim(F.coalesce("text", F.lit(""))), F.lit(each))
    t = last_n(df, ["conv_id"], "turn", most).where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", text.alias("text")).where("text <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn")
    again = (F.lag("role").over(w) == F.col("role")) & (F.lag("text").over(w) == F.col("text"))
    t = t.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").drop("again")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("run", F.sum(F.length("text")).over(back)).where(F.col("run") <= total)
    whole = Window.partitionBy("conv_id")
    return t.withColumn("asked", F.bool_or(F.col("role") == "user").over(whole)).where("asked").select("conv_id", "turn", "role", "text")


def completion_status(df: DataFrame, limit: int) -> DataFrame:
    long = F.length("text") > limit
    return df.withColumns({"finish": F.when(long, "length").otherwise("stop"), "truncated": long, "reason": F.when(long, "token limit")})
