"""Joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key to a part, about.
PART_ROWS = 200_000


def lookup(many: DataFrame, one: DataFrame, key: str, how: str = "inner", part_rows: int = PART_ROWS) -> DataFrame:
    """``many`` joined to ``one`` (which has a key once) by ``key``; a key with more than ``part_rows`` rows is cut into parts, each with its own copy of the one row.

    Equal rows go to one part, so parts of a flood of repeated rows stay uneven; null keys match nothing and are kept by a left join, spread like a hot key.
    """
    clash = {"_part", "_parts"} & ({*many.columns} | {*one.columns})
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).select(key, F.ceil(F.col("n") / part_rows).cast("int").alias("_parts"))
    share = F.pmod(F.xxhash64(*many.columns), F.coalesce("_parts", F.when(F.col(key).isNull(), 1024), F.lit(1))).cast("int")
    left = many.join(hot, key, "left").withColumn("_part", share).drop("_parts")
    right = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
