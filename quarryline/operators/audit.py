"""Keyed hash chains: links made from the record before, and their check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as X

FIRST = "GENESIS"
canonical = X.canonical


def link(previous: Column, payload: Column, key: bytes) -> Column:
    """Hash of a record: keyed digest of the hash before it (the first has none) and its canonical payload."""
    return X.hmac_sha256(key, F.concat(F.coalesce(previous, F.lit(FIRST)), F.lit("|"), payload))


def chained(records: DataFrame, order: str, payload: str, key: bytes) -> DataFrame:
    """Adds sequence, prev_hash and record_hash in the order given.

    A chain is made one link after the other, so ``records`` must be few (an anchor a day, say): they are folded in one row. Its check is not.
    """
    rows = records.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p")))).alias("rows"))
    none = F.array().cast("array<struct<o: " + records.schema[order].dataType.simpleString() + ", p: string, prev: string, hash: string>>")
    last = lambda done: F.try_element_at(done, F.lit(-1))["hash"]
    grow = lambda done, x: F.concat(done, F.array(F.struct(x["o"].alias("o"), x["p"].alias("p"), last(done).alias("prev"), link(last(done), x["p"], key).alias("hash"))))
    made = rows.select(F.posexplode(F.aggregate("rows", none, grow)).alias("at", "x"))
    return made.select((F.col("at") + 1).cast("long").alias("sequence"), F.col("x.o").alias(order), F.col("x.p").alias(payload), F.col("x.prev").alias("prev_hash"), F.col("x.hash").alias("record_hash"))


def verified(chain: DataFrame, payload: str, key: bytes, by: list[str] | None = None) -> DataFrame:
    """Adds ``fault`` to (sequence, prev_hash, record_hash, payload): null, 'hash' (does not follow from its own fields, looked at first) or 'link' (not the hash before it).

    Every record is checked by itself against the one before. ``by`` names the columns of separate chains (tenants, months): without it one task sorts the records' hashes.
    """
    before = F.lag("record_hash").over(W.partitionBy(*([F.col(c) for c in by] if by else [F.lit(0)])).orderBy("sequence"))
    x = chain.withColumn("_before", before)
    fault = F.when(~link(F.col("prev_hash"), F.col(payload), key).eqNullSafe(F.col("record_hash")), "hash").when(F.col("_before").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("_before")), "link")
    return x.withColumn("fault", fault).drop("_before")


def verdict(checked: DataFrame) -> DataFrame:
    """One row: records, ok, first bad sequence and its fault."""
    bad = F.min(F.when(F.col("fault").isNotNull(), F.struct("sequence", "fault")))
    return checked.agg(F.count(F.lit(1)).alias("n_records"), bad.alias("b")).select("n_records", F.col("b").isNull().alias("ok"), F.col("b.sequence").alias("first_bad"), F.col("b.fault").alias("fault"))
