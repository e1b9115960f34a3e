"""Mixing sources to target shares of tokens, interleaved by Pfair scheduling.

Each source gets a quota of the budget by its share; what a source cannot give within ``max_repeats`` passes
goes to the others by their shares. A source's texts are read in hashed order, pass after pass, until the
quota; the running totals are summed over hash buckets first, so a source that holds a third of all rows is no single
task. Streams are cut into blocks of ``block`` tokens. Of N blocks in all, a source with n blocks has the weight n / N: its block j is released at slot
floor(j N / n), is due at ceil((j + 1) N / n), and of the released blocks the one with the earliest deadline runs first. After every slot each source is less
than one block from its share.

Releases and deadlines are closed forms. The slots are cut into segments of ``segment``, which run side by side: what a segment takes over from
the one before (at most one block a source) is first guessed to be the released blocks with the latest deadlines. Segments whose guess
differs from what the one before really left run again, until none differs, so the order is that of one run over all slots.

Defined results: sources not among the targets, texts without source, null texts and texts of no tokens are not
used (uses 0 for texts of targeted sources that the quota does not reach); null or non-positive shares count as 0, null
repeats as 1; targets repeated for one source are added (the larger repeat counts); absent sources are reported with 0; a quota ends with
the text that crosses it, so a source exceeds it by less than one text; empty inputs give empty results.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.session import materialize

#: Texts to a hash bucket, about; blocks to a row of the first of two steps that list them.
BUCKET_ROWS, STRETCH = 100_000, 65_536


def quotas(sources: DataFrame, budget: int | None) -> DataFrame:
    """Adds ``quota`` to (source, share, most, held): shares of the budget (default: all that is held), capped at ``held * most``, the rest going to uncapped sources by share.

    In order of cap by share, a source is full if the tokens left by those before it, spread over the shares from it on, reach its cap. One row a source is sorted, no data.
    """
    cap = F.when((F.col("share") > 0) & (F.col("most") > 0), F.col("held") * F.col("most")).otherwise(F.lit(0))
    free = sources.withColumn("cap", cap)
    total = F.lit(budget).cast("long") if budget is not None else F.sum("held").over(W.partitionBy(F.lit(0)))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("share"), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("share").over(order.rowsBetween(0, W.unboundedFollowing))
    level = free.withColumn("all", total).where("cap > 0").withColumn("level", (F.col("all") - before) / ahead)
    level = level.withColumn("full", F.col("cap") <= F.col("level") * F.col("share"))
    # the level of the first source that is not full holds for all after it
    spread = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("share")).alias("at"), "source", "level"))).over(W.partitionBy(F.lit(0)))["level"]
    quota = F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.floor(spread * F.col("share")), F.lit(0))).cast("long")
    return free.drop("cap").join(level.select("source", quota.alias("quota")), "source", "left").fillna(0, ["quota"])


SLOTS = "segment long, source string, block long, due long, slot long"


def _earliest_first(segment: int, n: int):
    """A segment's blocks (carried ones with a release before it) by release and deadline; ``slot`` stays null for what it leaves."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        start, stop = key[0] * segment, min((key[0] + 1) * segment, n)
        order = rows.sort_values(["release", "due", "source"])
        waiting = list(zip(order["release"], order["due"], order["source"], order["block"]))
        ready: list[tuple] = []
        out, at = [], 0
        for t in range(start, stop):
            while at < len(waiting) and waiting[at][0] <= t:
                heappush(ready, waiting[at][1:])
                at += 1
            if ready:
                due, source, block = heappop(ready)
                out.append((key[0], source, block, due, t))
        out += [(key[0], s, b, d, None) for d, s, b in ready] + [(key[0], s, b, d, None) for _, d, s, b in waiting[at:]]
        return pd.DataFrame(out, columns=["segment", "source", "block", "due", "slot"]).astype({"slot": "Int64"})

    return run


def schedule(counts: DataFrame, segment: int = 4096) -> DataFrame:
    """(source, block, release, due, slot) of all blocks of (source, n_blocks)."""
    counts = counts.where("n_blocks > 0")
    n = counts.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    listed = counts.select("source", "n_blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_blocks") - 1) / STRETCH))).alias("k"))
    listed = listed.repartition("source", "k") if n > STRETCH else listed
    block = F.explode(F.sequence(F.col("k") * STRETCH, F.least((F.col("k") + 1) * STRETCH, F.col("n_blocks")) - 1)).alias("block")
    listed = listed.select("source", F.col("n_blocks").cast("decimal(38,0)").alias("m"), block)
    turn = lambda b: F.expr(f"cast({b} as decimal(20,0)) * cast({n} as decimal(18,0))")
    blocks = listed.select("source", F.col("block").cast("long").alias("block"), turn("block").alias("x"), turn("block + 1").alias("y"), "m")
    blocks = materialize(blocks.select("source", "block", F.expr("cast(x div m as long)").alias("release"), F.expr("cast((y + m - 1) div m as long)").alias("due")).withColumn("segment", F.floor(F.col("release") / segment)), "blocks")
    run = lambda df: df.groupBy("segment").applyInPandas(_earliest_first(segment, n), SLOTS)
    cols = ["segment", "source", "block", "release", "due"]

    # a block is released and not due at the segments' starts within its window
    spans = blocks.where(F.floor((F.col("due") - 1) / segment) > F.col("segment"))
    open_ = spans.select(F.explode(F.sequence(F.col("segment") + 1, F.floor((F.col("due") - 1) / segment))).alias("segment"), "source", "block", "release", "due").where(F.col("segment") * segment < F.col("due"))
    ended = blocks.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select((F.col("segment") + 1).alias("segment"), F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("segment")).alias("released"))
    pending = ended.select("segment", (F.col("released") - F.col("segment") * segment).alias("pending"))
    late = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("due"), F.desc("source")))
    used = materialize(open_.join(pending, "segment").withColumn("r", late).where(F.col("r") <= F.col("pending")).select(*cols), "carried")
    out = materialize(run(blocks.select(*cols).unionByName(used)), "slots")
    mark = lambda df, name: df.groupBy("segment").agg(F.bit_xor(F.xxhash64("source", "block")).alias(name))
    while True:
        left = out.where("slot is null").select((F.col("segment") + 1).alias("segment"), "source", "block", F.lit(-1).cast("long").alias("release"), "due").where(F.col("segment") * segment < n)
        wrong = materialize(mark(left, "x").join(mark(used, "y"), "segment", "full").where("not (x <=> y)").select("segment"), "wrong")
        if wrong.isEmpty():
            break
        again = left.join(wrong, "segment", "left_semi")
        redone = run(blocks.select(*cols).join(wrong, "segment", "left_semi").unionByName(again))
        used, out = materialize(used.join(wrong, "segment", "left_anti").unionByName(again), "carried"), materialize(out.join(wrong, "segment", "left_anti").unionByName(redone), "slots")
    return out.where("slot is not null").join(blocks.select("source", "block", "release"), ["source", "block"]).select("source", "block", "release", "due", "slot")


def mix(sizes: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", budget: int | None = None, block: int = 2048, segment: int = 4096, seed: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: id, source, n_tokens, start, uses, held; shares by source; schedule: source, block, release, due, slot).

    ``sizes`` has the id, ``source`` and ``n_tokens``. The budget defaults to all tokens of the targeted sources.
    """
    share, most = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    plan = targets.where("source is not null").groupBy("source").agg(F.sum(share).cast("double").alias("share"), F.max(most).alias("most"))
    own = sizes.where("n_tokens > 0 and source is not null").join(plan.select("source"), "source", "left_semi")
    buckets = max(64, sizes.count() // BUCKET_ROWS)
    own = own.select(F.col(id_col).alias("id"), "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = materialize(own.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "sums")
    held = sums.groupBy("source").agg(F.sum("tokens").alias("held"))
    given = materialize(quotas(plan.join(held, "source", "left").fillna(0, ["held"]), budget), "quotas")

    offset = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bounds = sums.select("source", "bucket", offset.alias("offset")).join(given.select("source", "held", "quota"), "source")
    texts = (
        own.withColumn("before", before).join(bounds, ["source", "bucket"]).withColumn("start", F.col("offset") + F.col("before"))
        .withColumn("uses", (F.expr("quota div held") + (F.col("start") < F.expr("quota % held")).cast("int")).cast("int"))
        .select("id", "source", "n_tokens", "start", "uses", "held")
    )
    order = schedule(given.select("source", F.ceil(F.col("quota") / F.lit(block)).alias("n_blocks")), segment)
    used = texts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.sum((F.col("uses") > 0).cast("long")).alias("texts_used"), F.max("uses").alias("most_uses"))
    report = given.join(used, "source", "left").fillna(0, ["used_tokens", "texts_used", "most_uses"])
    all_tokens = F.sum("used_tokens").over(W.partitionBy(F.lit(0)))  # one row a source
    report = report.withColumn("all_tokens", all_tokens).select("source", F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), F.col("held").alias("held_tokens"), "used_tokens", "texts_used", "most_uses", F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"))
    return texts, report, order


def sequence(texts: DataFrame, order: DataFrame, block: int = 2048) -> DataFrame:
    """(slot, source, pass, id, n_tokens, start, position): every use where the schedule has the block it begins in (slot null: never used); position is the use's offset in its source's stream."""
    each = texts.select("id", "source", "n_tokens", "start", "held", F.explode_outer(F.when(F.col("uses") > 0, F.expr("sequence(0, uses - 1)"))).alias("pass")).withColumn("position", F.col("pass") * F.col("held") + F.col("start"))
    placed = each.withColumn("block", F.floor(F.col("position") / F.lit(block))).join(order.select("source", "block", "slot"), ["source", "block"], "left")
    lost = F.raise_error(F.concat(F.lit("no slot for source "), "source")).cast("long")
    return placed.select(F.when(F.col("pass").isNotNull(), F.coalesce("slot", lost)).alias("slot"), "source", "pass", "id", "n_tokens", "start", "position")


def lags(order: DataFrame) -> DataFrame:
    """Per source: blocks, the most by which it is ahead of and behind its share after any slot (in blocks), and blocks outside their window."""
    sizes = order.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"))
    whole = sizes.withColumn("all", F.sum("n_blocks").over(W.partitionBy(F.lit(0))))  # one row a source
    share = F.col("n_blocks") / F.col("all")
    x = order.join(whole, "source").withColumn("ahead", F.col("block") + 1 - share * (F.col("slot") + 1)).withColumn("behind", share * F.col("slot") - F.col("block"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"), F.round(F.max("ahead"), 6).alias("most_ahead"), F.round(F.max("behind"), 6).alias("most_behind"), F.count_if((F.col("slot") < F.col("release")) | (F.col("slot") >= F.col("due"))).alias("n_outside"))
