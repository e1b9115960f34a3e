"""Filling containers of fixed capacity: bulk-synchronous best fit over runs of equal sizes.

Documents of one size are interchangeable, so documents and gaps are runs (size, first rank, count) and (free
room, first container, count); there are at most ``capacity`` document runs whatever the number of documents. A superstep range-sorts the
runs by size into as many ranges as their number asks for. In every range a sweep gives each document its successor gap (the least room that
holds it); conflicts over a gap go by rank (larger documents, then lower rank, first). What a range leaves over is matched
across ranges: seen from the largest size down, gaps open brackets and documents close them, so the counts left by the ranges alone (one row a range)
tell which of the documents of a range meet which gaps of a higher one; these are paired by rank, each pair of ranges a task. Then the gaps are updated, and
it repeats; when no gap holds anything, new containers open. Documents are ranked within their size by salted counts and get
their container by joining rank and placed runs in stretches of ranks.

Defined results: null texts and texts of no tokens need no room and are left out; a text above the
capacity is divided into token ranges of ``capacity`` and a rest, nothing else is divided; rows repeated under one id
are placed each; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.session import materialize

#: Runs to a range (to one task of a sweep), about; items to a salt of one size; ranks to a stretch of the last join.
RANGE_ROWS, SALT_ROWS, STRETCH = 4096, 500_000, 1024


def pieces(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece, token_start, size): whole documents and the ranges of those above the capacity."""
    n, c = F.col(size_col).cast("long"), F.lit(capacity)
    last = F.greatest(F.ceil(n / c).cast("int") - 1, F.lit(0))
    return (
        sizes.where(n > 0)
        .select(F.col(id_col).alias("id"), n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select("id", "piece", (F.col("piece") * c).cast("long").alias("token_start"), F.least(F.col("n") - F.col("piece") * c, c).cast("int").alias("size"))
    )


def ranked(df: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank`` (from 0) within ``size``; a size that a third of all rows share is ranked in ``salts`` parts."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("size", "salt").count()
    before = F.sum("count").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    local = F.row_number().over(W.partitionBy("size", "salt").orderBy("id", "piece")) - 1
    return salted.withColumn("local", local).join(offsets, ["size", "salt"]).select("id", "piece", "token_start", "size", (F.col("offset") + F.col("local")).alias("rank"))


#: Runs: kind 0 documents (value = size, first = rank), 1 gaps (value = room, first = container), 2 placed (bin = container of the first).
RUNS = "kind int, value long, first long, n long, bin long"


def sweep(runs: pd.DataFrame) -> pd.DataFrame:
    """Match runs from the largest value down; the gap seen last is the least that holds the document at hand.

    Larger documents come first and equal ones by rank, so rank settles which of them gets a gap. A gap takes one
    document a sweep; its rest (kind 3) is a gap of the next.
    """
    runs = runs.sort_values(["value", "kind", "first"], ascending=[False, False, True])
    out: list[tuple] = []
    open_gaps: list[list[int]] = []
    for kind, value, first, n in zip(runs["kind"], runs["value"], runs["first"], runs["n"]):
        if kind == 1:
            open_gaps.append([value, first, n])
            continue
        while n and open_gaps:
            gap = open_gaps[-1]
            m = min(n, gap[2])
            out.append((2, value, first, m, gap[1]))
            if gap[0] > value:
                out.append((3, gap[0] - value, gap[1], m, None))
            first, n, gap[1], gap[2] = first + m, n - m, gap[1] + m, gap[2] - m
            if not gap[2]:
                open_gaps.pop()
        if n:
            out.append((0, value, first, n, None))
    out += [(1, room, first, n, None) for room, first, n in open_gaps]
    return pd.DataFrame(out, columns=["kind", "value", "first", "n", "bin"]).astype({"bin": "Int64"})


LEFT = RUNS + ", part int, at long"


def sweeps(times: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One range's part of a superstep: up to ``times`` sweeps over its own runs, gaps updated after each.

    Adds ``part``, the range (-1 for gaps to be left alone), and ``at``: how many documents, from the largest down, or gaps, from the least up, of the range come before the run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        state = pd.concat(list(batches) or [pd.DataFrame(columns=["kind", "value", "first", "n", "bin"])])
        if not len(state):
            return
        done, low = [], state["value"].min()
        for _ in range(times):
            out = sweep(state)
            hit = out["kind"] == 2
            done.append(out[hit].assign(at=0))
            state = out[~hit].assign(kind=out.loc[~hit, "kind"].replace(3, 1))
            if not hit.any():
                break
        docs = state[state["kind"] == 0].sort_values(["value", "first"], ascending=[False, True])
        gaps = state[state["kind"] == 1].sort_values(["value", "first"])
        # rests that sank below the range wait for the next superstep: they may be too small for documents of lower ranges
        sunk = (gaps["value"] < low).to_numpy()
        left = [docs.assign(at=docs["n"].cumsum() - docs["n"]), gaps[sunk].assign(at=0, part=-1), gaps[~sunk].assign(at=lambda x: x["n"].cumsum() - x["n"])]
        out = pd.concat([*done, *left])
        part = out["part"] if "part" in out else pd.Series(np.nan, out.index)
        yield out.assign(part=part.fillna(TaskContext.get().partitionId()).astype(int))[["kind", "value", "first", "n", "bin", "part", "at"]]

    return run


def brackets(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], dict[int, int]]:
    """((range of gaps, first gap, range of documents, first document, how many) of each match, gaps and documents matched by range).

    ``counts`` has (range, documents, gaps) from the largest sizes down; the gaps seen last are taken first.
    """
    out: list[tuple[int, int, int, int, int]] = []
    gaps_used: dict[int, int] = {}
    docs_used: dict[int, int] = {}
    open_: list[list[int]] = []
    for part, docs, gaps in counts:
        done = 0
        while done < docs and open_:
            top, n = open_[-1][0], min(docs - done, open_[-1][1])
            out.append((top, gaps_used.get(top, 0), part, done, n))
            gaps_used[top] = gaps_used.get(top, 0) + n
            done += n
            open_[-1][1] -= n
            if not open_[-1][1]:
                open_.pop()
        docs_used[part] = done
        if gaps:
            open_.append([part, gaps])
    return out, gaps_used, docs_used


def _paired(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents and gaps of one match, paired by their place in it: placed runs and the rests of their gaps."""
    docs, gaps = (rows[rows["kind"] == k].sort_values("at")[["value", "first", "n"]].to_numpy().tolist() for k in (0, 1))
    out, g = [], 0
    for value, first, n in docs:
        while n:
            room, container, have = gaps[g]
            m = min(n, have)
            out.append((2, value, first, m, container))
            if room > value:
                out.append((1, room - value, container, m, None))
            first, n = first + m, n - m
            gaps[g] = [room, container + m, have - m]
            g += have == m
    return pd.DataFrame(out, columns=["kind", "value", "first", "n", "bin"]).astype({"bin": "Int64"})


def superstep(state: DataFrame, rows: int, range_rows: int, times: int) -> DataFrame:
    """Sweeps in every range of sizes, then matches of what the ranges leave over."""
    spark, runs = state.sparkSession, [c.strip().split()[0] for c in RUNS.split(",")]
    parts = -(-rows // range_rows)
    kept = materialize(state.repartitionByRange(parts, F.desc("value")).mapInPandas(sweeps(times), LEFT), "sweep")
    if parts == 1:
        return kept.select(*runs)
    # one row a range
    counts = kept.where("kind < 2 and part >= 0").groupBy("part").agg(F.sum(F.expr("if(kind = 0, n, 0)")).alias("docs"), F.sum(F.expr("if(kind = 1, n, 0)")).alias("gaps")).orderBy("part").collect()
    matches, gaps_used, docs_used = brackets([tuple(r) for r in counts])
    if not matches:
        return kept.select(*runs)
    sides = [(m, kind, part, at, n) for m, (g, g_at, d, d_at, n) in enumerate(matches) for kind, part, at in ((1, g, g_at), (0, d, d_at))]
    sides = spark.createDataFrame(sides, "match int, kind int, part int, from_at long, many long")
    used = spark.createDataFrame([(1, p, n) for p, n in gaps_used.items()] + [(0, p, n) for p, n in docs_used.items()], "kind int, part int, used long")
    left = kept.where("kind < 2").join(used, ["kind", "part"], "left").fillna(0, ["used"])
    # of a run that is matched in part, the rest stays
    stay = left.withColumn("cut", F.least(F.greatest(F.col("used") - F.col("at"), F.lit(0)), F.col("n"))).select("kind", "value", (F.col("first") + F.col("cut")).alias("first"), (F.col("n") - F.col("cut")).alias("n"), "bin").where("n > 0")
    a, b = F.greatest("at", "from_at"), F.least(F.col("at") + F.col("n"), F.col("from_at") + F.col("many"))
    inside = left.join(sides, ["kind", "part"]).where(a < b)
    inside = inside.select("match", "kind", "value", (F.col("first") + a - F.col("at")).alias("first"), (b - a).alias("n"), (a - F.col("from_at")).alias("at"))
    across = inside.groupBy("match").applyInPandas(_paired, RUNS)
    return materialize(kept.where("kind = 2").select(*runs).unionByName(stay).unionByName(across), "superstep")


def place_runs(runs: DataFrame, capacity: int, range_rows: int = RANGE_ROWS, times: int = 16, most_rounds: int = 100_000) -> DataFrame:
    """Placed runs (size, from_rank, n, bin) of document runs (size, n)."""
    spark = runs.sparkSession
    empty = F.lit(None).cast("long").alias("bin")
    state = runs.select(F.lit(0).alias("kind"), F.col("size").cast("long").alias("value"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), empty)
    placed, bins = [], 0
    for _ in range(most_rounds):
        total = lambda c: F.coalesce(F.sum(F.expr(c)), F.lit(0))
        seen = state.agg(
            total("if(kind = 0, value * n, 0)").alias("room"), total("if(kind = 0, n, 0)").alias("docs"), total(f"if(kind = 0 and 2 * value > {capacity}, n, 0)").alias("large"),
            F.min(F.expr("if(kind = 0, value, null)")).alias("least"), F.coalesce(F.max(F.expr("if(kind = 1, value, null)")), F.lit(0)).alias("widest"), F.count(F.lit(1)).alias("rows"),
        ).first()
        if not seen["docs"]:
            break
        state = state.where(F.expr(f"kind = 0 or value >= {seen['least']}"))  # closed containers leave
        if seen["widest"] < seen["least"]:
            new = min(seen["docs"], max(-(-seen["room"] // capacity), seen["large"]))
            fresh = spark.range(1).select(F.lit(1).alias("kind"), F.lit(capacity).cast("long").alias("value"), F.lit(bins).cast("long").alias("first"), F.lit(new).cast("long").alias("n"), empty)
            state, bins = state.where("kind = 0").unionByName(fresh), bins + new
        out = superstep(state, seen["rows"], range_rows, times)
        placed.append(out.where("kind = 2").select(F.col("value").cast("int").alias("size"), F.col("first").alias("from_rank"), "n", "bin"))
        state = out.where("kind < 2")
    else:
        raise RuntimeError("containers not settled")
    if not placed:
        return spark.createDataFrame([], "size int, from_rank long, n long, bin long")
    while len(placed) > 1:  # a balanced union keeps the plan shallow
        placed = [x[0].unionByName(x[1]) if len(x) > 1 else x[0] for x in (placed[i : i + 2] for i in range(0, len(placed), 2))]
    return placed[0]


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, range_rows: int = RANGE_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(id, piece, token_start, size, container): the container (from 0) of every document or piece."""
    salts = max(8, sizes.count() // salt_rows)
    items = materialize(ranked(pieces(sizes, id_col, size_col, capacity), salts), "ranked")
    placed = place_runs(items.groupBy("size").agg(F.count(F.lit(1)).alias("n")), capacity, range_rows)
    stretch = F.explode(F.sequence(F.expr(f"from_rank div {STRETCH}"), F.expr(f"(from_rank + n - 1) div {STRETCH}"))).alias("stretch")
    placed = placed.select(F.col("size").alias("run_size"), stretch, "from_rank", "n", "bin")
    hit = (F.col("size") == F.col("run_size")) & (F.expr(f"rank div {STRETCH}") == F.col("stretch")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n"))
    return items.join(placed, hit).select("id", "piece", "token_start", "size", (F.col("bin") + F.col("rank") - F.col("from_rank")).alias("container"))


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, n_pieces, n_tokens, fill) of every container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("n_tokens")).withColumn("fill", F.col("n_tokens") / F.lit(capacity))
