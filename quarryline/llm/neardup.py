"""Near-duplicate texts: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Exact copies (the same word sequence) are folded into one representative first, so a
text that a third of all rows repeat costs one signature. Candidates come from
bands; buckets above ``bucket`` members are cut into blocks whose pairs are separate
groups, so no task holds an unbounded bucket and no pair is lost. Candidate signatures are
compared in batches, first one bit each of 64 values, then whole values, and dropped once the posterior chance of reaching the threshold falls below
a batch's part of ``miss``: the parts of all batches add up to it, so a pair at the threshold falls with that chance at most.
Survivors are verified on their full texts.

Defined results: null ids or texts and texts with fewer than ``min_words`` words take no part; rows repeated under
one id count once (different texts under one id each count); an empty input gives an empty result of
the same schema; columns other than the two named are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import sketch as S
from quarryline.session import materialize


def _below(trials: int, p: float, most: int) -> float:
    """P(Binomial(trials, p) <= most)."""
    return sum(comb(trials, m) * p**m * (1 - p) ** (trials - m) for m in range(most + 1))


def min_matches(threshold: float, count: int, step: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest equal values to go on) after each batch of ``step``.

    With a uniform prior the posterior of the similarity after m of n equal values is
    Beta(m+1, n-m+1); P(similarity >= t) equals P(Binomial(n+1, t) <= m). ``miss`` is what one batch may lose.
    """
    return [(n, next(m for m in range(n + 1) if _below(n + 1, threshold, m) >= miss)) for n in range(step, count + 1, step)]


def most_differing(threshold: float, count: int, miss: float) -> int:
    """Of ``count`` one-bit values, the most that may differ before the posterior chance of reaching the threshold falls below ``miss``.

    At similarity s a bit agrees with chance p = (1 + s) / 2; with a uniform prior on s the posterior of p is Beta(m+1, n-m+1) cut to 1/2..1.
    """
    up = lambda m: _below(count + 1, (1 + threshold) / 2, m) / _below(count + 1, 0.5, m)
    return count - next(m for m in range(count + 1) if up(m) >= miss)


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, perms: int, min_words: int, remember: int = 200_000) -> DataFrame:
    """id, fp (64-bit fingerprint of the word sequence), sig (16 bits of each MinHash value), bits (the lowest bit of the first 64).

    A task gives the signature of a word sequence once among the last ``remember`` different ones; further copies carry null.
    """
    a, b = S.permutations(perms)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = S.WordIds(), set()
        for batch in parts:
            keys, fps, at_row, flat, starts, at = [], [], [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = S.words(text)
                if len(found) < max(min_words, width):
                    continue
                fp = xxhash.xxh64_intdigest("\0".join(found)) - 2**63
                if fp not in seen:
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(fp)
                    h = S.shingle_hashes(np.fromiter((ids[w] for w in found), np.uint64, len(found)), width)
                    flat.append(h)
                    starts.append(at)
                    at_row.append(len(keys))
                    at += len(h)
                keys.append(key)
                fps.append(fp)
            if keys:
                sigs: list = [None] * len(keys)
                bits: list = [None] * len(keys)
                if flat:
                    low = S.minhash(np.concatenate(flat), np.array(starts), a, b).astype(np.uint16)
                    packed = np.packbits((low[:, :64] & 1).astype(np.uint8), axis=1)
                    packed = np.pad(packed, ((0, 0), (0, 8 - packed.shape[1]))).copy().view(np.int64).ravel()
                    for row, x, y in zip(at_row, low, packed.tolist()):
                        sigs[row], bits[row] = x.tobytes(), y
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.int64())], names=["id", "fp", "sig", "bits"])

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return src.mapInArrow(run, "id string, fp long, sig binary, bits long")


def banded(sig: DataFrame, rows: int) -> DataFrame:
    """(key, v): one key for each band of ``rows`` signature values, v = fp; partitioned by key."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = S.band_keys(values, rows)
                fps = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(fps)], names=["key", "v"])

    return sig.where("sig is not null").select("fp", "sig").mapInArrow(run, "key long, v long").repartition("key")


def bucket_pairs(rows: DataFrame, bucket: int) -> DataFrame:
    """Distinct pairs (a < b) of ``v`` that share a ``key``; (key, v) partitioned by key, rows may repeat."""
    # most buckets hold one row: these go first, in the partitions that are there and without sorting; then repeats go and the rest is counted
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    some = materialize(rows.join(shared.hint("shuffle_hash"), "key", "left_semi").distinct(), "buckets")
    sized = some.join(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    small = sized.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("v").alias("vs"))
    pairs_in = lambda xs, ys: F.explode(F.flatten(F.transform(xs, lambda x: F.transform(F.filter(ys, lambda y: y != x), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))))
    one = small.select(F.explode(F.flatten(F.transform("vs", lambda x: F.transform(F.filter("vs", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    hot = (
        sized.where(F.col("n") > bucket)
        .withColumn("own", F.pmod(F.xxhash64("v"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(F.when(F.col("own") == F.least("own", "other"), F.col("v"))).alias("xs"), F.collect_list(F.when(F.col("own") == F.greatest("own", "other"), F.col("v"))).alias("ys"))
        .select(pairs_in(F.col("xs"), F.col("ys")).alias("p"))
    )
    return one.unionByName(hot).select("p.a", "p.b").distinct()


def bayes_keep(a: Column, b: Column, threshold: float, perms: int, step: int, miss: float) -> Column:
    """True while no batch of signature values rules out that the pair reaches ``threshold``."""
    stops = min_matches(threshold, perms, step, miss)

    @F.pandas_udf("boolean")
    def keep(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        p = np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)
        q = np.frombuffer(b"".join(y), np.uint16).reshape(len(y), -1)
        alive, equal, done = np.arange(len(x)), np.zeros(len(x), np.int32), 0
        for n, least in stops:
            equal[alive] += (p[alive, done:n] == q[alive, done:n]).sum(1, dtype=np.int32)
            alive, done = alive[equal[alive] >= least], n
            if not len(alive):
                break
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pd.Series(out)

    return keep(a, b)


def exact_jaccard(pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Keep rows (a, b, text_a, text_b) whose exact shingle similarity reaches ``threshold``; gives a, b, similarity."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sets: dict[tuple[str, str], frozenset] = {}

            def shingles(key: str, text: str) -> frozenset:
                if (key, text) not in sets:
                    w = S.words(text)
                    sets[key, text] = frozenset(zip(*(w[k:] for k in range(width))))
                return sets[key, text]

            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for i in range(len(a)):
                x, y = shingles(a[i], ta[i]), shingles(b[i], tb[i])
                common = len(x & y)
                if common >= threshold * (len(x) + len(y) - common):
                    out.append((a[i], b[i], common / (len(x) + len(y) - common)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string, similarity double")


def similar_pairs(
    df: DataFrame, id_col: str, text_col: str, *, width: int = 5, threshold: float = 0.8, min_words: int = 0, perms: int = 112, rows: int = 4, step: int = 16, miss: float = 0.001, bucket: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep) and (links: a, b, similarity) between representatives of different word sequences.

    Every id belongs to the representative of its exact word sequence; links join representatives only.
    """
    sig = materialize(signatures(df, id_col, text_col, width, perms, min_words), "signatures")
    reps = sig.groupBy("fp").agg(F.first("sig", ignorenulls=True).alias("sig"), F.min("id").alias("rep"))
    members = sig.select("id", "fp").distinct().join(sig.groupBy("fp").agg(F.min("id").alias("rep")), "fp").select("id", "rep")
    part = miss / (perms // step + 1)
    # the first batch is one bit each of 64 values: 8 bytes a text settle most chance candidates before signatures travel
    ones = sig.where("bits is not null").groupBy("fp").agg(F.first("bits").alias("bits"))
    candidates = (
        bucket_pairs(banded(sig, rows), bucket)
        .join(ones.select(F.col("fp").alias("a"), F.col("bits").alias("x")), "a")
        .join(ones.select(F.col("fp").alias("b"), F.col("bits").alias("y")), "b")
        .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most_differing(threshold, min(64, perms), part))
        .select("a", "b")
    )
    pruned = (
        candidates.join(reps.select(F.col("fp").alias("a"), F.col("sig").alias("sig_a"), F.col("rep").alias("rep_a")), "a")
        .join(reps.select(F.col("fp").alias("b"), F.col("sig").alias("sig_b"), F.col("rep").alias("rep_b")), "b")
        .where(bayes_keep(F.col("sig_a"), F.col("sig_b"), threshold, perms, step, part))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    survivors = materialize(pruned, "survivors")
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    named = survivors.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = exact_jaccard(named, width, threshold).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame, block: int = 1000) -> DataFrame:
    """All linked pairs of different ids (a < b): copies of one text and the members of linked representatives.

    Representatives with many copies are cut into blocks of about ``block`` ids, and pairs of blocks are joined, so no representative is one task.
    """
    counts = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / block).cast("int")
    blocked = members.join(counts, "rep").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    blocked = materialize(blocked.select("id", "rep", "part", "parts"), "members")
    grids = counts.select("rep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    side = lambda rep, part, name: blocked.select(F.col("rep").alias(rep), F.col("part").alias(part), F.col("id").alias(name))
    each = lambda rep, part: grids.select(F.col("rep").alias(rep), F.col("part").alias(part))
    across = links.select("a", "b").join(each("a", "p"), "a").join(each("b", "q"), "b").join(side("a", "p", "x"), ["a", "p"]).join(side("b", "q", "y"), ["b", "q"])
    many = counts.where("n > 1").select("rep", parts.alias("parts"))
    pairs = many.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "parts").select("a", "b", "p", F.explode(F.sequence(F.col("p"), F.col("parts") - 1)).alias("q"))
    within = pairs.join(side("a", "p", "x"), ["a", "p"]).join(side("b", "q", "y"), ["b", "q"]).where("p <> q or x < y")
    both = across.select("x", "y").unionByName(within.select("x", "y"))
    return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
