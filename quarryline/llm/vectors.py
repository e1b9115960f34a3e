"""k most similar vectors by an inverted file.

Centroids are fitted on a bounded hash sample (``sample`` rows a
model at most); every usable vector is indexed. The lists grow with the vectors: above ``most_lists`` of them a list is a coarse centroid and a fine one, fitted on what the coarse
ones leave over, so that ``most_lists`` coarse and as many fine centroids address up to ``most_lists`` squared lists. The more lists, the more often near vectors have different ones, so from ``many_lists`` lists on
it is the lists that grow, up to ``most_rows`` vectors. A vector is posted under its nearest centroid and all that are not more than a margin further away, with the vector; the margin is set on the sample so that there are ``probes`` on average
(one between centroids gets up to four times as many, one amid its list few); the vectors at home under a centroid are the queries of that cell. A cell multiplies its queries by its postings,
keeps the ``rerank`` best per query and reranks these by the exact cosine. Postings carry the vector, so neither needs a join, and a product of short vectors costs less than look-ups of residual codes,
which this had before. Cells expected above ``block`` rows are cut
into a grid of query and posting blocks. Exact copies of a vector are folded before indexing and
unfolded after it with at most k + 1 copies per neighbour, so a flood of copies stays linear.

Defined results: null, empty, all-zero, non-finite vectors and those whose length differs from the
model's usual one are left out; null ids or models too; a repeated id counts once (the first vector in array order); equal cosines rank
by id; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.session import materialize


def usable_vectors(df: DataFrame, id_col: str, group_col: str, vec_col: str) -> DataFrame:
    """(vec_id, model, vec) of vectors of the model's usual length with a finite, positive norm."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).cast("string").alias("model"), F.col(vec_col).cast("array<float>").alias("vec")).where("vec_id is not null and model is not null and size(vec) > 0")
    usual = v.groupBy("model", F.size("vec").alias("dim")).count().groupBy("model").agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return v.join(F.broadcast(usual), "model").where((F.size("vec") == F.col("dim")) & (norm > 0) & (norm < float("inf"))).select("vec_id", "model", "vec")


#: Numbers in one matrix of scores, about.
CELLS = 2_000_000
#: A vector is posted under this many times the average number of lists at most.
MOST = 4


def _parts(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Rows of ``x`` in parts of which ``width`` numbers a row make about ``CELLS``."""
    return np.array_split(x, max(1, -(-len(x) * width // CELLS)))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = x @ c.T
    s -= 0.5 * (c * c).sum(1)
    return s.argmax(1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; empty centroids restart at random points."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(p, c) for p in _parts(x, len(c))])
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        c[full] = sums / n[full, None]
        c[n == 0] = x[rng.integers(0, len(x), (n == 0).sum())]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of each row, greatest first."""
    k = min(k, s.shape[1])
    if k == 1:
        return s.argmax(1)[:, None]
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def _top(s: np.ndarray, k: int, fold: int = 16) -> np.ndarray:
    """Places of the ``k`` greatest of each row in any order; these are in the ``k`` groups of ``fold`` places with the greatest maxima."""
    n, k = s.shape[1], min(k, s.shape[1])
    if n < 2 * fold * k:
        return np.argpartition(-s, k - 1, axis=1)[:, :k]
    many = n // fold
    first = np.argpartition(-s[:, : fold * many].reshape(len(s), fold, many).max(1), k - 1, axis=1)[:, :k]
    at = (first[:, None, :] + np.arange(fold)[:, None] * many).reshape(len(s), -1)
    at = np.concatenate([at, np.broadcast_to(np.arange(fold * many, n), (len(s), n - fold * many))], axis=1)
    best = np.argpartition(-np.take_along_axis(s, at, 1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(at, best, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantizer:
    """Coarse and fine centroids (a list is one of each) of one model; ``width`` is without effect."""

    #: How much further than its nearest list (half the squared distance) another may be for a vector to be posted there.
    margin = np.inf

    def __init__(self, x: np.ndarray, lists: int, most_lists: int, width: int, rounds: int, seed: int) -> None:
        self.coarse = _kmeans(x, min(lists, most_lists, len(x)), rounds, seed, unit=True)
        left = x - self.coarse[np.concatenate([(p @ self.coarse.T).argmax(1) for p in _parts(x, len(self.coarse))])]
        fine = min(-(-lists // len(self.coarse)), most_lists, len(x)) if lists > most_lists else 1
        self.fine = _kmeans(left, fine, rounds, seed + 1, unit=False) if fine > 1 else np.zeros((1, x.shape[1]), np.float32)
        self.lists = len(self.coarse) * len(self.fine)

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest lists of each row, nearest first."""
        return self.ranked(x, probes)[0]

    def ranked(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` nearest lists of each row, nearest first, and half their squared distances (up to a constant with one level of lists)."""
        out, far, many = [], [], len(self.fine)
        if many == 1:
            for part in _parts(x, len(self.coarse)):
                s = part @ self.coarse.T
                out.append(_best(s, probes))
                far.append(-np.take_along_axis(s, out[-1], 1))
            return np.concatenate(out), np.concatenate(far)
        for part in _parts(x, max(len(self.coarse), probes * max(many, x.shape[1]))):
            c = _best(part @ self.coarse.T, probes)  # rows x coarse
            left = part[:, None, :] - self.coarse[c]
            # of equal rows the distance is that of left to the fine centroid, whatever the coarse one
            score = 2 * left @ self.fine.T - (self.fine * self.fine).sum(1) - (left * left).sum(2, keepdims=True)
            score = score.reshape(len(part), -1)
            top = _best(score, probes)
            out.append(np.take_along_axis(c, top // many, 1) * many + top % many)
            far.append(-0.5 * np.take_along_axis(score, top, 1))
        return np.concatenate(out), np.concatenate(far)

    def posted(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each row, nearest first, and which of them the row is posted under."""
        lists, far = self.ranked(x, MOST * probes)
        return lists, far <= far[:, :1] + self.margin

    def set_margin(self, x: np.ndarray, probes: int) -> None:
        """The margin at which the rows of ``x`` are posted under ``probes`` lists on average."""
        _, far = self.ranked(x, MOST * probes)
        over, k = (far[:, 1:] - far[:, :1]).ravel(), (probes - 1) * len(x)
        self.margin = float(np.partition(over, k)[k]) if k < len(over) else np.inf


def _grid(z: Quantizer, n: int, sample: np.ndarray, block: int, probes: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Query and posting blocks of each list, from the sample's shares; lists that the sample hardly meets are whole."""
    lists, posted = z.posted(sample, probes)
    scale = n / len(sample)

    def blocks(a: np.ndarray) -> np.ndarray:
        count = np.bincount(a, minlength=z.lists)
        few = (count < least) & (len(z.fine) > 1)
        return np.clip(np.ceil(np.where(few, 0, count * scale) / block), 1, 4095).astype(np.int64)

    return blocks(lists[:, 0]), blocks(lists[posted])


def list_count(n: int, list_rows: int, many_lists: int, most_rows: int, most_lists: int) -> int:
    """Lists for ``n`` vectors: of ``list_rows`` up to ``many_lists`` lists, then these grow to ``most_rows``, then there are more again."""
    return max(1, min(most_lists * most_lists, round(n / list_rows), max(many_lists, round(n / most_rows))))


def fit(vectors: DataFrame, list_rows: int, many_lists: int, most_rows: int, most_lists: int, sample: int, width: int, rounds: int, seed: int, block: int, probes: int) -> tuple[dict[str, Quantizer], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Quantizer and block grid of each model, from ``min(sample, 128 rows a list)`` hashed rows a model."""
    sizes = {r["model"]: r["count"] for r in vectors.groupBy("model").count().collect()}  # one row a model
    out, grid = {}, {}
    for k, (model, n) in enumerate(sorted(sizes.items())):
        lists = list_count(n, list_rows, many_lists, most_rows, most_lists)
        want = min(n, sample, max(128 * min(lists, most_lists), 2048))
        part = vectors.where(F.col("model") == model)
        if want < n:
            part = part.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20)) < int(want / n * (1 << 20)))
        rows = part.select("vec_id", "vec").toArrow().sort_by("vec_id")
        if rows.num_rows == 0:  # a sample of very few rows may come out empty
            rows = vectors.where(F.col("model") == model).select("vec_id", "vec").limit(want).toArrow()
        flat = rows.column("vec").combine_chunks()
        x = _unit(np.asarray(flat.flatten(), np.float32).reshape(rows.num_rows, -1))
        # vectors that centroids are fitted on are nearer to them than others, so every eighth is kept for the margin
        kept = np.arange(len(x)) % 8 == 7 if len(x) >= 8 * 256 else np.zeros(len(x), bool)
        out[model] = Quantizer(x[~kept], lists, most_lists, width, rounds, seed + k)
        out[model].set_margin(x[kept] if kept.any() else x, probes)
        grid[model] = _grid(out[model], n, x, block, probes)
    return out, grid


def _postings(vectors: DataFrame, quantizers: dict[str, Quantizer], grid: dict[str, tuple[np.ndarray, np.ndarray]], probes: int) -> DataFrame:
    """A row for each vector, list probed and block: cell, whether it is at home there (a query) and its vector."""
    names = sorted(quantizers)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            model = np.array(batch.column(1).to_pylist(), object)
            for k, name in enumerate(names):
                rows = np.flatnonzero(model == name)
                if not len(rows):
                    continue
                z = quantizers[name]
                part = batch.take(pa.array(rows))
                raw = np.asarray(part.column(2).flatten(), np.float32).reshape(len(rows), -1)
                x = _unit(raw)
                ids = part.column(0).to_numpy()
                lists, posted = z.posted(x, probes)
                qs, cs = grid[name]
                mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                who, cell, kind = [], [], []
                for p in range(lists.shape[1]):
                    on = np.flatnonzero(posted[:, p])
                    if not len(on):
                        break
                    at = lists[on, p]
                    for is_query, own, other in ((True, qs, cs), (False, cs, qs)):
                        if is_query and p:
                            continue
                        mine = (mix[on] % own[at].astype(np.uint64)).astype(np.int64)
                        for o in range(int(other[at].max())):
                            sel = np.flatnonzero(other[at] > o)
                            qb, cb = (mine[sel], o) if is_query else (o, mine[sel])
                            who.append(on[sel])
                            cell.append(((at[sel].astype(np.int64) * 4096 + qb) * 4096 + cb) * len(names) + k)
                            kind.append(np.full(len(sel), 1 if is_query else 2, np.int8))
                who, cell, kind = (np.concatenate(v) for v in (who, cell, kind))
                # a vector that is query and posting of one cell travels once (kind 3)
                order = np.lexsort((kind, cell, who))
                who, cell, kind = who[order], cell[order], kind[order]
                twin = np.flatnonzero((who[1:] == who[:-1]) & (cell[1:] == cell[:-1]))
                kind[twin] = 3
                left = np.delete(np.arange(len(who)), twin + 1)
                who, cell, kind = who[left], cell[left], kind[left]
                size = raw.shape[1] * 4
                vecs = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(np.arange(0, (len(who) + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw[who]))])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[who]), pa.array(kind), vecs], names=["cell", "vec_id", "kind", "vec"])

    return vectors.select("vec_id", "model", "vec").mapInArrow(run, "cell long, vec_id long, kind byte, vec binary")


def nearest(
    df: DataFrame,
    id_col: str,
    group_col: str,
    vec_col: str,
    *,
    k: int = 5,
    floor: float = -1.0,
    list_rows: int = 400,
    many_lists: int = 2048,
    most_rows: int = 4096,
    most_lists: int = 4096,
    sample: int = 65_536,
    probes: int = 5,
    rerank: int = 96,
    block: int = 32_768,
    width: int = 8,
    rounds: int = 8,
    seed: int = 11,
) -> DataFrame:
    """(model, query_id, vec_id, cosine, hit_rank): up to ``k`` most similar other vectors with a cosine of at least ``floor``."""
    usable = usable_vectors(df, id_col, group_col, vec_col)
    prints = usable.groupBy("vec_id", "model").agg(F.min(F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g"))).alias("p"))
    groups = prints.groupBy("model", "p").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that its size is known: where copies are few, taking them out moves no vectors
    copies = materialize(prints.join(groups.select("model", "p", "rep"), ["model", "p"]).select("model", "rep", "vec_id"), "copies")
    single = usable.join(copies.where("vec_id <> rep"), ["model", "vec_id"], "left_anti")
    quantizers, grid = fit(single, list_rows, many_lists, most_rows, most_lists, sample, width, rounds, seed, block, probes)
    names = sorted(quantizers)

    def cell_hits(key: tuple, rows: pa.Table) -> pa.Table:
        ids, kind = (rows.column(c).to_numpy() for c in ("vec_id", "kind"))
        raw = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float32).reshape(len(ids), -1)
        del rows
        # a row delivered twice under one id stays one posting
        order = np.argsort(ids, kind="stable")
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(order) else order
        ids, kind, raw = ids[order], kind[order], raw[order]
        queries, posts = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
        found: list[list[np.ndarray]] = [[], [], []]
        norm = np.sqrt(np.einsum("rd,rd->r", raw, raw, dtype=np.float64))[:, None]
        unit = lambda at: raw[at].astype(np.float64) / norm[at]
        ahead = (raw[posts] / norm[posts]).astype(np.float32)
        parts = max(1, len(queries) // 128, -(-len(queries) * len(posts) // CELLS))
        for some in np.array_split(queries, parts) if len(posts) else []:
            if not len(some):
                continue
            own = unit(some)
            s = own.astype(np.float32) @ ahead.T
            self_ = np.minimum(np.searchsorted(posts, some), len(posts) - 1)
            is_post = posts[self_] == some
            s[np.flatnonzero(is_post), self_[is_post]] = -np.inf
            best = _top(s, rerank)  # queries x rerank
            cos = np.einsum("qrd,qd->qr", unit(posts[best]), own)
            cos[ids[posts[best]] == ids[some][:, None]] = -np.inf
            rank = np.lexsort((ids[posts[best]], -cos), axis=1)[:, :k]
            top, val = np.take_along_axis(best, rank, 1), np.take_along_axis(cos, rank, 1)
            good = (val >= floor) & np.isfinite(val)
            for to, x in zip(found, (np.broadcast_to(ids[some][:, None], good.shape)[good], ids[posts[top]][good], val[good])):
                to.append(x)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
        n = sum(map(len, found[0]))
        return pa.table({"model": pa.array([names[key[0].as_py() % len(names)]] * n, pa.string()), "query_id": cat(found[0], pa.int64()), "vec_id": cat(found[1], pa.int64()), "cosine": cat(found[2], pa.float64())})

    schema = "model string, query_id long, vec_id long, cosine double"
    if not quantizers:
        hits = usable.sparkSession.createDataFrame([], schema)
    else:
        hits = _postings(single, quantizers, grid, probes).groupBy("cell").applyInArrow(cell_hits, schema)
    # copies: a neighbour stands for its first k + 1 copies, a query for all of its own
    first = copies.withColumn("r", F.row_number().over(W.partitionBy("model", "rep").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    own = copies.select("model", "rep", F.col("vec_id").alias("query_id")).join(first, ["model", "rep"]).where("query_id <> vec_id").select("model", "query_id", "vec_id", F.lit(1.0).alias("cosine"))
    wide = hits.join(first.withColumnRenamed("vec_id", "copy").withColumnRenamed("rep", "vec_id"), ["model", "vec_id"], "left").select("model", "query_id", F.coalesce("copy", "vec_id").alias("vec_id"), "cosine")
    wide = wide.join(copies.select("model", F.col("rep").alias("query_id"), F.col("vec_id").alias("copy")), ["model", "query_id"], "left").select("model", F.coalesce("copy", "query_id").alias("query_id"), "vec_id", "cosine")
    ranked = W.partitionBy("model", "query_id").orderBy(F.desc("cosine"), "vec_id")
    return wide.unionByName(own).withColumn("hit_rank", F.row_number().over(ranked)).where(F.col("hit_rank") <= k)
