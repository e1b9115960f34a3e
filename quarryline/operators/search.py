"""Retrieval over whole tables: dense and BM25 top-k for sets of queries, rank fusion, reranking, tenancy guards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as X
from quarryline.session import materialize


def _blocks(df: DataFrame, group: str, rows: int, salt: str) -> DataFrame:
    """Vectors packed into blocks of about ``rows``: (group, block, ids, vecs as one flat array)."""
    sizes = df.groupBy(group).agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(1)).alias("parts"))
    return (
        df.join(F.broadcast(sizes), group)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "id"), F.col("parts")))
        .groupBy(group, "block")
        .agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
        .select(group, "block", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias("vecs"))
    )


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, query_block: int = 256, vector_block: int = 2048, digits: int | None = None) -> DataFrame:
    """(group, query_id, id, score, rank): the ``k`` vectors of the query's group with the greatest cosine, exact (rounded to ``digits`` before ranking).

    Both sides are (group, id, vec) with vectors of one length a group and positive norm. Each block of queries goes to every block of vectors of its group, a matrix product a pair;
    blocks of vectors do not move but for the one shuffle by (group, block). Each pair keeps k a query, and a window keeps k of these. A query is not its own hit. Equal scores rank by id.
    """
    q = _blocks(queries, "group", query_block, "q").select("group", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    v = _blocks(vectors, "group", vector_block, "v")
    goals = vectors.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(vector_block)), F.lit(1)).alias("parts"))
    types = [queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()]
    own = lambda x: x.values.to_numpy(zero_copy_only=False)
    text = types[1] == "string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for r in range(batch.num_rows):
                group, q_ids, q_vecs, ids, vecs = (batch.column(c)[r] for c in range(5))
                qi, vi = own(q_ids), own(ids)
                order = vi.astype(str) if text else vi
                a = q_vecs.values.to_numpy().astype(np.float64).reshape(len(qi), -1)
                b = vecs.values.to_numpy().astype(np.float64).reshape(len(vi), -1)
                s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
                s = s if digits is None else np.round(s, digits)
                if types[0] == types[1]:
                    s[qi[:, None] == vi[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(order, s.shape), -s), axis=1)[:, :k]
                val = np.take_along_axis(s, top, 1)
                ok = np.isfinite(val)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group.as_py()] * int(ok.sum()), pa.string()), pa.array(np.repeat(qi, ok.sum(1))), pa.array(vi[top][ok]), pa.array(val[ok])], names=["group", "query_id", "id", "score"]
                )

    sent = q.join(goals, "group").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hits = sent.join(v, ["group", "block"]).select("group", "q_ids", "q_vecs", "ids", "vecs").mapInArrow(run, f"group string, query_id {types[0]}, id {types[1]}, score double")
    ranked = W.partitionBy("group", "query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row for up to ``size`` successive rows, each column a list; nothing is moved."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, size):
                batch = pa.concat_batches([whole.slice(at, size)])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c) for c in batch.columns], names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema))


def bm25_best(questions: DataFrame, passages: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, most_terms: int = 20_000, question_block: int = 256, passage_block: int = 4096, most_blocks: int = 64) -> DataFrame:
    """(question_id, passage_id, score, rank): the ``k`` best of the passages that have a word of the question, by BM25 over lower-cased words. Equal scores rank by id.

    (question_id, text) against (passage_id, text). Where both have ``groups`` (arrays of strings), a question meets the passages that share one with it; corpus statistics cover all
    passages. A passage is taken into words once; its words are cut to those asked for (up to ``most_terms`` as a set in the plan, else all are kept) and written once.
    Blocks of questions go to every block of passages, ``most_blocks`` blocks at a time, and a pair keeps k a question, so that neither postings nor scores are shuffled.
    """
    grouped = "groups" in questions.columns and "groups" in passages.columns
    seen = [F.col("groups") if grouped else F.lit(None).cast("array<string>").alias("groups")]
    asked = materialize(questions.select("question_id", *seen, F.explode(F.array_distinct(X.words("text"))).alias("term")), "asked")
    few = [r["term"] for r in asked.select("term").distinct().limit(most_terms + 1).collect()]
    ws = F.filter("ws", lambda w: w.isin(few)) if len(few) <= most_terms else F.col("ws")
    rows = passages.select("passage_id", *seen, X.words("text").alias("ws")).select("passage_id", "groups", F.size("ws").alias("len"), ws.alias("ws"))
    rows = materialize(rows, "words")
    n, avgdl = rows.agg(F.count(F.lit(1)), F.avg("len")).first()
    df = rows.select(F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "term")
    ids = asked.select("question_id").distinct()
    parts = max(1, -(-ids.count() // question_block))
    known = known.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(parts)))
    own = F.struct("question_id", "term", "df", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))
    blocks = materialize(known.groupBy("block").agg(F.collect_list(own).alias("q")), "questions")
    types = [questions.schema["question_id"].dataType.simpleString(), passages.schema["passage_id"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p_ids, p_groups, lens, ws, q = (batch.column(c)[r].values for c in range(5))
                m = len(p_ids)
                q_ids, q_of = np.unique(q.field("question_id").to_numpy(zero_copy_only=False), return_inverse=True)
                terms = pc.unique(q.field("term")).sort()
                t_of = pc.index_in(q.field("term"), value_set=terms).to_numpy(zero_copy_only=False)
                docs = np.zeros(len(terms))
                docs[t_of] = q.field("df").to_numpy(zero_copy_only=False)
                # postings by term
                word = pc.index_in(ws.flatten(), value_set=terms)
                at = np.repeat(np.arange(m), pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False))
                has = word.is_valid().to_numpy(zero_copy_only=False)
                keys, tf = np.unique(word.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * m + at[has], return_counts=True)
                t, row = keys // m, keys % m
                length = pc.fill_null(lens, 0).to_numpy(zero_copy_only=False).astype(np.float64)[row]
                weight = np.log(1 + (n - docs[t] + 0.5) / (docs[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (avgdl or 1)))
                edges = np.searchsorted(t, np.arange(len(terms) + 1))
                s = np.zeros((len(q_ids), m))
                for term, i in sorted(zip(t_of.tolist(), q_of.tolist())):
                    lo, hi = edges[term], edges[term + 1]
                    s[i, row[lo:hi]] += weight[lo:hi]
                s = np.where(s > 0, np.floor(s * 1e6 + 0.5) / 1e6, -np.inf)
                if grouped:
                    names = pc.unique(q.field("groups").flatten())
                    sees, open_ = np.zeros((len(q_ids), len(names))), np.zeros((m, len(names)))
                    q_many = pc.list_value_length(q.field("groups")).to_numpy(zero_copy_only=False)
                    sees[np.repeat(q_of, q_many), pc.index_in(q.field("groups").flatten(), value_set=names).to_numpy(zero_copy_only=False)] = 1
                    its = pc.index_in(p_groups.flatten(), value_set=names)
                    of = np.repeat(np.arange(m), pc.fill_null(pc.list_value_length(p_groups), 0).to_numpy(zero_copy_only=False))
                    open_[of[its.is_valid().to_numpy(zero_copy_only=False)], its.drop_null().to_numpy(zero_copy_only=False)] = 1
                    s[sees @ open_.T == 0] = -np.inf
                least = np.partition(s, m - k, axis=1)[:, m - k] if m > k else np.full(len(q_ids), -np.inf)
                i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                name = p_ids.to_numpy(zero_copy_only=False)
                order = np.lexsort((name[j].astype(str) if types[1] == "string" else name[j], -s[i, j], i))
                i, j = i[order], j[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[top], j[top]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i], q.field("question_id").type), p_ids.take(pa.array(j)), pa.array(s[i, j])], names=["question_id", "passage_id", "score"])

    packed = _packed(rows.select("passage_id", "groups", "len", "ws"), passage_block)
    hits = None
    for lo in range(0, parts, most_blocks):
        some = packed.crossJoin(F.broadcast(blocks.where(F.col("block").between(lo, lo + most_blocks - 1)).select("q")))
        some = some.mapInArrow(run, f"question_id {types[0]}, passage_id {types[1]}, score double")
        hits = some if hits is None else hits.unionByName(some)
    ranked = W.partitionBy("question_id").orderBy(F.desc("score"), "passage_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def bm25_topk(questions: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(question_id, passage_id, score, rank) of the ``k`` best passages by BM25."""
    return bm25_best(questions.select("question_id", "text"), passages, k)


def hashed_words(texts: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """(key, vec): signed counts of a text's words hashed to ``dim`` places; texts whose counts cancel out are left out. Keys come once; a text's words don't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for batch in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                words = batch.column(1).flatten().dictionary_encode()
                place = np.zeros(len(words.dictionary), np.int64)
                for i, w in enumerate(words.dictionary.to_pylist()):
                    if w not in known:
                        if len(known) >= 1_000_000:
                            known.clear()
                        h = hashlib.md5(w.encode()).hexdigest()
                        known[w] = int(h[:4], 16) % dim * 2 + (int(h[4], 16) >= 8)
                    place[i] = known[w]
                code = place[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
                vecs = np.bincount(of * dim + code // 2, np.where(code % 2, 1.0, -1.0), batch.num_rows * dim).reshape(-1, dim).astype(np.float32)
                kept = np.flatnonzero((vecs != 0).any(1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(kept) + 1) * dim, dim, dtype=np.int32)), pa.array(vecs[kept].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), flat], names=[key, "vec"])

    return texts.select(key, X.words("text").alias("ws")).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, vec array<float>")


def where(doc_id: object = None, source_file: str | None = None, doc_type: str | None = None, jurisdiction: str | None = None, document_scope: list[str] | None = None) -> Column:
    """A caller's filters on passages, all of which must hold; empty ones are ignored."""
    out = F.lit(True)
    for name, value in (("doc_id", doc_id), ("source_file", source_file), ("doc_type", doc_type), ("jurisdiction", jurisdiction)):
        if value:
            out = out & (F.col(name) == value)
    return out & F.col("source_file").isin(document_scope) if document_scope else out


def open_to(tenant: Column, visibility: Column, caller_tenant: Column) -> Column:
    """What a search filtered by tenant may return: own or global and not private; without a tenant only what is global and public."""
    t, v = F.coalesce(tenant, F.lit("global")), F.coalesce(visibility, F.lit("tenant"))
    return F.when(caller_tenant.isNull(), (t == "global") & (v == "public")).otherwise(((t == "global") | (t == caller_tenant)) & v.isin("tenant", "public"))


def hybrid(questions: DataFrame, passages: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """(question_id, passage_id, fused_score, n_lists, fused_rank) of the ``k`` best passages by the fused ranks of BM25 and hashed vectors.

    Questions are (question_id, text, tenant), passages (passage_id, text, tenant_id, visibility and what ``keep`` filters by). Tenancy and filters hold inside both legs, before
    their ``k`` best; BM25 statistics cover all passages. Vectors meet only within the groups a question may see: its tenant's and the global one, or what anybody sees.
    """
    open_ = F.coalesce("visibility", F.lit("tenant")).isin("tenant", "public")
    tenant, anybody = F.coalesce("tenant_id", F.lit("global")), F.lit("\0")  # no tenant's name
    groups = F.when((tenant == "global") & (F.coalesce("visibility", F.lit("tenant")) == "public"), F.array(F.lit("global"), anybody)).otherwise(F.array(tenant))
    p = passages.select("passage_id", "text", F.when(open_ if keep is None else open_ & keep, groups).alias("groups"))
    sees = F.when(F.col("tenant").isNull(), F.array(anybody)).otherwise(F.array_distinct(F.array("tenant", F.lit("global"))))
    q = questions.select("question_id", "text", sees.alias("groups"))
    sparse = bm25_best(q, p, k).select("question_id", "passage_id", "rank")
    kept = p.where("groups is not null")
    v = materialize(hashed_words(kept, "passage_id"), "vectors").join(kept.select("passage_id", "groups"), "passage_id").select(F.explode("groups").alias("group"), F.col("passage_id").alias("id"), "vec")
    a = hashed_words(q, "question_id").join(q.select("question_id", "groups"), "question_id").select(F.explode("groups").alias("group"), F.col("question_id").alias("id"), "vec")
    dense = dense_topk(a, v, k, digits=6).select(F.col("query_id").alias("question_id"), F.col("id").alias("passage_id"), "score")
    by = W.partitionBy("question_id").orderBy(F.desc("score"), "passage_id")
    legs = [sparse, dense.select("question_id", "passage_id", F.row_number().over(by).alias("rank")).where(F.col("rank") <= k)]
    return fuse(legs[0].unionByName(legs[1]), "question_id", "passage_id", "rank", k)


def rerank(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates (query_id, chunk_id, fused_rank) by rerank_score with new_rank; those without a score follow in fused order."""
    by = W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "fused_rank")
    return candidates.join(scores, ["query_id", "chunk_id"], "left").withColumn("new_rank", F.row_number().over(by)).where(F.col("new_rank") <= k)


def is_hit(file: Column, page_start: Column, page_end: Column, path: Column, gold_file: Column, gold_start: Column, gold_end: Column, section: Column) -> Column:
    """Whether a chunk answers a labelled question: its file, pages that meet (where labelled), the gold section in the lower-cased path (where labelled)."""
    pages = gold_start.isNull() | F.coalesce((page_start <= gold_end) & (page_end >= gold_start), F.lit(False))
    return F.coalesce((file == gold_file) & pages & (section.isNull() | F.contains(F.coalesce(path, F.lit("")), section)), F.lit(False))


def without(stored: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A store after the deletion of all rows with the given keys."""
    return stored.join(deleted.select(key).distinct(), key, "left_anti")


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A store after delete-then-upsert: all rows of the fresh keys are replaced."""
    return without(stored, fresh, key).unionByName(fresh)


def cached_answers(queries: DataFrame, history: DataFrame, least: float, life_us: int) -> DataFrame:
    """(id, tier, answered_by) for (id, at, k): an earlier row of ``history`` with the same text, else the most similar one (cosine of word sets) of at least ``least``, not older than ``life_us``.

    A row that reaches ``least`` has at least ``least * least`` of a query's words, so only the query's rarest words, as many as cannot all be missing, are looked up.
    """
    bag = lambda df: df.select("id", "at", "k", F.array_distinct(X.words("k")).alias("ws"))
    h, q = bag(history), bag(queries)
    held = h.select(F.col("id").alias("other"), F.explode("ws").alias("w"))
    asked = q.select("id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    counts = held.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.join(counts, "w").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("df", "w"))).where(F.col("r") <= F.col("n") - F.ceil(F.lit(least * least) * F.col("n")) + 1)
    pairs = rare.join(held, "w").where("id <> other").select("id", "other").distinct()
    o = h.select(F.col("id").alias("other"), F.col("at").alias("o_at"), F.col("k").alias("o_k"), F.col("ws").alias("o_ws"))
    met = pairs.join(q, "id").join(o, "other").where((F.struct("o_at", "other") < F.struct("at", "id")) & (F.unix_micros("at") - F.unix_micros("o_at") <= life_us))
    score = F.size(F.array_intersect("ws", "o_ws")) / F.sqrt(F.size("ws").cast("double") * F.size("o_ws"))
    met = met.withColumn("same", F.col("k") == F.col("o_k")).withColumn("s", score).where((F.col("s") >= least) | F.col("same"))
    best = W.partitionBy("id").orderBy(F.desc("same"), F.desc(F.round("s", 6)), "o_at", "other")
    met = met.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "same", "other")
    tier = F.when(F.col("same"), "exact").when(F.col("other").isNotNull(), "semantic").otherwise("miss")
    return queries.select("id").join(met, "id", "left").select("id", tier.alias("tier"), F.col("other").alias("answered_by"))


def fuse(ranked: DataFrame, query: str, item: str, rank: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (rows of several lists in one frame): the ``k`` best items of each query."""
    fused = ranked.groupBy(query, item).agg(F.round(F.sum(1 / (F.lit(constant) + F.col(rank))), 12).alias("fused_score"), F.count(F.lit(1)).alias("n_lists"))
    by = W.partitionBy(query).orderBy(F.desc("fused_score"), item)
    return fused.withColumn("fused_rank", F.row_number().over(by)).where(F.col("fused_rank") <= k)


def visible(tenant: Column, visibility: Column, owner: Column, caller_tenant: Column | None, caller: Column | None, admin: Column | None = None) -> Column:
    """Whether a caller sees a row: own or global tenant, and not private unless owned; without a caller only public rows of the global tenant."""
    t, v = F.coalesce(tenant, F.lit("global")), F.coalesce(visibility, F.lit("tenant"))
    if caller_tenant is None:
        return (t == "global") & (v == "public")
    inside = (t == "global") | (t == caller_tenant)
    open_ = v.isin("tenant", "public") | F.coalesce(owner == caller, F.lit(False))
    seen = F.when(caller_tenant.isNull(), (t == "global") & (v == "public")).otherwise(inside & open_)
    return seen if admin is None else F.coalesce(admin, F.lit(False)) | seen


def decide(action: str, tenant: Column, visibility: Column, owner: Column, caller_tenant: Column, caller: Column) -> Column:
    """allow, or the reason of a refusal, for a caller without administrator rights."""
    t = F.coalesce(tenant, F.lit("global"))
    own = F.coalesce(owner == caller, F.lit(False))
    foreign = (t != "global") & (t != caller_tenant)
    hidden = (visibility == "private") & ~own
    if action == "read":
        return F.when(foreign, "other_tenant").when(hidden, "private").otherwise("allow")
    return F.when(foreign, "other_tenant").when(hidden, "private").when((t == "global") & (visibility == "public"), "read_only").when(own | (visibility != "private"), "allow").otherwise("private")


def authorize(action: str, tenant: Column, visibility: Column, owner: Column, caller_tenant: Column, caller: Column, admin: Column) -> Column:
    """allow, or why a caller may not read, modify or delete a document: what is global and public can be read by all and changed by administrators, other tenants' documents by administrators
    alone; a private document is read and any owned document changed by its owner or an administrator. A caller without tenant belongs to the global one."""
    t, v, c = F.coalesce(tenant, F.lit("global")), F.coalesce(visibility, F.lit("tenant")), F.coalesce(caller_tenant, F.lit("global"))
    power, other = F.coalesce(admin, F.lit(False)), owner.isNotNull() & ~F.coalesce(owner == caller, F.lit(False))
    common = (t == "global") & (v == "public")
    barred = other & (v == "private") if action == "read" else other
    open_ = common if action == "read" else common & power
    return F.when(open_, "allow").when(common, "read_only").when(~power & (t != c), "other_tenant").when(~power & barred, "not_owner").otherwise("allow")


#: Columns a registry may be sorted by; others give the first.
SORTS = ("updated_at", "title", "source_file", "doc_type", "jurisdiction", "indexed_at", "status")


def registry(docs: DataFrame, text: str | None = None, tenant: str | None = None, caller: str | None = None, sort: str = "updated_at", descending: object = True, limit: int = 20, offset: int = 0, **equal: str | None) -> DataFrame:
    """A page of a registry: title or file contains a text (in small or capital letters), columns equal given values (empty ones are ignored), and what a tenant's caller may list.

    A sort column that is not listed falls back to updated_at, a direction that is neither 'asc' nor False to descending; equal rows come by doc_id.
    """
    keep = F.lit(True)
    if text:
        keep = keep & (F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("source_file"), F.lit(text.lower())))
    for name in ("doc_type", "jurisdiction", "status"):
        if equal.get(name):
            keep = keep & (F.col(name) == equal[name])
    if tenant:
        own = F.coalesce("tenant_id", F.lit("global")).isin(tenant, "global")
        keep = keep & own & (F.coalesce("visibility", F.lit("tenant")).isin("tenant", "public") | F.coalesce(F.col("owner_id") == (caller or ""), F.lit(False)))
    by = F.col(sort if sort in SORTS else SORTS[0])
    up = descending in ("asc", False)
    return docs.where(keep).orderBy(by.asc_nulls_last() if up else by.desc_nulls_last(), "doc_id").offset(offset).limit(limit)
