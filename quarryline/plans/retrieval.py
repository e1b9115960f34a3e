"""Queries on hits, vectors and questions: top-k, fusion, reranking, tenancy, citations, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import maths as M
from quarryline.functions import text as X
from quarryline.operators import aggregates, joins, search
from quarryline.plans.base import query
from quarryline.plans.corpus import DISTINCT_CHUNKS, distinct_chunks
from quarryline.session import table

#: Hits as last loaded, one row per query and chunk.
HITS = "(select * from retrieved_chunks qualify row_number() over (partition by query_id, chunk_id order by loaded_at desc nulls last, hit_rank nulls last, dense_score desc nulls last) = 1)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("query_id", "chunk_id").orderBy(F.desc_nulls_last("loaded_at"), F.asc_nulls_last("hit_rank"), F.desc_nulls_last("dense_score"))
    return table(spark, d, "retrieved_chunks").withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


DIM = "case model when 'hash-64' then 64 when 'mini-96' then 96 end"
USABLE = f"(select vec_id, model, vec from emb where len(vec) = {DIM} and list_sum(list_transform(vec, lambda x: abs(x))) > 0)"


@query(
    f"""with v as (select vec_id, model, list_transform(vec, lambda x: x::double) as vec from {USABLE}), q as (select * from v where vec_id % 100 = 0),
s as (select q.model, q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.vec, v.vec) as score from q join v on q.model = v.model and q.vec_id <> v.vec_id)
select model, query_id, vec_id, round(score, 6) as score, row_number() over (partition by model, query_id order by score desc, vec_id) as hit_rank from s
qualify row_number() over (partition by model, query_id order by score desc, vec_id) <= 10"""
)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "emb").select(F.col("model").alias("group"), F.col("vec_id").alias("id"), "vec")
    v = v.where(F.expr("size(vec) = case `group` when 'hash-64' then 64 when 'mini-96' then 96 end and exists(vec, x -> x <> 0)"))
    top = search.dense_topk(v.where("id % 100 = 0"), v, 10)
    return top.select(F.col("group").alias("model"), "query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("hit_rank"))


@query(
    f"""with p as (select chunk_id as passage_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws from {DISTINCT_CHUNKS}),
sz as (select passage_id, len(ws) as len from p), al as (select count(*) as n, avg(len) as avgdl from sz),
tf as (select passage_id, term, count(*) as tf from (select passage_id, unnest(ws) as term from p) group by 1, 2),
a as (select distinct id as question_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) as term from escalations where id % 100 = 0),
dfs as (select term, count(*) as df from tf where term in (select term from a) group by 1),
s as (select question_id, passage_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) as score from a join tf using (term) join dfs using (term) join sz using (passage_id), al group by 1, 2)
select question_id, passage_id, score, row_number() over (partition by question_id order by score desc, passage_id) as hit_rank from s qualify row_number() over (partition by question_id order by score desc, passage_id) <= 20"""
)
def bm25_topk(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """Twenty best chunks by BM25 for the escalated questions whose id is divisible by ``every``, against all chunks."""
    q = table(spark, d, "escalations").where(F.col("id") % every == 0).select(F.col("id").alias("question_id"), F.col("question").alias("text"))
    p = distinct_chunks(spark, d).select(F.col("chunk_id").alias("passage_id"), "text")
    return search.bm25_topk(q, p, 20).withColumn("hit_rank", F.col("rank").cast("long")).drop("rank")


@query(
    f"""with h as {HITS}, r as (
select query_id, chunk_id, row_number() over (partition by query_id order by dense_score desc, chunk_id) as rank from h where dense_score is not null
union all select query_id, chunk_id, row_number() over (partition by query_id order by sparse_score desc, chunk_id) from h where sparse_score is not null),
f as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) as fused_score, count(*) as n_lists from r group by 1, 2)
select *, row_number() over (partition by query_id order by fused_score desc, chunk_id) as fused_rank from f qualify row_number() over (partition by query_id order by fused_score desc, chunk_id) <= 20"""
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse rankings of every query fused by reciprocal ranks."""
    rank = lambda s: F.when(F.col(s).isNotNull(), F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last(s), "chunk_id")))
    legs = hits(spark, d).select("query_id", "chunk_id", F.array(rank("dense_score"), rank("sparse_score")).alias("ranks"))  # both windows share one shuffle
    ranked = legs.select("query_id", "chunk_id", F.explode("ranks").alias("rank")).where("rank is not null")
    return search.fuse(ranked, "query_id", "chunk_id", "rank", 20).withColumn("fused_rank", F.col("fused_rank").cast("long"))


@query(f"select query_id, chunk_id, rerank_score, row_number() over (partition by query_id order by rerank_score desc, hit_rank nulls last, chunk_id) as new_rank from {HITS} where rerank_score is not null qualify new_rank <= 5")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc_nulls_last("hit_rank"), "chunk_id")
    return hits(spark, d).where("rerank_score is not null").select("query_id", "chunk_id", "rerank_score", F.row_number().over(by).cast("long").alias("new_rank")).where("new_rank <= 5")


@query(
    f"""with r as (select query_id, dense_score >= 0.9 as relevant, row_number() over (partition by query_id order by fused_score desc nulls last, chunk_id) as rank from {HITS}),
f as (select query_id, min(case when relevant then rank end) as first from r group by 1)
select count(*) as n, round(avg(case when first <= 5 then 1.0 else 0.0 end), 4) as hit_at_k, round(avg(coalesce(1.0 / first, 0.0)), 4) as mrr from f"""
)
def hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    """hit@5 and mean reciprocal rank of the fused order; a hit is relevant at a cosine of 0.9."""
    by = W.partitionBy("query_id").orderBy(F.desc_nulls_last("fused_score"), "chunk_id")
    r = hits(spark, d).select("query_id", (F.col("dense_score") >= 0.9).alias("relevant"), F.row_number().over(by).alias("rank"))
    return aggregates.ranking_quality(r, "query_id", "rank", "relevant", 5)


GUARDED = f"""with c as {DISTINCT_CHUNKS}, who as (select e.vec_id, min(c.tenant_id) as caller_tenant, min(c.owner_id) as caller from emb e join c on c.embed_h = e.h and c.embedding_model = e.model group by 1),
g as (select h.query_id, h.chunk_id, h.hit_rank, coalesce(c.tenant_id, 'global') as t, coalesce(c.visibility, 'tenant') as v, c.owner_id, w.caller_tenant, w.caller
from {HITS} h join c using (chunk_id) left join who w on w.vec_id = h.query_vec_id)"""


@query(
    GUARDED
    + """ select query_id, chunk_id, hit_rank from g where case when caller_tenant is null then t = 'global' and v = 'public' else (t = 'global' or t = caller_tenant) and (v in ('tenant', 'public') or coalesce(owner_id = caller, false)) end"""
)
def guarded_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits that the tenant and owner behind the query vector may see; ranks keep their gaps."""
    c = distinct_chunks(spark, d)
    e = table(spark, d, "emb").select("vec_id", F.col("h").alias("embed_h"), F.col("model").alias("embedding_model"))
    who = e.join(c, ["embed_h", "embedding_model"]).groupBy("vec_id").agg(F.min("tenant_id").alias("caller_tenant"), F.min("owner_id").alias("caller"))
    h = hits(spark, d).select("query_id", "chunk_id", "hit_rank", F.col("query_vec_id").alias("vec_id"))
    g = joins.lookup(h, c.select("chunk_id", "tenant_id", "visibility", "owner_id"), "chunk_id").join(who, "vec_id", "left")
    return g.where(search.visible(F.col("tenant_id"), F.col("visibility"), F.col("owner_id"), F.col("caller_tenant"), F.col("caller"))).select("query_id", "chunk_id", "hit_rank")


@query("select tenant_id, count(*) as n_docs, count(*) filter (where coalesce(tenant_id, 'global') = 'global' and coalesce(visibility, 'tenant') = 'public') as n_anonymous from documents group by 1")
def anonymous_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each tenant and how many anybody sees (default deny)."""
    docs = table(spark, d, "documents")
    seen = search.visible(F.col("tenant_id"), F.col("visibility"), F.col("owner_id"), None, None)
    return docs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(seen).alias("n_anonymous"))


@query(
    """with x as (select doc_id, coalesce(tenant_id, 'global') as t, visibility as v, coalesce(owner_id = 'user_272', false) as own from documents)
select doc_id, case when t <> 'global' and t <> 'tn_07' then 'other_tenant' when v = 'private' and not own then 'private' else 'allow' end as read_access,
case when t <> 'global' and t <> 'tn_07' then 'other_tenant' when v = 'private' and not own then 'private' when t = 'global' and v = 'public' then 'read_only' when own or v <> 'private' then 'allow' else 'private' end as delete_access from x"""
)
def access_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What one caller (user_272 of tn_07) may do with every document."""
    docs = table(spark, d, "documents")
    say = lambda a: search.decide(a, F.col("tenant_id"), F.col("visibility"), F.col("owner_id"), F.lit("tn_07"), F.lit("user_272"))
    return docs.select("doc_id", say("read").alias("read_access"), say("delete").alias("delete_access"))


@query(
    f"""with m as (select distinct id, trace_id, unnest(regexp_extract_all(comment, '\\[(\\d+)\\]', 1))::int as marker from feedback where comment is not null),
h as (select trace_id, hit_rank, min(chunk_id) as chunk_id from {HITS} where trace_id is not null and hit_rank is not null group by 1, 2)
select m.id as feedback_id, m.marker, h.chunk_id from m left join h on h.trace_id = m.trace_id and h.hit_rank = m.marker"""
)
def citation_sources(spark: SparkSession, d: str) -> DataFrame:
    """Markers like [2] in feedback, with the chunk that had this rank in the trace."""
    m = table(spark, d, "feedback").where("comment is not null").select(F.col("id").alias("feedback_id"), "trace_id", F.explode(X.citation_markers("comment")).alias("marker")).distinct()
    h = hits(spark, d).where("trace_id is not null and hit_rank is not null").groupBy("trace_id", F.col("hit_rank").alias("marker")).agg(F.min("chunk_id").alias("chunk_id"))
    return m.join(h, ["trace_id", "marker"], "left").select("feedback_id", "marker", "chunk_id")


PASSAGES = "select id, question, note, unnest(json_extract_string(case when json_valid(passages) then passages end, '$[*].chunk_id')) as chunk_id from escalations"


@query(
    f"""with p as ({PASSAGES}), c as {DISTINCT_CHUNKS},
t as (select distinct p.id, p.chunk_id, list_distinct(regexp_extract_all(lower(p.question), '[\\p{{L}}\\p{{N}}_]+')) as q, list_distinct(regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]+')) as a from p join c using (chunk_id))
select id as escalation_id, chunk_id, len(q)::int as n_terms, len(list_intersect(q, a))::int as n_common, round(len(list_intersect(q, a)) / nullif(len(q), 0), 6) as support from t"""
)
def passage_support(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's words that each cited passage contains."""
    e = table(spark, d, "escalations").select("id", "question", F.explode(F.from_json("passages", "array<struct<chunk_id: string>>")).alias("p")).select("id", "question", F.col("p.chunk_id").alias("chunk_id")).distinct()
    t = e.join(distinct_chunks(spark, d).select("chunk_id", "text"), "chunk_id").withColumn("q", F.array_distinct(X.words("question")))
    common = F.size(F.array_intersect("q", X.words("text")))
    return t.select(F.col("id").alias("escalation_id"), "chunk_id", F.size("q").alias("n_terms"), common.alias("n_common"), F.round(common / F.nullif(F.size("q"), F.lit(0)), 6).alias("support"))


@query(
    f"""with m as (select query_id, max(rerank_score) as s from {HITS} group by 1), c as (select query_id, 1 / (1 + exp(-s)) as p from m)
select query_id, round(p, 6) as confidence, case when p >= 0.3 then 'confident' when p >= 0.15 then 'low_confidence' else 'insufficient' end as state from c"""
)
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    m = hits(spark, d).groupBy("query_id").agg(F.max("rerank_score").alias("s")).withColumn("p", M.sigmoid("s"))
    return m.select("query_id", F.round("p", 6).alias("confidence"), M.band("p").alias("state"))


@query(
    f"""with m as (select query_id, max(rerank_score) as s, max(dense_score) >= 0.9 as good from {HITS} group by 1), t as (select round(0.05 * unnest(range(1, 20)), 2) as threshold),
x as (select threshold, coalesce(1 / (1 + exp(-s)), 0) >= threshold as said, coalesce(good, false) as good from m, t)
select threshold, round(coalesce(avg(case when good then said::int end), 1), 6) as answered_good, round(coalesce(avg(case when not good then (not said)::int end), 1), 6) as refused_bad,
round(0.5 * coalesce(avg(case when good then said::int end), 1) + 0.5 * coalesce(avg(case when not good then (not said)::int end), 1), 6) as objective from x group by 1"""
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Per threshold the share of good queries answered and of others refused; 19 thresholds meet each query once."""
    m = hits(spark, d).groupBy("query_id").agg(F.max("rerank_score").alias("s"), F.coalesce(F.max("dense_score") >= 0.9, F.lit(False)).alias("good"))
    p = F.coalesce(M.sigmoid("s"), F.lit(0.0))
    x = m.select("good", p.alias("p"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.round(i * 0.05, 2))).alias("threshold")).withColumn("said", F.col("p") >= F.col("threshold"))
    a = F.coalesce(F.avg(F.when(F.col("good"), F.col("said").cast("double"))), F.lit(1.0))
    b = F.coalesce(F.avg(F.when(~F.col("good"), (~F.col("said")).cast("double"))), F.lit(1.0))
    return x.groupBy("threshold").agg(F.round(a, 6).alias("answered_good"), F.round(b, 6).alias("refused_bad"), F.round(0.5 * a + 0.5 * b, 6).alias("objective"))


@query(f"select h.query_id, h.chunk_id, c.doc_title, case when c.chunk_id is null then null else substring(c.text, 1, 200) end as excerpt from {HITS} h left join {DISTINCT_CHUNKS} c on h.chunk_id = c.chunk_id")
def hit_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Title and excerpt of every hit; hits on unknown chunks stay as stubs."""
    c = distinct_chunks(spark, d).select("chunk_id", "doc_title", F.substring("text", 1, 200).alias("excerpt"))
    return joins.lookup(hits(spark, d).select("query_id", "chunk_id"), c, "chunk_id", "left").select("query_id", "chunk_id", "doc_title", "excerpt")


@query(
    f"""with p as ({PASSAGES}), c as {DISTINCT_CHUNKS}, s as (select distinct p.id, p.question, c.chunk_id, c.doc_title, array_to_string(c.section_path, ' > ') as path, c.source_file, coalesce(c.page_start::varchar, '?') || '-' || coalesce(c.page_end::varchar, '?') as pages from p join c using (chunk_id))
select id as escalation_id, 'Question: ' || any_value(question) || chr(10) || 'Sources:' || chr(10) || string_agg(coalesce(doc_title, '') || ' | ' || coalesce(nullif(path, ''), 'no section') || ' | ' || source_file || ' | pages ' || pages, chr(10) order by chunk_id) as prompt from s where question is not null group by id"""
)
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The question and its sources as one prompt per escalation."""
    e = table(spark, d, "escalations").where("question is not null").select("id", "question", F.explode(F.from_json("passages", "array<struct<chunk_id: string>>")).alias("p")).select("id", "question", F.col("p.chunk_id").alias("chunk_id")).distinct()
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    line = F.concat(F.coalesce("doc_title", F.lit("")), F.lit(" | "), F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.lit("no section")), F.lit(" | "), F.col("source_file"), F.lit(" | pages "), page("page_start"), F.lit("-"), page("page_end"))
    s = e.join(distinct_chunks(spark, d), "chunk_id").select("id", "question", "chunk_id", line.alias("line")).where("line is not null")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "line"))), lambda x: x["line"]), "\n")
    return s.groupBy("id", "question").agg(lines.alias("lines")).select(F.col("id").alias("escalation_id"), F.concat(F.lit("Question: "), "question", F.lit("\nSources:\n"), "lines").alias("prompt"))


@query()
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Logistic fit of relevance (cosine of 0.9) on the rerank score, with log loss and Brier score; iterative, no SQL."""
    x = hits(spark, d).where("rerank_score is not null and dense_score is not null").select("rerank_score", (F.col("dense_score") >= 0.9).cast("double").alias("label"))
    a, b, n, positive = aggregates.logistic_fit(x, "rerank_score", "label")
    p = M.sigmoid("rerank_score", a, b)
    return x.agg(aggregates.log_loss(p, F.col("label")).alias("log_loss"), F.avg((p - F.col("label")) ** 2).alias("brier")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("n_samples"), F.lit(positive).alias("n_positive"), "log_loss", "brier")
