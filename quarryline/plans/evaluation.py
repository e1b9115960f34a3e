"""Queries on answer quality, traces, caches and page-crossing paragraphs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import maths as M
from quarryline.functions import text as X
from quarryline.operators import aggregates
from quarryline.plans.base import query
from quarryline.plans.corpus import DISTINCT_CHUNKS, distinct_chunks
from quarryline.plans.retrieval import HITS, PASSAGES, hits
from quarryline.session import table

SET = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> ''))"


@query(
    f"""with t as (select id, {SET.format('question')} as q, {SET.format('note')} as a, case when resolution_note is null then null else {SET.format('resolution_note')} end as g from escalations where question is not null and note is not null)
select id as escalation_id, round(len(list_intersect(q, a)) / nullif(len(q), 0), 6) as relevancy, case when g is not null then round(len(list_intersect(a, g)) / nullif(len(a), 0), 6) end as precision, round(len(list_intersect(a, g)) / nullif(len(g), 0), 6) as recall from t"""
)
def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of note with question and resolution; null where a side is empty or missing."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    e = table(spark, d, "escalations").where("question is not null and note is not null").select("id", bag("question").alias("q"), bag("note").alias("a"), bag("resolution_note").alias("g"))
    share = lambda x, y, of: F.round(F.size(F.array_intersect(x, y)) / F.nullif(F.size(of), F.lit(0)), 6)
    known = lambda c: F.when(F.col("g").isNotNull(), c)
    return e.select(F.col("id").alias("escalation_id"), share("q", "a", "q").alias("relevancy"), known(share("a", "g", "a")).alias("precision"), known(share("a", "g", "g")).alias("recall"))


@query(
    f"""with x as (select 1 / (1 + exp(-(1.5 * rerank_score + 0.2))) as p, (dense_score >= 0.9)::int as y from {HITS} where rerank_score is not null and dense_score is not null), c as (select y, least(greatest(p, 1e-12), 1 - 1e-12) as p from x)
select count(*) as n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss, round(avg((p - y) * (p - y)), 6) as brier from c"""
)
def logloss_brier(spark: SparkSession, d: str) -> DataFrame:
    """Loss of given calibration coefficients (1.5, 0.2)."""
    x = hits(spark, d).where("rerank_score is not null and dense_score is not null").select(M.sigmoid("rerank_score", 1.5, 0.2).alias("p"), (F.col("dense_score") >= 0.9).cast("double").alias("y"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(aggregates.log_loss(F.col("p"), F.col("y")), 6).alias("log_loss"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"))


@query(
    f"""with p as (select distinct e.id, e.trace_id, q.chunk_id from escalations e join ({PASSAGES}) q using (id) where e.trace_id is not null and q.chunk_id is not null), h as (select trace_id, chunk_id, min(hit_rank) as hit_rank, max(rerank_score) as rerank_score from {HITS} where trace_id is not null group by 1, 2)
select p.id as escalation_id, p.chunk_id, h.chunk_id is not null as retrieved, coalesce(h.hit_rank, 0) as hit_rank from p left join h on p.trace_id = h.trace_id and p.chunk_id = h.chunk_id"""
)
def cited_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each cited passage was among the hits of its trace, and at which rank (0: not)."""
    p = table(spark, d, "escalations").where("trace_id is not null").select("id", "trace_id", F.explode(F.from_json("passages", "array<struct<chunk_id: string>>")).alias("p")).select("id", "trace_id", F.col("p.chunk_id").alias("chunk_id")).where("chunk_id is not null").distinct()
    h = hits(spark, d).where("trace_id is not null").groupBy("trace_id", "chunk_id").agg(F.min("hit_rank").alias("hit_rank"), F.lit(True).alias("seen"))
    return p.join(h, ["trace_id", "chunk_id"], "left").select(F.col("id").alias("escalation_id"), "chunk_id", F.coalesce("seen", F.lit(False)).alias("retrieved"), F.coalesce("hit_rank", F.lit(0)).alias("hit_rank"))


@query(
    f"""with f as (select * from feedback qualify row_number() over (partition by id order by loaded_at desc nulls last, comment nulls last) = 1), h as (select trace_id, count(*) as n_hits, round(avg(rerank_score), 6) as score from {HITS} where trace_id is not null group by 1)
select rating, h.trace_id is not null as known_trace, count(*) as n, round(avg(score), 5) as mean_score from f left join h on f.trace_id = h.trace_id group by 1, 2"""
)
def feedback_traces(spark: SparkSession, d: str) -> DataFrame:
    """Ratings against the hits of their traces; feedback on unknown traces is kept."""
    by = W.partitionBy("id").orderBy(F.desc_nulls_last("loaded_at"), F.asc_nulls_last("comment"))
    f = table(spark, d, "feedback").withColumn("r", F.row_number().over(by)).where("r = 1")
    h = hits(spark, d).where("trace_id is not null").groupBy("trace_id").agg(F.round(F.avg("rerank_score"), 6).alias("score"), F.lit(True).alias("known"))
    return f.join(h, "trace_id", "left").groupBy("rating", F.coalesce("known", F.lit(False)).alias("known_trace")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


@query(
    """with a as (select user_id, json_extract_string(props, '$.k') as k, max(ts) as last_ts, max(event_id) as last_id, count(*) as n from events group by 1, 2)
select user_id, k, n from a qualify row_number() over (partition by user_id order by last_ts desc, last_id desc, k) <= 20"""
)
def lru_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Keys a cache of 20 entries a user would still hold: the most recently used ones."""
    a = table(spark, d, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.max("ts").alias("last_ts"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("user_id").orderBy(F.desc("last_ts"), F.desc("last_id"), "k")
    return a.withColumn("r", F.row_number().over(by)).where("r <= 20").select("user_id", "k", "n")


@query(
    """with p as (select event_id, ts, event_type, user_id from events where event_type in ('error', 'purchase') and ts >= timestamp '2024-01-10 00:00:00' order by ts desc, event_id desc limit 100)
select event_id, event_type, user_id, row_number() over (order by ts, event_id) as sequence from p"""
)
def audit_export(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 records of two types since a day, numbered in ascending order: a top-k report."""
    p = table(spark, d, "events").where("event_type in ('error', 'purchase') and ts >= timestamp_ntz'2024-01-10 00:00:00'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return p.select("event_id", "event_type", "user_id", F.row_number().over(W.orderBy("ts", "event_id")).cast("long").alias("sequence"))


@query(
    """with p as (select *, lag(kind) over w as b_kind, coalesce(lag(page_end) over w, lag(page) over w) as b_page, lag(text) over w as b_text from blocks window w as (partition by doc_id order by block_idx)),
e as (select *, case when kind = 'paragraph' and b_kind = 'paragraph' and page = b_page + 1 and not regexp_matches(trim(b_text), '[.!?:;]$') and regexp_matches(text, '^[a-z]') then 0 else 1 end as edge from p),
i as (select *, sum(edge) over (partition by doc_id order by block_idx rows between unbounded preceding and current row) as part from e)
select doc_id, min(block_idx) as first_block, count(*) as n_blocks, sum(length(text))::bigint as n_chars, min(page) as page_start, max(coalesce(page_end, page)) as page_stop from i where text is not null group by doc_id, part having min(page) is not null"""
)
def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of paged documents with paragraphs that run over a page joined: islands by a running count of edges."""
    w = W.partitionBy("doc_id").orderBy("block_idx")
    b = table(spark, d, "blocks")
    runs_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph") & (F.col("page") == F.coalesce(F.lag("page_end").over(w), F.lag("page").over(w)) + 1) & ~F.trim(F.lag("text").over(w)).rlike("[.!?:;]$") & F.col("text").rlike("^[a-z]")
    e = b.withColumn("edge", F.when(F.coalesce(runs_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("edge").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = e.where("text is not null").groupBy("doc_id", "part").agg(F.min("block_idx").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.min("page").alias("page_start"), F.max(F.coalesce("page_end", "page")).alias("page_stop"))
    return out.where("page_start is not null").drop("part")


@query(
    f"""with v as (select vec_id, model, h from emb where vec is not null), c as {DISTINCT_CHUNKS}
select c.embedding_model as model, c.tenant_id, count(*) as n_chunks, count(v.vec_id) as n_vectors from c left join v on v.h = c.embed_h and v.model = c.embedding_model group by 1, 2"""
)
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and their vectors by model and tenant."""
    v = table(spark, d, "emb").where("vec is not null").select("vec_id", F.col("model").alias("embedding_model"), F.col("h").alias("embed_h"))
    c = distinct_chunks(spark, d).join(v, ["embed_h", "embedding_model"], "left")
    return c.groupBy(F.col("embedding_model").alias("model"), "tenant_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("vec_id").alias("n_vectors"))


def word_numbers(texts: DataFrame, key: str) -> DataFrame:
    """(key, w, n, number): the distinct words of every text, how often they come, and the word's unsigned 64-bit digest as decimal.

    Every distinct word of the table is digested once (no built-in has this digest), in Arrow batches; the rest is grouping and joining.
    """
    words = texts.select(key, F.explode(X.words("text")).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("binary")
    def digest(w: pd.Series) -> pd.Series:
        return w.map(lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest())

    # the digest is read as a little-endian number
    known = words.select("w").distinct().withColumn("b", digest("w")).select("w", F.conv(F.regexp_replace(F.hex("b"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"), 16, 10).cast("decimal(20,0)").alias("number"))
    return words.join(known, "w")


def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select(F.sha2("text", 256).alias("h"), "text").dropDuplicates(["h"])


@query()
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of every distinct chunk text, computed once a text: signed counts of its words' digests at 256 places (sparse: places and values)."""
    w = word_numbers(distinct_texts(spark, d), "h")
    sign = F.when(F.col("number") >= F.lit("9223372036854775808").cast("decimal(20,0)"), 1).otherwise(-1)
    v = w.groupBy("h", (F.col("number") % 256).cast("int").alias("place")).agg(F.sum(sign * F.col("n")).alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("h")))
    return v.withColumn("v", F.col("v") / norm).groupBy("h").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("place", "v")))).alias("at")).select("h", F.map_keys("at").alias("places"), F.transform(F.map_values("at"), lambda x: F.round(x, 6)).alias("values"))


@query()
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Term frequencies of every distinct chunk text at 2^20 hashed places."""
    w = word_numbers(distinct_texts(spark, d), "h").groupBy("h", (F.col("number") % (1 << 20)).cast("int").alias("place")).agg(F.sum("n").alias("tf"))
    return w.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("place", "tf"))).alias("terms"))


@query(
    f"""with c as {DISTINCT_CHUNKS} select chunk_id, token_count, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]'))::int as counted, coalesce(token_count, 0) <> len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]')) as differs from c where token_count is not null"""
)
def token_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stored token counts against the text."""
    n = X.token_count("text")
    return distinct_chunks(spark, d).where("token_count is not null").select("chunk_id", "token_count", n.alias("counted"), (F.col("token_count") != n).alias("differs"))


@query(
    f"""with c as (select chunk_id, token_count, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]'))::int as counted from {DISTINCT_CHUNKS})
select chunk_id, token_count, counted, case when token_count is null then 'missing' else 'wrong' end as fault from c where coalesce(token_count <> counted, true)"""
)
def token_faults(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored token count is missing or is not that of their text."""
    c = distinct_chunks(spark, d).select("chunk_id", "token_count", X.token_count("text").alias("counted"))
    return c.where("coalesce(token_count <> counted, true)").withColumn("fault", F.when(F.col("token_count").isNull(), "missing").otherwise("wrong"))
