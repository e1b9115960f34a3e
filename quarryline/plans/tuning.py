"""Queries on runs, thresholds, audit anchors and control status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import maths as M
from quarryline.operators import aggregates, audit, history
from quarryline.plans import governance
from quarryline.plans.base import query
from quarryline.plans.governance import IPAD, KEY, OPAD
from quarryline.plans.retrieval import HITS, hits
from quarryline.session import table

#: What a query is to the evaluation: nothing close enough, only something near, or a good hit among its candidates.
BUCKET = "case when good is null or good < 0.6 then 'out_of_corpus' when good < 0.9 then 'underspecified' else 'answer' end"


def scored_queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, raw, bucket): the best rerank score (-20 without one) and what was to be expected."""
    m = hits(spark, d).groupBy("query_id").agg(F.max("rerank_score").alias("s"), F.max("dense_score").alias("good"))
    return m.select("query_id", F.coalesce("s", F.lit(-20.0)).alias("raw"), F.expr(BUCKET).alias("bucket"))


@query(
    f"""with q as (select query_id, coalesce(max(rerank_score), -20.0) as raw, max(dense_score) as good from {HITS} group by 1), b as (select 1 / (1 + exp(-raw)) as p, {BUCKET} as bucket from q),
t as (select round(0.05 * unnest(range(4, 20)), 4) as threshold), s as (select threshold, coalesce(avg(case when bucket = 'out_of_corpus' then (p < least(threshold, 0.15))::int end), 1) as refuse, coalesce(avg(case when bucket = 'underspecified' then (p < threshold)::int end), 1) as escalate,
  coalesce(avg(case when bucket = 'answer' then (p >= threshold)::int end), 1) as answer from b, t group by 1),
w as (select threshold, round(refuse, 9) as refuse, round(escalate, 9) as escalate, round(answer, 9) as answer, round(0.4 * refuse + 0.3 * escalate + 0.3 * answer, 9) as score, round(refuse, 9) >= 0.2 and round(escalate, 9) >= 0.5 as eligible from s)
select threshold, refuse, escalate, answer, score, eligible, row_number() over (order by eligible desc, score desc, threshold) = 1 as chosen from w"""
)
def autotune(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen thresholds scored by refusals, escalations and answers; chosen is the best that meets both floors, the lowest of equals, or the best of all if none does."""
    b = scored_queries(spark, d).select(M.sigmoid("raw").alias("p"), "bucket")
    return aggregates.threshold_choice(b, [round(0.05 * i, 4) for i in range(4, 20)], floor=0.15, weights=(0.4, 0.3, 0.3), floors=(0.2, 0.5))


@query(
    f"""with r as (select query_id, date_trunc('month', min(retrieved_at))::date::varchar as run, coalesce(max(rerank_score), -20.0) as raw, max(dense_score) as good, avg(sparse_score) as sparse, count(*) as n_hits from {HITS} group by 1),
x as (select *, {BUCKET} as category, case when good is null or good < 0.8 then 'refuse' when good < 0.9 then 'clarify_or_escalate' else 'answer' end as expected, 1 / (1 + exp(-raw)) as p from r),
y as (select *, case when expected = 'refuse' then p < 0.15 when expected = 'clarify_or_escalate' then p < 0.3 else p >= 0.3 end as passed from x),
v as (select run, list_sort(list(n_hits)) as ns from r group by 1)
select y.run, count(*) as n, round(avg(good), 6) as context_precision_mean, round(avg(sparse), 6) as sparse_mean, any_value(ns[round_even(0.5 * (len(ns) - 1), 0)::int + 1]) as hits_p50, any_value(ns[round_even(0.95 * (len(ns) - 1), 0)::int + 1]) as hits_p95,
round(case when count(*) filter (where category = 'out_of_corpus') > 0 then 100.0 * avg(case when category = 'out_of_corpus' then passed::int end) else 100.0 * avg(case when expected = 'refuse' then passed::int end) end, 6) as safety_refuse_pct,
round(case when count(*) filter (where category = 'underspecified') > 0 then 100.0 * avg(case when category = 'underspecified' then passed::int end) else 100.0 * avg(case when expected = 'clarify_or_escalate' then passed::int end) end, 6) as safety_escalate_pct
from y join v using (run) group by 1"""
)
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """Per run (a month of queries): means that skip nulls, nearest-rank percentiles, and the shares that passed among refusals and escalations (by category, else by expected behaviour)."""
    r = hits(spark, d).groupBy("query_id").agg(F.date_format(F.trunc(F.min("retrieved_at"), "month"), "yyyy-MM-dd").alias("run"), F.coalesce(F.max("rerank_score"), F.lit(-20.0)).alias("raw"), F.max("dense_score").alias("good"), F.avg("sparse_score").alias("sparse"), F.count(F.lit(1)).alias("n_hits"))
    x = r.withColumn("category", F.expr(BUCKET)).withColumn("expected", F.expr("case when good is null or good < 0.8 then 'refuse' when good < 0.9 then 'clarify_or_escalate' else 'answer' end")).withColumn("p", M.sigmoid("raw"))
    x = x.withColumn("passed", F.when(F.col("expected") == "refuse", F.col("p") < 0.15).when(F.col("expected") == "clarify_or_escalate", F.col("p") < 0.3).otherwise(F.col("p") >= 0.3))
    pct = lambda category, expected: F.round(aggregates.share_passed("passed", F.col("category") == category, F.col("expected") == expected), 6)
    base = x.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("good"), 6).alias("context_precision_mean"), F.round(F.avg("sparse"), 6).alias("sparse_mean"), pct("out_of_corpus", "refuse").alias("safety_refuse_pct"), pct("underspecified", "clarify_or_escalate").alias("safety_escalate_pct"))
    return base.join(aggregates.nearest_rank(x, ["run"], "n_hits", {"hits_p50": 0.5, "hits_p95": 0.95}), "run", "left")


@query(f"with m as (select query_id, max(rerank_score) as s from {HITS} group by 1), c as (select coalesce(1 / (1 + exp(-s)), -1) as p from m) select case when p >= 0.3 then 'confident' when p >= 0.15 then 'low_confidence' else 'insufficient' end as state, count(*) as n from c group by 1")
def band_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Queries by confidence band; those without score count as insufficient."""
    m = hits(spark, d).groupBy("query_id").agg(F.max("rerank_score").alias("s"))
    return m.groupBy(M.band(M.sigmoid("s")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


MAC = f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode({{}}))))"


@query(
    f"""with recursive m as (select ts::date::varchar as day, {MAC.format("event_id::varchar || '|' || user_id::varchar || '|' || event_type || '|' || coalesce(props, '')")} as mac from events),
a as (select day, '{{"day":"' || day || '","digest":' || sum(('0x' || substring(mac, 1, 11))::bigint)::bigint || ',"n":' || count(*) || '}}' as payload, row_number() over (order by day) as sequence from m group by 1),
chain as (select sequence, day, payload, null::varchar as prev_hash, {MAC.format("'GENESIS|' || payload")} as record_hash from a where sequence = 1
union all select a.sequence, a.day, a.payload, c.record_hash, {MAC.format("c.record_hash || '|' || a.payload")} from chain c join a on a.sequence = c.sequence + 1)
select sequence, day, payload, prev_hash, record_hash, null::varchar as fault from chain"""
)
def audit_anchors(spark: SparkSession, d: str) -> DataFrame:
    """A chain of daily anchors over all events: number and digest sum of the day's records, linked by keyed hashes and checked."""
    macs = governance.audit_macs(spark, d).join(table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), "event_id")
    days = macs.groupBy("day").agg(F.sum(F.conv(F.substring("mac", 1, 11), 16, 10).cast("long")).alias("digest"), F.count(F.lit(1)).alias("n"))
    chain = audit.chained(days.select("day", audit.canonical("day", "digest", "n").alias("payload")), "day", "payload", KEY)
    return audit.verified(chain, "payload", KEY)


@query(
    """with x as (
select 'every document has chunks' as control, (select count(*) from documents) as checked, (select count(*) from documents where doc_id not in (select doc_id from chunks where doc_id is not null)) as failing
union all select 'every document is classified', (select count(*) from documents), (select count(*) from documents where doc_id not in (select doc_id from document_classification))
union all select 'chunk vectors are cached', (select count(distinct embed_h) from chunks), (select count(distinct embed_h) from chunks where embed_h not in (select h from emb where h is not null))
union all select 'escalations carry a trace', (select count(*) from escalations), (select count(*) from escalations where trace_id is null)),
s as (select control, case when failing = 0 then 'pass' when failing < checked then 'partial' else 'fail' end as status from x),
f as (select case when control in ('every document has chunks', 'chunk vectors are cached') then 'completeness' when control = 'every document is classified' then 'classification' else 'traceability' end as framework, status from s)
select framework, count(*) filter (where status = 'pass') as n_pass, count(*) filter (where status = 'partial') as n_partial, count(*) filter (where status = 'fail') as n_fail,
case max(case status when 'fail' then 2 when 'partial' then 1 else 0 end) when 2 then 'fail' when 1 then 'partial' else 'pass' end as overall from f group by 1"""
)
def control_summary(spark: SparkSession, d: str) -> DataFrame:
    """Controls by framework and status, and the worst status of each framework."""
    framework = F.when(F.col("control").isin("every document has chunks", "chunk vectors are cached"), "completeness").when(F.col("control") == "every document is classified", "classification").otherwise("traceability")
    n = lambda s: F.count_if(F.col("status") == s)
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "partial", 1).otherwise(0))
    s = governance.controls(spark, d).groupBy(framework.alias("framework")).agg(n("pass").alias("n_pass"), n("partial").alias("n_partial"), n("fail").alias("n_fail"), worst.alias("w"))
    return s.withColumn("overall", F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "partial").otherwise("pass")).drop("w")


@query(
    """with l as (select * from registry_snapshots qualify row_number() over (partition by doc_id order by received_at desc nulls last, snapshot_at desc nulls last, snap_id desc) = 1)
select l.doc_id, l.snapshot_at, coalesce(d.tenant_id, 'global') as tenant from l left join documents d using (doc_id) where l.status = 'failed' and coalesce(d.tenant_id, 'global') in ('global', 'tn_01')"""
)
def failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose last known state is failed, as a caller of one tenant sees them."""
    w = W.partitionBy("doc_id").orderBy(F.desc_nulls_last("received_at"), F.desc_nulls_last("snapshot_at"), F.desc("snap_id"))
    last = table(spark, d, "registry_snapshots").withColumn("r", F.row_number().over(w)).where("r = 1 and status = 'failed'").select("doc_id", "snapshot_at")
    docs = table(spark, d, "documents").select("doc_id", "tenant_id")
    return last.join(docs, "doc_id", "left").select("doc_id", "snapshot_at", F.coalesce("tenant_id", F.lit("global")).alias("tenant")).where("tenant in ('global', 'tn_01')")


@query(
    """with r as (select query_id, trace_id, retrieved_at, max(retrieved_at) over () as last from retrieved_chunks), l as (select distinct query_id, trace_id from r where retrieved_at::date = last::date)
select l.query_id, f.id as feedback_id, f.rating from l join (select distinct id, trace_id, rating from feedback) f on f.trace_id = l.trace_id"""
)
def latest_run_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback on the queries of the latest run (the last day with retrievals), by trace."""
    h = table(spark, d, "retrieved_chunks").select("query_id", "trace_id", "retrieved_at")
    last = h.agg(F.to_date(F.max("retrieved_at")).alias("day"))
    run = h.join(F.broadcast(last), F.to_date("retrieved_at") == F.col("day")).select("query_id", "trace_id").distinct()  # one row
    f = table(spark, d, "feedback").select(F.col("id").alias("feedback_id"), "trace_id", "rating").distinct()
    return run.join(f, "trace_id").select("query_id", "feedback_id", "rating")


@query(
    """with x as (select d.doc_id, coalesce(floor((epoch_us(timestamp '2026-01-01 00:00:00') - epoch_us(d.indexed_at)) / 86400000000)::bigint >= c.retention_days, false) as is_due from documents d left join document_classification c using (doc_id)),
k as (select distinct chunk_id, doc_id from chunks)
select x.is_due, count(distinct x.doc_id) as n_documents, count(k.chunk_id) as n_chunks from x left join k using (doc_id) group by 1"""
)
def purge_effect(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks that a purge of all documents due would delete and keep."""
    due = governance.retention_review(spark, d).select("doc_id", "is_due")
    k = table(spark, d, "chunks").select("doc_id", "chunk_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return due.join(k, "doc_id", "left").groupBy("is_due").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


@query(
    r"""with d as (select doc_id, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest, 'indexed' as status from documents),
l as (select doc_id, status, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest, row_number() over (partition by doc_id order by snapshot_at desc, received_at desc nulls last, snap_id desc) as r from registry_snapshots where status <> 'failed'),
m as (select doc_id, digest, status from l where r = 1 and status = 'indexed')
select doc_id, digest, 'ingest' as origin from d union all select doc_id, digest, 'kept' from m where doc_id not in (select doc_id from d)"""
)
def upserted_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry after an ingest: all rows of ingested documents replaced, the others kept."""
    from quarryline.operators import search

    w = W.partitionBy("doc_id").orderBy(F.desc("snapshot_at"), F.desc_nulls_last("received_at"), F.desc("snap_id"))
    m = table(spark, d, "registry_snapshots").where("status <> 'failed'").withColumn("r", F.row_number().over(w)).where("r = 1 and status = 'indexed'").select("doc_id", history.bare_digest("doc_hash").alias("digest"), F.lit("kept").alias("origin"))
    fresh = table(spark, d, "documents").select("doc_id", history.bare_digest("doc_hash").alias("digest"), F.lit("ingest").alias("origin"))
    return search.upserted(m, fresh, "doc_id")
