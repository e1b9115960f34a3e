"""Queries on runs, events, versions, classification and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarryline.functions import maths as M
from quarryline.functions import text as X
from quarryline.operators import aggregates, history
from quarryline.plans.base import query
from quarryline.plans.corpus import DISTINCT_CHUNKS, distinct_chunks
from quarryline.session import table

NOW = "2026-01-01 00:00:00"
KEY = b"quarryline-audit"
_KEY = KEY.ljust(64, b"\0")
IPAD, OPAD = (bytes(b ^ p for b in _KEY).hex() for p in (0x36, 0x5C))


@query(
    """with d as (select date_trunc('day', ts)::date as day, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2),
s as (select date_trunc('day', ts)::date as day, event_type, list_sort(list(value) filter (where value is not null)) as vs from events group by 1, 2)
select d.day::varchar as day, event_type, n, mean_value, vs[round_even(0.5 * (len(vs) - 1), 0)::int + 1] as p50, vs[round_even(0.95 * (len(vs) - 1), 0)::int + 1] as p95 from d join s using (day, event_type)"""
)
def run_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Per day and event type: count, mean and nearest-rank percentiles (a day is a run, a type a category, value the latency)."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    base = e.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return base.join(aggregates.nearest_rank(e, ["day", "event_type"], "value", {"p50": 0.5, "p95": 0.95}), ["day", "event_type"], "left")


@query(
    """with d as (select date_trunc('day', ts)::date as day, round(avg(value), 6) as value, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as error_share from events group by 1),
x as (select day, value, error_share, lag(value) over w as before, lag(error_share) over w as error_before from d window w as (order by day))
select day::varchar as day, value, error_share, round(value - before, 6) as value_delta, round(error_share - error_before, 6) as error_delta,
case when before is null then null when value < before then 'better' when value > before then 'worse' else 'same' end as direction from x"""
)
def run_compare(spark: SparkSession, d: str) -> DataFrame:
    """Every day against the day before; days, not events, are what the ordered window holds."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_share"))
    w = W.orderBy("day")
    before = F.lag("value").over(w)
    direction = F.when(before.isNull(), F.lit(None).cast("string")).when(F.col("value") < before, "better").when(F.col("value") > before, "worse").otherwise("same")
    return e.select("day", "value", "error_share", F.round(F.col("value") - before, 6).alias("value_delta"), F.round(F.col("error_share") - F.lag("error_share").over(w), 6).alias("error_delta"), direction.alias("direction"))


@query(
    """with d as (select event_type, date_trunc('day', ts)::date as day, round(avg(value), 4) as v from events group by 1, 2),
r as (select *, row_number() over (partition by event_type order by day desc) as r from d)
select event_type, string_agg(printf('%.4f', v), ',' order by day) as sparkline from r where r <= 10 group by 1"""
)
def sparklines(spark: SparkSession, d: str) -> DataFrame:
    """The last ten daily means of every event type, oldest first."""
    e = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 4).alias("v"))
    r = e.withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("day")))).where("r <= 10")
    vs = F.array_sort(F.collect_list(F.struct("day", "v")))
    return r.groupBy("event_type").agg(F.array_join(F.transform(vs, lambda x: F.format_string("%.4f", x["v"])), ",").alias("sparkline"))


@query(
    """with r as (select event_id, user_id, floor(epoch(ts) / 60)::bigint as win, row_number() over (partition by user_id, floor(epoch(ts) / 60)::bigint order by ts, event_id) as k, ts from events)
select event_id, k <= 2 as allowed, case when k > 2 then greatest(1, ceil((win + 1) * 60 - epoch(ts)))::bigint else 0 end as retry_after from r"""
)
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every event: at most two a user and minute; a refusal says after how many seconds to come back."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("us", us).withColumn("win", F.floor(F.col("us") / 60_000_000))
    k = F.row_number().over(W.partitionBy("user_id", "win").orderBy("ts", "event_id"))
    wait = F.greatest(F.lit(1), F.ceil((F.col("win") + 1) * 60 - F.col("us") / 1e6)).cast("long")
    return e.withColumn("k", k).select("event_id", (F.col("k") <= 2).alias("allowed"), F.when(F.col("k") > 2, wait).otherwise(F.lit(0).cast("long")).alias("retry_after"))


@query(
    f"""select event_id, sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(event_id::varchar || '|' || user_id::varchar || '|' || event_type || '|' || coalesce(props, ''))))) as mac from events"""
)
def audit_macs(spark: SparkSession, d: str) -> DataFrame:
    """Keyed digest of every event's payload."""
    e = table(spark, d, "events")
    return e.select("event_id", X.hmac_sha256(KEY, F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))).alias("mac"))


VERSIONS = r"""(select id, doc_id, version, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest, strptime(left(replace(effective_from, 'T', ' '), 19), '%Y-%m-%d %H:%M:%S') as from_ts,
case when effective_to is not null then strptime(left(replace(effective_to, 'T', ' '), 19), '%Y-%m-%d %H:%M:%S') end as to_ts, superseded_by_version from document_versions)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """document_versions with bare digests and parsed times (the offset is always UTC)."""
    ts = lambda c: F.to_timestamp(F.substring(F.replace(F.col(c), F.lit("T"), F.lit(" ")), 1, 19))
    return table(spark, d, "document_versions").select("id", "doc_id", "version", history.bare_digest("doc_hash").alias("digest"), ts("effective_from").alias("from_ts"), ts("effective_to").alias("to_ts"), "superseded_by_version")


@query(
    f"""with x as (select *, lead(from_ts) over w as next_from, lead(version) over w as next_version, lag(digest) over w as before, row_number() over w as k, lag(version) over w as last_version from {VERSIONS} window w as (partition by doc_id order by from_ts nulls first, version, id))
select doc_id, count(*) as n_rows, count(*) filter (where version <> k) as misnumbered, count(*) filter (where last_version = version) as repeated, count(*) filter (where digest = before) as unchanged,
count(*) filter (where next_from is not null and to_ts is null) as left_open, count(*) filter (where to_ts > next_from) as overlapping, count(*) filter (where to_ts < next_from) as gaps, count(*) filter (where next_version is not null and superseded_by_version is distinct from next_version) as broken_links
from x group by doc_id"""
)
def version_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults in the recorded history of every document: each row is checked against its neighbours."""
    w = W.partitionBy("doc_id").orderBy("from_ts", "version", "id")
    x = versions(spark, d)
    x = x.withColumns({"next_from": F.lead("from_ts").over(w), "next_version": F.lead("version").over(w), "before": F.lag("digest").over(w), "k": F.row_number().over(w), "last_version": F.lag("version").over(w)})
    n = lambda cond: F.count_if(F.expr(cond))
    return x.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), n("version <> k").alias("misnumbered"), n("last_version = version").alias("repeated"), n("digest = before").alias("unchanged"), n("next_from is not null and to_ts is null").alias("left_open"),
        n("to_ts > next_from").alias("overlapping"), n("to_ts < next_from").alias("gaps"), n("next_version is not null and not (superseded_by_version <=> next_version)").alias("broken_links"),
    )


@query(f"select doc_id, version, digest from {VERSIONS} qualify row_number() over (partition by doc_id order by from_ts desc nulls last, version desc, id desc) = 1")
def current_versions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy(F.desc_nulls_last("from_ts"), F.desc("version"), F.desc("id"))
    return versions(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "version", "digest")


@query(
    f"""with x as (select d.doc_id, coalesce(c.classification, 'internal') as classification, floor((epoch_us(timestamp '{NOW}') - epoch_us(d.indexed_at)) / 86400000000)::bigint as age_days, c.retention_days,
floor((epoch_us(timestamp '{NOW}') - epoch_us(coalesce(c.last_reviewed_at, d.indexed_at))) / 86400000000)::bigint as unreviewed_days, coalesce(c.review_cycle_days, 365) as cycle
from documents d left join document_classification c using (doc_id))
select doc_id, classification, age_days, coalesce(age_days >= retention_days, false) as is_due, coalesce(unreviewed_days > cycle, false) as is_stale from x"""
)
def retention_review(spark: SparkSession, d: str) -> DataFrame:
    """Age of every document in full days, and whether it is due for purging or its review is stale."""
    now = F.lit(NOW).cast("timestamp")
    stamp = lambda c: F.col(c).cast("timestamp")
    c = table(spark, d, "document_classification").select("doc_id", "classification", "retention_days", "last_reviewed_at", "review_cycle_days")
    x = table(spark, d, "documents").select("doc_id", "indexed_at").join(c, "doc_id", "left")
    age = M.whole_days(now, stamp("indexed_at"))
    unreviewed = M.whole_days(now, F.coalesce(stamp("last_reviewed_at"), stamp("indexed_at")))
    no = F.lit(False)
    return x.select("doc_id", F.coalesce("classification", F.lit("internal")).alias("classification"), age.alias("age_days"), F.coalesce(age >= F.col("retention_days"), no).alias("is_due"), F.coalesce(unreviewed > F.coalesce("review_cycle_days", F.lit(365)), no).alias("is_stale"))


@query(
    f"""with m as (select chunk_id, doc_id, text, instr(lower(text), lower('Beneficial Owner')) as pos from {DISTINCT_CHUNKS})
select chunk_id, doc_id, pos::int as position, substring(sha256('beneficial owner'), 1, 16) as subject_hash from m where pos > 0"""
)
def erasure_matches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that name a subject literally, whatever the case; only the subject's digest is reported."""
    subject = "Beneficial Owner"
    at = F.instr(F.lower("text"), F.lit(subject.lower()))
    return distinct_chunks(spark, d).select("chunk_id", "doc_id", at.alias("position"), F.substring(F.sha2(F.lit(subject.lower()), 256), 1, 16).alias("subject_hash")).where("position > 0")


@query(
    f"""select doc_id, title, source_file, jurisdiction, updated_at from documents where (lower(title) like '%policy%' or lower(source_file) like '%policy%') and status = 'indexed' and coalesce(visibility, 'tenant') in ('tenant', 'public') order by updated_at desc nulls last, doc_id limit 20 offset 5"""
)
def registry_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a registry search: a top-k report."""
    docs = table(spark, d, "documents").where(
        (F.lower("title").contains("policy") | F.lower("source_file").contains("policy")) & (F.col("status") == "indexed") & F.coalesce("visibility", F.lit("tenant")).isin("tenant", "public")
    )
    return docs.select("doc_id", "title", "source_file", "jurisdiction", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "doc_id").offset(5).limit(20)


@query(
    """with l as (select *, row_number() over (partition by doc_id order by received_at desc nulls last, snapshot_at desc nulls last, snap_id desc) as r from registry_snapshots)
select doc_id, status, snapshot_at, coalesce(chunk_count, 0) as chunk_count from l where r = 1"""
)
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """The last known state of every document in the deliveries."""
    w = W.partitionBy("doc_id").orderBy(F.desc_nulls_last("received_at"), F.desc_nulls_last("snapshot_at"), F.desc("snap_id"))
    return table(spark, d, "registry_snapshots").withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "status", "snapshot_at", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


@query(
    r"""with l as (select doc_id, status, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest, row_number() over (partition by doc_id order by snapshot_at desc, received_at desc nulls last, snap_id desc) as r from registry_snapshots where status <> 'failed'),
m as (select doc_id, status, digest from l where r = 1), d as (select doc_id, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest from documents)
select coalesce(d.doc_id, m.doc_id) as doc_id, case when d.doc_id is null then 'prune' when m.doc_id is null or m.status = 'deleted' then 'new' when m.digest = d.digest then 'skip' else 'changed' end as action from d full join m on d.doc_id = m.doc_id"""
)
def manifest_actions(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental ingest does with each document: skip unchanged ones, take new and changed ones, prune the rest."""
    w = W.partitionBy("doc_id").orderBy(F.desc("snapshot_at"), F.desc_nulls_last("received_at"), F.desc("snap_id"))
    m = table(spark, d, "registry_snapshots").where("status <> 'failed'").withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", F.col("status").alias("m_status"), history.bare_digest("doc_hash").alias("m_digest"), F.lit(True).alias("in_m"))
    docs = table(spark, d, "documents").select("doc_id", history.bare_digest("doc_hash").alias("digest"), F.lit(True).alias("in_d"))
    action = F.when(F.col("in_d").isNull(), "prune").when(F.col("in_m").isNull() | (F.col("m_status") == "deleted"), "new").when(F.col("m_digest") == F.col("digest"), "skip").otherwise("changed")
    return docs.join(m, "doc_id", "full").select("doc_id", action.alias("action"))


@query(
    r"""with q as (select id, created_at, trim(regexp_replace(lower(question), '[\s\p{Z}]+', ' ', 'g')) as k from escalations where question is not null),
x as (select id, created_at, k, lag(created_at) over (partition by k order by created_at, id) as before from q)
select id as escalation_id, substring(sha256(k), 1, 24) as question_hash, coalesce(created_at - before <= interval 7 day, false) as is_hit from x"""
)
def question_cache(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question was asked in the same words within seven days before: the exact tier of a response cache."""
    q = table(spark, d, "escalations").where("question is not null").select("id", F.col("created_at").cast("timestamp").alias("at"), X.question_key("question").alias("k"))
    before = F.lag("at").over(W.partitionBy("k").orderBy("at", "id"))
    return q.select(F.col("id").alias("escalation_id"), F.substring(F.sha2("k", 256), 1, 24).alias("question_hash"), F.coalesce(F.unix_micros("at") - F.unix_micros(before) <= 7 * 86_400_000_000, F.lit(False)).alias("is_hit"))


@query(
    """with f as (select * from feedback qualify row_number() over (partition by id order by loaded_at desc nulls last, comment nulls last) = 1)
select date_trunc('month', created_at)::date::varchar as month, rating, count(*) as n, count(*) filter (where comment is not null and trim(comment) <> '') as n_comments, count(*) filter (where loaded_at - created_at > interval 1 day) as n_late from f group by 1, 2"""
)
def feedback_by_month(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc_nulls_last("loaded_at"), F.asc_nulls_last("comment"))
    f = table(spark, d, "feedback").withColumn("r", F.row_number().over(w)).where("r = 1")
    late = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) > 86_400_000_000
    return f.groupBy(F.date_format(F.trunc("created_at", "month"), "yyyy-MM-dd").alias("month"), "rating").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("comment").isNotNull() & (F.trim("comment") != "")).alias("n_comments"), F.count_if(late).alias("n_late"))


@query(
    f"""select case when h < 24 then 'day' when h < 168 then 'week' when h < 720 then 'month' else 'older' end as band, count(*) as n from (select (epoch_us(timestamp '{NOW}') - epoch_us(updated_at)) / 3600000000.0 as h from documents where updated_at is not null) group by 1"""
)
def freshness_bands(spark: SparkSession, d: str) -> DataFrame:
    h = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 3_600_000_000
    b = F.when(h < 24, "day").when(h < 168, "week").when(h < 720, "month").otherwise("older")
    return table(spark, d, "documents").where("updated_at is not null").groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with x as (
select 'every document has chunks' as control, (select count(*) from documents) as checked, (select count(*) from documents where doc_id not in (select doc_id from chunks where doc_id is not null)) as failing
union all select 'every document is classified', (select count(*) from documents), (select count(*) from documents where doc_id not in (select doc_id from document_classification))
union all select 'chunk vectors are cached', (select count(distinct embed_h) from chunks), (select count(distinct embed_h) from chunks where embed_h not in (select h from emb where h is not null))
union all select 'escalations carry a trace', (select count(*) from escalations), (select count(*) from escalations where trace_id is null))
select control, checked, failing, case when failing = 0 then 'pass' when failing < checked then 'partial' else 'fail' end as status from x"""
)
def controls(spark: SparkSession, d: str) -> DataFrame:
    """Checks over whole tables, each one row: rows checked, rows failing, status."""
    docs, chunks = table(spark, d, "documents").select("doc_id"), table(spark, d, "chunks")
    hs = chunks.select(F.col("embed_h").alias("h")).where("h is not null").distinct()

    def row(name: str, checked: DataFrame, failing: DataFrame) -> DataFrame:
        ones = checked.select(F.lit(1).alias("c"), F.lit(0).alias("f")).unionByName(failing.select(F.lit(0).alias("c"), F.lit(1).alias("f")))
        both = ones.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("checked"), F.coalesce(F.sum("f"), F.lit(0)).alias("failing"))
        return both.select(F.lit(name).alias("control"), "checked", "failing", F.when(F.col("failing") == 0, "pass").when(F.col("failing") < F.col("checked"), "partial").otherwise("fail").alias("status"))

    esc = table(spark, d, "escalations")
    parts = [
        row("every document has chunks", docs, docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")),
        row("every document is classified", docs, docs.join(table(spark, d, "document_classification").select("doc_id"), "doc_id", "left_anti")),
        row("chunk vectors are cached", hs, hs.join(table(spark, d, "emb").select("h").distinct(), "h", "left_anti")),
        row("escalations carry a trace", esc, esc.where("trace_id is null")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select o_orderpriority, o_orderstatus, count(*) as n_orders, round(sum(o_totalprice), 2) as total_price, count(distinct o_custkey) as n_customers from orders group by 1, 2")
def order_volume(spark: SparkSession, d: str) -> DataFrame:
    """Grouping at volume: orders by priority and status."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price"), F.count_distinct("o_custkey").alias("n_customers"))


@query(
    """select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n_lines from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2"""
)
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Joins at volume: line items to orders, customers and nations."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    per_cust = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return (
        per_cust.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.sum("n").alias("n_lines"))
    )
