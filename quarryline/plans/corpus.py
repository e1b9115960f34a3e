"""Queries on documents, blocks and chunks: tokens, windows, sections, copies, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as X
from quarryline.operators import layout
from quarryline.plans.base import query
from quarryline.session import table

TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the published URL namespace
DISTINCT_CHUNKS = "(select * from chunks qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, chunk_index desc nulls last, token_count desc nulls last) = 1)"


def distinct_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as last ingested, one row per chunk_id."""
    by = W.partitionBy("chunk_id").orderBy(F.desc_nulls_last("ingested_at"), F.desc_nulls_last("chunk_index"), F.desc_nulls_last("token_count"))
    return table(spark, d, "chunks").withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


@query(f"select doc_id, len(regexp_extract_all(text, '{TOK}'))::int as n_tokens from documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_count("text").alias("n_tokens"))


@query(
    r"""select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(\["“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> ''))::int as n_sentences from documents"""
)
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.sentences("text")).alias("n_sentences"))


@query("select doc_id, regexp_replace(regexp_replace(lower(source_file), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.slug("source_file").alias("slug"))


@query(
    r"""with s as (select chunk_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) as t from chunks)
select distinct chunk_id, case when length(t) > 240 then substring(t, 1, 240) || '...' else t end as excerpt from s"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", X.excerpt("text").alias("excerpt")).distinct()


@query("select sha256(text) as text_hash, count(*) as n_copies, min(doc_id) as first_doc, count(distinct source) as n_sources from documents group by 1 having count(*) > 1")
def duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id", "source")
    return docs.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("n_sources")).where("n_copies > 1")


@query(
    f"""with h as (select doc_id, sha1(unhex('{NAMESPACE}') || encode('doc:' || source_file)) as h from documents)
select doc_id, substring(h,1,8) || '-' || substring(h,9,4) || '-5' || substring(h,14,3) || '-' || substring('89ab', (instr('0123456789abcdef', substring(h,17,1)) - 1) % 4 + 1, 1) || substring(h,18,3) || '-' || substring(h,21,12) as stable_id from h"""
)
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.uuid5(NAMESPACE, F.concat(F.lit("doc:"), F.col("source_file"))).alias("stable_id"))


@query(
    f"""with t as (select doc_id, regexp_extract_all(text, '{TOK}') as a from documents),
w as (select doc_id, a, unnest(range(0, greatest(ceil((len(a) - 400) / 352.0), 0)::int + 1)) as k from t where len(a) > 0)
select doc_id, k::int as chunk_index, (k * 352)::int as token_start, least(400, len(a) - k * 352)::int as token_count, md5(array_to_string(a[k * 352 + 1 : k * 352 + 400], ' ')) as tokens_md5 from w"""
)
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = layout.fixed_windows(table(spark, d, "documents"))
    return c.select("doc_id", "chunk_index", F.col("token_start").cast("int").alias("token_start"), F.col("token_count").cast("int").alias("token_count"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(
    f"""select chunker, count(*) as n_chunks, count(distinct doc_id) as n_documents, round(avg(token_count), 4) as tokens_mean, median(token_count) as tokens_median, round(quantile_cont(token_count, 0.95), 6) as tokens_p95,
min(token_count) as tokens_min, max(token_count) as tokens_max, sum(embed_token_count)::bigint as embed_tokens, round(avg(length(text)), 4) as chars_mean,
round(avg(case when token_count < 30 then 1.0 when token_count is not null then 0.0 end), 6) as pct_tiny, round(avg(case when page_start is not null then (case when page_end > page_start then 1.0 else 0.0 end) end), 6) as pct_cross_page
from {DISTINCT_CHUNKS} group by chunker"""
)
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = distinct_chunks(spark, d)
    return c.groupBy("chunker").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.round(F.avg("token_count"), 4).alias("tokens_mean"),
        F.percentile("token_count", F.lit(0.5)).alias("tokens_median"),
        F.round(F.percentile("token_count", F.lit(0.95)), 6).alias("tokens_p95"),
        F.min("token_count").alias("tokens_min"),
        F.max("token_count").alias("tokens_max"),
        F.sum("embed_token_count").alias("embed_tokens"),
        F.round(F.avg(F.length("text")), 4).alias("chars_mean"),
        F.round(F.avg(F.when(F.col("token_count") < 30, 1.0).when(F.col("token_count").isNotNull(), 0.0)), 6).alias("pct_tiny"),
        F.round(F.avg(F.when(F.col("page_start").isNotNull(), F.when(F.col("page_end") > F.col("page_start"), 1.0).otherwise(0.0))), 6).alias("pct_cross_page"),
    )


@query(
    f"""with o as (select chunker, char_start, char_end, lag(char_end) over w as before, lag(chunk_id) over w is null as is_first from {DISTINCT_CHUNKS} window w as (partition by doc_id, chunker order by chunk_index nulls first, chunk_id))
select chunker, round(sum(case when not is_first then greatest(coalesce(before - char_start, 0), 0) end) / nullif(sum(case when not is_first then char_end - char_start end), 0), 6) as overlap_ratio from o group by chunker"""
)
def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    o = layout.overlaps(distinct_chunks(spark, d)).where("not is_first")
    ratio = o.groupBy("chunker").agg(F.round(F.sum("overlap") / F.nullif(F.sum(F.col("char_end") - F.col("char_start")), F.lit(0)), 6).alias("overlap_ratio"))
    return distinct_chunks(spark, d).select("chunker").distinct().join(ratio, "chunker", "left")


@query(
    """select coalesce(chunker, 'unknown') as strategy, count(distinct doc_id) as n_documents, count(*) as n_chunks, round(count(*) * 1.0 / count(distinct doc_id), 2) as chunks_per_document
from (select distinct chunk_id, doc_id, chunker from chunks) group by 1"""
)
def strategy_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "chunker").distinct()
    n, m = F.count_distinct("doc_id"), F.count(F.lit(1))
    return c.groupBy(F.coalesce("chunker", F.lit("unknown")).alias("strategy")).agg(n.alias("n_documents"), m.alias("n_chunks"), F.round(m / n, 2).alias("chunks_per_document"))


@query(
    "select doc_id, block_idx, coalesce(sum(length(text) + 2) over (partition by doc_id order by block_idx rows between unbounded preceding and 1 preceding), 0)::bigint as char_start, length(text)::int as n_chars from blocks"
)
def block_offsets(spark: SparkSession, d: str) -> DataFrame:
    return layout.block_offsets(table(spark, d, "blocks")).select("doc_id", "block_idx", "char_start", F.length("text").alias("n_chars"))


@query(
    """with h as (select doc_id, block_idx as at, coalesce(level, 1) as level, text from blocks where kind = 'heading'),
open as (select b.doc_id, b.block_idx, h.at, h.text from blocks b join h on h.doc_id = b.doc_id and h.at <= b.block_idx
  where not exists (select 1 from h x where x.doc_id = b.doc_id and x.at > h.at and x.at <= b.block_idx and x.level <= h.level))
select b.doc_id, b.block_idx, coalesce(string_agg(o.text, ' > ' order by o.at), '') as path from blocks b left join open o using (doc_id, block_idx) group by 1, 2"""
)
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    return layout.section_paths(table(spark, d, "blocks")).select("doc_id", "block_idx", F.array_join("section_path", " > ").alias("path"))


@query(
    """with b as (select doc_id, block_idx, coalesce(sum(length(text) + 2) over (partition by doc_id order by block_idx rows between unbounded preceding and 1 preceding), 0)::bigint as at from blocks),
p as (select distinct doc_id, char_start::bigint as point from chunks where char_start is not null and doc_id in (select doc_id from blocks))
select p.doc_id, p.point, b.block_idx from p asof left join b on p.doc_id = b.doc_id and p.point >= b.at"""
)
def block_of_chunk(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks")
    points = table(spark, d, "chunks").where("char_start is not null").select("doc_id", F.col("char_start").cast("long").alias("point")).distinct()
    return layout.block_at(points.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi"), blocks)


@query(
    """with e as (select distinct model, h, true as cached from emb where vec is not null and len(vec) > 0), c as (select distinct embedding_model as model, embed_h as h from chunks where embed_h is not null)
select c.model, count(*) as n_texts, count(e.cached) as n_hits, count(*) - count(e.cached) as n_misses from c left join e on c.model = e.model and c.h = e.h group by c.model"""
)
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "emb").where("vec is not null and size(vec) > 0").select("model", "h").distinct().withColumn("cached", F.lit(1))
    c = table(spark, d, "chunks").where("embed_h is not null").select(F.col("embedding_model").alias("model"), F.col("embed_h").alias("h")).distinct()
    return c.join(e, ["model", "h"], "left").groupBy("model").agg(F.count(F.lit(1)).alias("n_texts"), F.count("cached").alias("n_hits"), (F.count(F.lit(1)) - F.count("cached")).alias("n_misses"))


@query(
    f"""with c as {DISTINCT_CHUNKS}, n as (select chunk_id, lag(chunk_id) over w as previous_id, lead(chunk_id) over w as next_id from c window w as (partition by doc_id order by chunk_index nulls last, chunk_id))
select * from n"""
)
def siblings(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy(F.asc_nulls_last("chunk_index"), "chunk_id")
    return distinct_chunks(spark, d).select("chunk_id", F.lag("chunk_id").over(w).alias("previous_id"), F.lead("chunk_id").over(w).alias("next_id"))


@query(
    r"""with l as (select doc_id, source, trim(regexp_replace(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[0-9]+', '#', 'g'), '[\s\p{Z}]+', ' ', 'g')) as line from documents where source is not null),
s as (select source, count(*) as n from documents where source is not null group by 1)
select l.source, l.line, count(distinct l.doc_id) as n_docs from l join s using (source) where l.line <> '' group by 1, 2, s.n having count(distinct l.doc_id) >= greatest(3, floor(0.02 * s.n))"""
)
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines, digits aside, that recur in at least 2 % (and 3) of a source's documents: candidates for running heads and feet."""
    docs = table(spark, d, "documents").where("source is not null")
    line = X.squeeze(F.regexp_replace(F.lower(F.col("raw")), "[0-9]+", "#"))
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", "source", line.alias("line")).where("line <> ''").distinct()
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_docs")).join(F.broadcast(size), "source").where("n_docs >= greatest(3, floor(0.02 * n))").select("source", "line", "n_docs")


@query(
    """with p as (select c.chunk_id, b.block_idx from (select distinct chunk_id, doc_id, page_start, coalesce(page_end, page_start) as page_end from chunks where page_start is not null) c
join blocks b on b.doc_id = c.doc_id and b.page <= c.page_end and coalesce(b.page_end, b.page) >= c.page_start)
select chunk_id, count(*) as n_blocks, min(block_idx) as first_block, max(block_idx) as last_block from p group by 1"""
)
def page_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose pages meet the pages of a chunk: an interval join within a document."""
    c = table(spark, d, "chunks").where("page_start is not null").select("chunk_id", "doc_id", "page_start", F.coalesce("page_end", "page_start").alias("to")).distinct()
    b = table(spark, d, "blocks").where("page is not null").select("doc_id", "block_idx", "page", F.coalesce("page_end", "page").alias("page_to"))
    met = c.join(b, "doc_id").where("page <= to and page_to >= page_start")
    return met.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block"))


@query(
    """select distinct chunk_id, array_to_string(list_filter(list_concat([doc_title], case when section_path[1] = doc_title then section_path[2:] else coalesce(section_path, []) end), lambda x: x is not null and x <> ''), ' > ') as breadcrumb from chunks"""
)
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", X.breadcrumb("doc_title", "section_path").alias("breadcrumb")).distinct()


@query()
def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks packed within their sections; the greedy fold has no SQL form."""
    return layout.pack_sections(table(spark, d, "blocks"))


@query()
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Topic breaks between sentences of every document; hashed sentence vectors have no SQL form."""
    return layout.topic_breaks(table(spark, d, "documents")).where("is_break").select("doc_id", "sentence", "distance")


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document packed between its topic breaks; the greedy fold has no SQL form."""
    return layout.semantic_chunks(table(spark, d, "documents"))


@query()
def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of every text in normalised form (Unicode composition has no built-in)."""
    n = table(spark, d, "documents").select("doc_id", X.normalize_text("text").alias("t"))
    return n.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("md5"))
