"""Queries on answering: citations, filtered search, caches, chunk listings, erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import maths as M
from quarryline.functions import text as X
from quarryline.operators import aggregates, citations as C, joins, layout, search
from quarryline.plans.base import query
from quarryline.plans.corpus import DISTINCT_CHUNKS, NAMESPACE, distinct_chunks
from quarryline.plans.retrieval import HITS, hits
from quarryline.session import materialize, table

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
ANSWERS = f"""c as {DISTINCT_CHUNKS}, who as (select e.vec_id, min(c.tenant_id) as caller_tenant, min(c.owner_id) as caller from emb e join c on c.embed_h = e.h and c.embedding_model = e.model group by 1),
t as (select query_id, query_vec_id, chunk_id, row_number() over (partition by query_id order by fused_score desc nulls last, chunk_id) as rank from {HITS} where chunk_id in (select chunk_id from c) qualify rank <= 3),
l as (select t.*, c.text, c.tenant_id, c.visibility, c.owner_id, trim(regexp_extract(regexp_replace(c.text, '[\\s\\p{{Z}}]+', ' ', 'g'), '^[^.!?]*')) as claim from t join c using (chunk_id)),
a as (select query_id, min(query_vec_id) as vec_id, string_agg(claim || ' [' || rank || '][' || (rank % 3 + 1) || '].', ' ' order by rank) || ' See also [1] and [9].' as answer from l group by 1)"""


def drafted_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(answers: query_id, vec_id, answer; sources: query_id, rank and the chunk): the leading claims of a query's three best hits, each citing itself and the next."""
    c = distinct_chunks(spark, d).select("chunk_id", "text", "tenant_id", "visibility", "owner_id")
    by = W.partitionBy("query_id").orderBy(F.desc_nulls_last("fused_score"), "chunk_id")
    top = hits(spark, d).join(c.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "query_vec_id", "chunk_id", F.row_number().over(by).alias("rank")).where("rank <= 3")
    claim = F.trim(F.regexp_extract(F.regexp_replace("text", r"[\s\p{Z}]+", " "), "^[^.!?]*", 0))
    sources = materialize(joins.lookup(top, c, "chunk_id"), "sources")  # three a query
    sources = sources.withColumn("line", F.concat(claim, F.lit(" ["), "rank", F.lit("]["), F.col("rank") % 3 + 1, F.lit("].")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), " ")
    answers = sources.groupBy("query_id").agg(F.min("query_vec_id").alias("vec_id"), F.concat(lines, F.lit(" See also [1] and [9].")).alias("answer"))
    return answers, sources.withColumnRenamed("rank", "marker")


@query(
    f"""with {ANSWERS},
p as (select query_id, vec_id, unnest(string_split(regexp_replace(answer, '([.!?]) |\\n', '\\1' || chr(1), 'g'), chr(1))) as passage, unnest(range(0, len(string_split(regexp_replace(answer, '([.!?]) |\\n', '\\1' || chr(1), 'g'), chr(1))))) as piece from a),
m as (select query_id, vec_id, trim(passage) as passage, piece, unnest(regexp_extract_all(passage, '\\[(\\d+)\\]', 1))::int as marker, unnest(range(0, len(regexp_extract_all(passage, '\\[(\\d+)\\]', 1)))) as turn from p),
x as (select m.query_id, m.marker, m.piece, m.turn, l.chunk_id, l.tenant_id, l.visibility, l.owner_id, who.caller_tenant, who.caller, lower(l.text) as body, trim(regexp_replace(lower(m.passage), '\\[\\d+\\]', '', 'g')) as claim
  from m join l on l.query_id = m.query_id and l.rank = m.marker left join who on who.vec_id = m.vec_id),
w as (select *, list_filter(list_transform(regexp_extract_all(claim, '[\\p{{L}}\\p{{N}}_$-]+'), lambda w: regexp_replace(w, '^[$-]+|[$-]+$', '', 'g')), lambda w: len(w) > 2 and not list_contains({_LIST(C.STOPWORDS)}, w)) as words, regexp_extract_all(claim, '{C.CLAIM_NUMBER}') as numbers from x),
s as (select *, greatest(len(list_filter(words, lambda w: contains(body, w))) / nullif(len(words), 0), case when len(numbers) > 0 then len(list_filter(numbers, lambda w: contains(body, w))) / len(numbers) else 0 end) as share,
  len(list_filter({_LIST(C.REFUSALS)}, lambda r: contains(claim, r))) > 0 as refusal from w),
o as (select *, case when claim = '' then true when refusal then false when len(words) = 0 then true when len(words) = 1 then len(list_filter(words, lambda w: contains(body, w))) > 0 else share >= 0.2 end as ok,
  case when claim = '' then 1.0 when refusal then 0.0 when len(words) = 0 then 1.0 else share end as score,
  (caller_tenant is null or coalesce(tenant_id, 'global') = 'global' or tenant_id = caller_tenant) and not (coalesce(visibility, 'tenant') = 'private' and owner_id is not null and not coalesce(owner_id = caller, false)) as allowed from s)
select query_id, marker, chunk_id, piece::int as piece, round(score, 6) as support from o where ok and allowed qualify row_number() over (partition by query_id, marker order by piece, turn) = 1"""
)
def citation_checks(spark: SparkSession, d: str) -> DataFrame:
    """Accepted citations of drafted answers: markers in range, supported by their passage, open to the caller, each at its first accepted place."""
    answers, sources = drafted_answers(spark, d)
    c = distinct_chunks(spark, d)
    e = table(spark, d, "emb").select("vec_id", F.col("h").alias("embed_h"), F.col("model").alias("embedding_model"))
    who = e.join(c, ["embed_h", "embedding_model"]).groupBy("vec_id").agg(F.min("tenant_id").alias("caller_tenant"), F.min("owner_id").alias("caller"))
    marks = C.cited_passages(answers, "answer").drop("answer").join(sources, ["query_id", "marker"]).join(who, "vec_id", "left")
    marks = C.supported(marks, "passage", "text")
    allowed = C.may_cite(*(F.col(k) for k in ("tenant_id", "visibility", "owner_id", "caller_tenant", "caller")))
    marks = marks.select("query_id", "marker", "piece", "turn", "chunk_id", (F.col("supported") & allowed).alias("accepted"), F.round("support", 6).alias("support"))
    return C.first_accepted(marks, ["query_id"], F.col("accepted"), "chunk_id", "support").select("query_id", "marker", "chunk_id", "piece", "support")


# ---------------------------------------------------------------- search
TENANT_OF = """(select id, min(c.tenant_id) as tenant from (select id, unnest(json_extract_string(case when json_valid(passages) then passages end, '$[*].chunk_id')) as chunk_id from escalations) p join c using (chunk_id) group by 1)"""
HASH = "('0x' || substring(md5({w}), 1, 4))::int"
VEC = "list_transform(range(0, 256), lambda b: list_sum(list_transform(list_filter({ws}, lambda w: ('0x' || substring(md5(w), 1, 4))::int % 256 = b), lambda w: case when ('0x' || substring(md5(w), 5, 1))::int >= 8 then 1.0 else -1.0 end)))"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as last ingested, written once for the legs of a search and what follows it."""
    return materialize(distinct_chunks(spark, d).select(F.col("chunk_id").alias("passage_id"), "text", "doc_type", "tenant_id", "visibility", "owner_id"), "passages")


def _asked(spark: SparkSession, d: str, passages: DataFrame, every: int = 1) -> DataFrame:
    """(question_id, text, tenant): escalated questions, all or those whose id is divisible by ``every``; the tenant is that of the least cited chunk's, null without one."""
    e = table(spark, d, "escalations").where("question is not null")
    e = e.where(F.col("id") % every == 0) if every > 1 else e
    cited = e.select("id", F.explode(F.from_json("passages", "array<struct<chunk_id: string>>")).alias("p")).select("id", F.col("p.chunk_id").alias("passage_id"))
    tenant = cited.join(passages.select("passage_id", "tenant_id"), "passage_id").groupBy("id").agg(F.min("tenant_id").alias("tenant"))
    return materialize(e.select("id", "question").join(tenant, "id", "left").select(F.col("id").alias("question_id"), F.col("question").alias("text"), "tenant"), "questions")


ALL_SEARCH = f"""with c as {DISTINCT_CHUNKS}, k as {TENANT_OF},
p as (select chunk_id as passage_id, doc_type, coalesce(tenant_id, 'global') as tenant, coalesce(visibility, 'tenant') as visibility, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws from c),
q as (select id as question_id, coalesce(k.tenant, '') as tenant, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') as ws from escalations left join k using (id) where question is not null),
sz as (select passage_id, len(ws) as len from p), al as (select count(*) as n, avg(len) as avgdl from sz),
tf as (select passage_id, term, count(*) as tf from (select passage_id, unnest(ws) as term from p) group by 1, 2),
asked as (select distinct question_id, unnest(ws) as term from q), dfs as (select term, count(*) as df from tf where term in (select term from asked) group by 1),
open as (select q.question_id, p.passage_id, q.ws as a, p.ws as b from q join p on p.doc_type = 'internal_policy' and (case when q.tenant = '' then p.tenant = 'global' and p.visibility = 'public' else p.tenant in (q.tenant, 'global') and p.visibility in ('tenant', 'public') end)),
sp as (select question_id, passage_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) as score from open join asked using (question_id) join tf using (passage_id, term) join dfs using (term) join sz using (passage_id), al group by 1, 2),
qv as (select question_id, {VEC.format(ws='ws')} as v from q), pv as (select passage_id, {VEC.format(ws='ws')} as v from p where passage_id in (select passage_id from open)),
ds as (select question_id, passage_id, round(list_cosine_similarity(list_transform(qv.v, lambda x: coalesce(x, 0.0)), list_transform(pv.v, lambda x: coalesce(x, 0.0))), 6) as score from open join qv using (question_id) join pv using (passage_id)),
r as (select question_id, passage_id, row_number() over (partition by question_id order by score desc, passage_id) as rank from sp qualify rank <= 20
union all select question_id, passage_id, row_number() over (partition by question_id order by score desc, passage_id) as rank from ds where not isnan(score) qualify rank <= 20)
select question_id, passage_id, round(sum(1.0 / (60 + rank)), 12) as fused_score, count(*) as n_lists, row_number() over (partition by question_id order by round(sum(1.0 / (60 + rank)), 12) desc, passage_id) as fused_rank from r group by 1, 2 qualify fused_rank <= 20"""
SEARCH = ALL_SEARCH.replace("(id) where question", "(id) where id % 100 = 0 and question")


@query(SEARCH)
def filtered_search(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """Hybrid search of the escalated questions whose id is divisible by ``every`` among the internal policies their tenant may see, against all chunks."""
    p = _passages(spark, d)
    return _found(_asked(spark, d, p, every), p)


def _found(asked: DataFrame, passages: DataFrame) -> DataFrame:
    return search.hybrid(asked, passages, 20, keep=search.where(doc_type="internal_policy")).withColumn("fused_rank", F.col("fused_rank").cast("long"))


@query(
    f"""with h as {HITS}, c as {DISTINCT_CHUNKS}, f as (select query_id, chunk_id, rerank_score, row_number() over (partition by query_id order by fused_score desc nulls last, chunk_id) as fused_rank from h where chunk_id in (select chunk_id from c))
select query_id, chunk_id, coalesce(rerank_score, -20.0) as score, rerank_score is not null as reranked, row_number() over (partition by query_id order by rerank_score desc nulls last, fused_rank) as new_rank from f qualify new_rank <= 5"""
)
def reranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Five best candidates a query by rerank score; those the reranker left out follow in their fused order."""
    h = hits(spark, d).join(distinct_chunks(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    f = h.select("query_id", "chunk_id", "rerank_score", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("fused_score"), "chunk_id")).alias("fused_rank"))
    scored = f.where("rerank_score is not null").select("query_id", "chunk_id", "rerank_score")
    top = search.rerank(f.drop("rerank_score"), scored, 5)
    return top.select("query_id", "chunk_id", F.coalesce("rerank_score", F.lit(-20.0)).alias("score"), F.col("rerank_score").isNotNull().alias("reranked"), F.col("new_rank").cast("long").alias("new_rank"))


@query(
    f"""with f as ({ALL_SEARCH}), ch as {DISTINCT_CHUNKS}, e as (select id as question_id, question, list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) as qw from escalations where question is not null),
s as (select f.question_id, f.passage_id, f.fused_rank, round(len(list_intersect(e.qw, regexp_extract_all(lower(ch.text), '[\\p{{L}}\\p{{N}}_]+'))) / len(e.qw), 6) as score, trim(regexp_extract(regexp_replace(ch.text, '[\\s\\p{{Z}}]+', ' ', 'g'), '^[^.!?]*')) as claim from f join e using (question_id) join ch on ch.chunk_id = f.passage_id),
r as (select *, row_number() over (partition by question_id order by score desc, fused_rank) as rank from s qualify rank <= 5),
b as (select question_id, max(score) as confidence, count(*) as n_sources, string_agg(claim || ' [' || rank || '].', ' ' order by rank) filter (where rank <= 2) as answer, min(passage_id) filter (where rank = 1) as best from r group by 1)
select e.question_id, coalesce(b.confidence, 0) as confidence, case when b.confidence >= 0.3 then 'confident' when b.confidence >= 0.15 then 'low_confidence' else 'insufficient' end as state, case when b.confidence >= 0.15 then b.answer end as answer, b.best as best_chunk,
case when b.confidence >= 0.15 then least(coalesce(n_sources, 0), 2) else 0 end as n_citations, coalesce(n_sources, 0) as n_sources from e left join b using (question_id)"""
)
def answers(spark: SparkSession, d: str) -> DataFrame:
    """All escalated questions answered in one plan: filtered hybrid search, rerank, confidence band, extractive answer, citation checks.

    Without a model the rerank score is the share of the question's words in the passage, and the answer consists of the leading claims of the two best passages. Below the floor there is no answer.
    """
    p = _passages(spark, d)
    asked = _asked(spark, d, p)
    f = _found(asked, p).select("question_id", "passage_id", "fused_rank").join(p.drop("doc_type"), "passage_id").join(asked.select("question_id", F.array_distinct(X.words("text")).alias("qw"), "tenant"), "question_id")
    claim = F.trim(F.regexp_extract(F.regexp_replace("text", r"[\s\p{Z}]+", " "), "^[^.!?]*", 0))
    scored = f.withColumn("score", F.round(F.size(F.array_intersect("qw", X.words("text"))) / F.size("qw"), 6)).select("question_id", "passage_id", "fused_rank", "score", claim.alias("claim"), "text", "tenant_id", "visibility", "owner_id", "tenant")
    scored = materialize(scored, "candidates")  # twenty a question
    key = [F.col("question_id").alias("query_id"), F.col("passage_id").alias("chunk_id")]
    top = search.rerank(scored.select(*key, "fused_rank"), scored.select(*key, F.col("score").alias("rerank_score")), 5).select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("passage_id"), F.col("new_rank").alias("marker"))
    r = top.join(scored, ["question_id", "passage_id"])
    lines = F.array_sort(F.collect_list(F.when(F.col("marker") <= 2, F.struct("marker", F.concat("claim", F.lit(" ["), "marker", F.lit("].")).alias("line")))))
    b = r.groupBy("question_id").agg(F.max("score").alias("confidence"), F.count(F.lit(1)).alias("n_sources"), F.array_join(F.transform(lines, lambda x: x["line"]), " ").alias("answer"), F.min_by("passage_id", "marker").alias("best_chunk"))
    said = b.withColumn("answer", F.when(F.col("confidence") >= 0.15, F.col("answer")))
    nobody = F.lit(None).cast("string")
    marks = C.supported(C.cited_passages(said.select("question_id", "answer"), "answer").join(r, ["question_id", "marker"]), "passage", "text").withColumn("accepted", F.col("supported") & C.may_cite(F.col("tenant_id"), F.col("visibility"), F.col("owner_id"), F.col("tenant"), nobody))
    cited = C.first_accepted(marks, ["question_id"], F.col("accepted")).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_citations"))
    out = asked.select("question_id").join(said, "question_id", "left").join(cited, "question_id", "left")
    return out.select("question_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), M.band("confidence").alias("state"), "answer", "best_chunk", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


# ---------------------------------------------------------------- listings
@query(f"select doc_id, chunk_id, row_number() over (partition by doc_id order by chunk_index nulls last, chunk_id) as position from {DISTINCT_CHUNKS} qualify position <= 1000")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand chunks of every document in their order, those without index last."""
    by = W.partitionBy("doc_id").orderBy(F.asc_nulls_last("chunk_index"), "chunk_id")
    return distinct_chunks(spark, d).select("doc_id", "chunk_id", F.row_number().over(by).cast("long").alias("position")).where("position <= 1000")


PARAMS = '{"max_tokens": 400, "overlap": 0}'


@query(
    f"""with o as (select doc_id, block_idx, text, coalesce(sum(length(text) + 2) over (partition by doc_id order by block_idx rows between unbounded preceding and 1 preceding), 0)::bigint as at, length(text) - length(ltrim(text)) as lead, page, coalesce(page_end, page) as page_stop from blocks),
k as (select *, trim(text) as t, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]') as toks from o where text is not null),
w as (select *, unnest(range(0, ceil(len(toks) / 400.0)::int)) as part from k where len(toks) > 0),
n as (select *, row_number() over (partition by doc_id order by block_idx, part) - 1 as idx from w),
h as (select n.*, sha1(unhex('{NAMESPACE}') || encode(doc_id || '|blocks|' || substring(sha1('{PARAMS}'), 1, 8) || '|' || idx)) as h from n)
select substring(h,1,8) || '-' || substring(h,9,4) || '-5' || substring(h,14,3) || '-' || substring('89ab', (instr('0123456789abcdef', substring(h,17,1)) - 1) % 4 + 1, 1) || substring(h,18,3) || '-' || substring(h,21,12) as chunk_id,
doc_id, idx::int as chunk_index, block_idx, page as page_start, page_stop, least(400, len(toks) - part * 400)::int as token_count, md5(array_to_string(toks[part * 400 + 1 : part * 400 + 400], ' ')) as tokens_md5 from h"""
)
def block_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every block as pieces of at most 400 tokens, none blank, numbered densely within its document, with ids from the parameters' digest."""
    return layout.block_pieces(table(spark, d, "blocks"), 400, NAMESPACE, PARAMS).withColumn("tokens_md5", F.md5(F.array_join("tokens", " "))).drop("tokens")


@query(
    r"""with b as (select doc_id, block_idx, page, kind, trim(text) as t, regexp_replace(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')), '[0-9]+', '#', 'g') as k from blocks where page is not null and text is not null),
n as (select doc_id, count(distinct page) as pages from b group by 1), r as (select doc_id, k, count(distinct page) as hits from b group by 1, 2)
select b.doc_id, b.block_idx, case when r.hits >= greatest(3, floor(0.4 * n.pages)) then 'running' else 'page_number' end as reason from b join n using (doc_id) join r using (doc_id, k)
where r.hits >= greatest(3, floor(0.4 * n.pages)) or regexp_matches(b.t, '(?i)^(page\s+)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$')"""
)
def stripped_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of paged documents that are running heads or feet (digits apart the same on many of its pages) or bare page numbers."""
    return layout.running_blocks(table(spark, d, "blocks"))


@query(
    f"""with e as (select id, passages from escalations), p as (select id, unnest(from_json(case when json_valid(passages) then passages end, '[{{"chunk_id": "VARCHAR"}}]')) as x, unnest(range(0, json_array_length(case when json_valid(passages) then passages end)::bigint)) as pos from e),
c as {DISTINCT_CHUNKS}, r as (select p.id, p.pos, c.chunk_id, c.source_file, c.page_start, c.page_end, lower(array_to_string(c.section_path, ' > ')) as path, lower(c.section_path[len(c.section_path)]) as section from p join c on c.chunk_id = p.x.chunk_id),
g as (select * from r where pos = 0), k as (select g.id, r.chunk_id, g.source_file = r.source_file and (g.page_start is null or coalesce(r.page_start <= g.page_end and r.page_end >= g.page_start, false)) and (g.section is null or contains(coalesce(r.path, ''), g.section)) as hit from g join r using (id) where r.pos > 0)
select id as escalation_id, count(*) as n_candidates, count(*) filter (where hit) as n_hits from k group by 1"""
)
def gold_hits(spark: SparkSession, d: str) -> DataFrame:
    """Cited passages against the first one as gold: same file, pages that meet, and the gold section in their path."""
    c = distinct_chunks(spark, d).select("chunk_id", "source_file", "page_start", "page_end", F.lower(F.array_join("section_path", " > ")).alias("path"), F.lower(F.try_element_at("section_path", F.lit(-1))).alias("section"))
    p = table(spark, d, "escalations").select("id", F.posexplode(F.from_json("passages", "array<struct<chunk_id: string>>")).alias("pos", "x")).select("id", "pos", F.col("x.chunk_id").alias("chunk_id"))
    r = p.join(c, "chunk_id")
    g = r.where("pos = 0").select("id", F.struct("source_file", "page_start", "page_end", "section").alias("g"))
    hit = search.is_hit(*(F.col(k) for k in ("source_file", "page_start", "page_end", "path")), *(F.col(f"g.{k}") for k in ("source_file", "page_start", "page_end", "section")))
    return r.where("pos > 0").join(g, "id").groupBy(F.col("id").alias("escalation_id")).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(hit).alias("n_hits"))


@query(
    f"""with c as {DISTINCT_CHUNKS}, m as (select chunk_id, doc_id, text, instr(lower(text), 'beneficial owner') as p from c where contains(lower(text), 'beneficial owner')),
n as (select *, row_number() over (order by chunk_id) as k from m), cut as (select max(chunk_id) as last from n where k <= 25)
select chunk_id, doc_id, case when p > 61 then '...' else '' end || substring(text, greatest(p - 60, 1)::int, (least(p + 16 + 60 - 1, length(text)) - greatest(p - 60, 1) + 1)::int) || case when p + 16 + 60 - 1 < length(text) then '...' else '' end as excerpt,
(select count(*) from m) >= 25 and exists (select 1 from c, cut where c.chunk_id > cut.last) as truncated from n where k <= 25"""
)
def erasure_report(spark: SparkSession, d: str) -> DataFrame:
    """What an erasure run of at most 25 chunks would take for a subject, with excerpts; truncated when chunks remain unseen after the last."""
    c = distinct_chunks(spark, d).select("chunk_id", "doc_id", "text")
    taken = c.where(F.contains(F.lower("text"), F.lit("beneficial owner"))).orderBy("chunk_id").limit(25)  # a top-k report
    last = taken.agg(F.max("chunk_id").alias("last"), F.count(F.lit(1)).alias("n"))
    unseen = c.agg(F.max("chunk_id").alias("top")).join(last).select(((F.col("n") >= 25) & (F.col("top") > F.col("last"))).alias("truncated"))
    return taken.select("chunk_id", "doc_id", X.around("text", "beneficial owner").alias("excerpt")).join(unseen)


@query(
    f"""with c as {DISTINCT_CHUNKS} select doc_id, count(*) as n_chunks, count(*) filter (where contains(lower(text), 'beneficial owner')) as n_erased, count(*) filter (where not contains(lower(text), 'beneficial owner')) as n_left from c where text is not null group by 1 having n_erased > 0"""
)
def erasure_effect(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every touched document before and after the deletion of those that name a subject."""
    c = distinct_chunks(spark, d).where("text is not null").select("doc_id", "chunk_id", F.contains(F.lower("text"), F.lit("beneficial owner")).alias("named"))
    left = search.without(c, c.where("named"), "chunk_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_left"))
    n = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("named").alias("n_erased")).where("n_erased > 0")
    return n.join(left, "doc_id", "left").select("doc_id", "n_chunks", "n_erased", F.coalesce("n_left", F.lit(0)).alias("n_left"))


@query(
    """with a as (select user_id, json_extract_string(props, '$.k') as k, max(ts) as last_ts, max(event_id) as last_id from events group by 1, 2), n as (select max(ts) as now from events)
select user_id, k from a, n where last_ts > now - interval 3 day qualify row_number() over (partition by user_id order by last_ts desc, last_id desc, k) <= 5"""
)
def ttl_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Keys a cache of five entries a user and three days' life would still hold."""
    e = table(spark, d, "events")
    a = e.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.max("ts").alias("last_ts"), F.max("event_id").alias("last_id"))
    fresh = a.join(e.agg(F.max("ts").alias("now"))).where("last_ts > now - interval 3 days")
    return fresh.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last_ts"), F.desc("last_id"), "k"))).where("r <= 5").select("user_id", "k")


@query(
    r"""with q as (select id, created_at, trim(regexp_replace(lower(question), '[\s\p{Z}]+', ' ', 'g')) as k from escalations where question is not null),
w as (select id, created_at, k, list_distinct(regexp_extract_all(k, '[\p{L}\p{N}_]+')) as ws from q), x as (select id, created_at, k, unnest(ws) as w, len(ws) as n from w),
p as (select a.id, b.id as other, any_value(a.k = b.k) as is_same, count(*) / sqrt(any_value(a.n) * any_value(b.n)) as similarity, any_value(b.created_at) as asked_at from x a join x b on a.w = b.w and (b.created_at, b.id) < (a.created_at, a.id) and a.created_at - b.created_at <= interval 7 day where a.id % 100 = 0 group by 1, 2),
b as (select *, row_number() over (partition by id order by is_same desc, round(similarity, 6) desc, asked_at, other) as r from p)
select q.id as escalation_id, case when b.is_same then 'exact' when b.similarity >= 0.6 then 'semantic' else 'miss' end as tier, case when b.is_same or b.similarity >= 0.6 then b.other end as answered_by from q left join b on b.id = q.id and b.r = 1 where q.id % 100 = 0"""
)
def response_cache(spark: SparkSession, d: str) -> DataFrame:
    """Both tiers of a response cache for the questions whose id is divisible by 100: the same words, else the most similar earlier question of seven days."""
    q = table(spark, d, "escalations").where("question is not null").select("id", F.col("created_at").cast("timestamp").alias("at"), X.question_key("question").alias("k"))
    return search.cached_answers(q.where("id % 100 = 0"), q, 0.6, 7 * 86_400_000_000).withColumnRenamed("id", "escalation_id")


@query(
    f"""with c as {DISTINCT_CHUNKS}, h as {HITS}, r as (select h.query_id, c.chunker, h.dense_score >= 0.9 as good, row_number() over (partition by h.query_id, c.chunker order by h.fused_score desc nulls last, h.chunk_id) as rank from h join c using (chunk_id)),
f as (select query_id, chunker, min(case when good then rank end) as first from r group by 1, 2), q as (select chunker, count(*) as n_queries, round(avg(case when first <= 5 then 1.0 else 0.0 end), 4) as hit_at_k, round(avg(coalesce(1.0 / first, 0.0)), 4) as mrr from f group by 1)
select s.chunker, s.n_chunks, s.tokens_mean, q.n_queries, q.hit_at_k, q.mrr from (select chunker, count(*) as n_chunks, round(avg(token_count), 4) as tokens_mean from c group by 1) s left join q on q.chunker is not distinct from s.chunker"""
)
def compare_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Chunkers side by side: chunks, their size, and retrieval quality of the queries that met them."""
    c = distinct_chunks(spark, d).select("chunk_id", "chunker", "token_count")
    by = W.partitionBy("query_id", "chunker").orderBy(F.desc_nulls_last("fused_score"), "chunk_id")
    r = hits(spark, d).join(c, "chunk_id").select("query_id", "chunker", (F.col("dense_score") >= 0.9).alias("good"), F.row_number().over(by).alias("rank"))
    q = aggregates.ranking_quality(r, "query_id", "rank", "good", 5, by=["chunker"]).withColumnRenamed("n", "n_queries")
    s = c.groupBy("chunker").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("token_count"), 4).alias("tokens_mean"))
    return s.alias("s").join(q.alias("q"), F.expr("s.chunker <=> q.chunker"), "left").select("s.*", "q.n_queries", "q.hit_at_k", "q.mrr")


@query(
    f"""with c as {DISTINCT_CHUNKS}, p as (select id, note, unnest(json_extract_string(case when json_valid(passages) then passages end, '$[*].chunk_id')) as chunk_id from escalations where note is not null),
t as (select p.id, any_value(list_distinct(list_filter(string_split_regex(lower(p.note), '\\s+'), lambda x: x <> ''))) as a, list_distinct(flatten(list(list_filter(string_split_regex(lower(c.text), '\\s+'), lambda x: x <> '')))) as k from p join c using (chunk_id) where c.text is not null group by 1)
select id as escalation_id, round(len(list_intersect(a, k)) / nullif(len(a), 0), 6) as faithfulness from t"""
)
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Share of a note's words that its cited passages contain."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    p = table(spark, d, "escalations").where("note is not null").select("id", "note", F.explode(F.from_json("passages", "array<struct<chunk_id: string>>")).alias("p")).select("id", "note", F.col("p.chunk_id").alias("chunk_id"))
    c = distinct_chunks(spark, d).where("text is not null").select("chunk_id", F.array_intersect(bag("text"), bag("text")).alias("ws"))
    t = p.join(c, "chunk_id").groupBy("id", "note").agg(F.flatten(F.collect_list("ws")).alias("k"))  # a few passages a note
    return t.select(F.col("id").alias("escalation_id"), F.round(F.size(F.array_intersect(bag("note"), F.array_distinct("k"))) / F.nullif(F.size(bag("note")), F.lit(0)), 6).alias("faithfulness"))


CALLERS = [("member", "tn_01", "user_272", False), ("nobody", None, None, False), ("admin", "tn_02", "root", True)]


@query(
    """with c(who, ct, cu, adm) as (values ('member', 'tn_01', 'user_272', false), ('nobody', null, null, false), ('admin', 'tn_02', 'root', true)),
x as (select doc_id, who, coalesce(tenant_id, 'global') as t, coalesce(visibility, 'tenant') as v, owner_id is not null and not coalesce(owner_id = cu, false) as other, coalesce(ct, 'global') as ct, adm from documents, c)
select doc_id, who, case when t = 'global' and v = 'public' then 'allow' when not adm and t <> ct then 'other_tenant' when not adm and v = 'private' and other then 'not_owner' else 'allow' end as read_access,
case when t = 'global' and v = 'public' then case when adm then 'allow' else 'read_only' end when not adm and t <> ct then 'other_tenant' when not adm and other then 'not_owner' else 'allow' end as modify_access from x"""
)
def authorizations(spark: SparkSession, d: str) -> DataFrame:
    """What a member of a tenant, a caller without tenant and an administrator may do with every document."""
    who = F.explode(F.array(*(F.struct(F.lit(n).alias("who"), F.lit(t).cast("string").alias("ct"), F.lit(u).cast("string").alias("cu"), F.lit(a).alias("adm")) for n, t, u, a in CALLERS))).alias("c")
    x = table(spark, d, "documents").select("doc_id", "tenant_id", "visibility", "owner_id", who)
    say = lambda a: search.authorize(a, *(F.col(k) for k in ("tenant_id", "visibility", "owner_id", "c.ct", "c.cu", "c.adm")))
    return x.select("doc_id", F.col("c.who").alias("who"), say("read").alias("read_access"), say("modify").alias("modify_access"))


@query(
    """select doc_id, title, doc_type, jurisdiction from documents where (contains(lower(title), 'policy') or contains(lower(source_file), 'policy')) and status = 'indexed'
and coalesce(tenant_id, 'global') in ('tn_01', 'global') and (coalesce(visibility, 'tenant') in ('tenant', 'public') or coalesce(owner_id = 'user_272', false)) order by jurisdiction asc nulls last, doc_id limit 30 offset 3"""
)
def registry_search(spark: SparkSession, d: str) -> DataFrame:
    """A page of a tenant member's registry search, sorted by jurisdiction."""
    page = search.registry(table(spark, d, "documents"), "Policy", "tn_01", "user_272", "jurisdiction", "asc", 30, 3, doc_type="", status="indexed")
    return page.select("doc_id", "title", "doc_type", "jurisdiction")


@query(
    f"""with c as (select embed_h as h, max(text) as text from {DISTINCT_CHUNKS} where embed_h is not null and text is not null group by 1), e as (select distinct h from emb where len(vec) > 0 and h is not null)
select c.h, e.h is not null as cached, case when e.h is null then len(list_distinct(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: ('0x' || substring(md5(w), 1, 4))::int % 256))) end as n_places from c left join e on e.h = c.h"""
)
def filled_cache(spark: SparkSession, d: str) -> DataFrame:
    """The vector cache after a run: texts found in it, and the others with the hashed vector computed for them (once a text; here its number of places used)."""
    c = distinct_chunks(spark, d).where("embed_h is not null and text is not null").groupBy(F.col("embed_h").alias("h")).agg(F.max("text").alias("text"))
    e = table(spark, d, "emb").where("size(vec) > 0 and h is not null").select("h").distinct()
    missing = search.without(c, e, "h")
    place = F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("int") % 256
    computed = missing.select("h", F.explode(X.words("text")).alias("w")).select("h", place.alias("place")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_places"))
    return c.select("h").join(e.withColumn("hit", F.lit(True)), "h", "left").join(computed, "h", "left").select("h", F.coalesce("hit", F.lit(False)).alias("cached"), F.when(F.col("hit").isNull(), F.coalesce("n_places", F.lit(0))).alias("n_places"))


@query(
    r"""with l as (select doc_id, status, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest, row_number() over (partition by doc_id order by snapshot_at desc, received_at desc nulls last, snap_id desc) as r from registry_snapshots where status <> 'failed'),
m as (select doc_id, status, digest from l where r = 1), d as (select doc_id, nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\s*', ''), '') as digest, text from documents),
a as (select coalesce(d.doc_id, m.doc_id) as doc_id, case when d.doc_id is null then 'prune' when m.doc_id is null or m.status = 'deleted' then 'new' when m.digest = d.digest then 'skip' else 'changed' end as action from d full join m on d.doc_id = m.doc_id),
k as (select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) as n from documents)
select a.action, count(*) as n_documents, coalesce(sum(case when action in ('new', 'changed') then greatest(ceil((n - 400) / 352.0), 0) + (n > 0)::int end), 0)::bigint as n_chunks, coalesce(sum(case when action in ('new', 'changed') then n end), 0)::bigint as n_tokens from a left join k using (doc_id) group by 1"""
)
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest run does: documents by action, and the windows and tokens that those taken in give."""
    from quarryline.plans import governance

    acts = governance.manifest_actions(spark, d)
    docs = table(spark, d, "documents").select("doc_id", X.token_count("text").alias("n"))
    taken = F.col("action").isin("new", "changed")
    chunks = F.greatest(F.ceil((F.col("n") - 400) / 352), F.lit(0)) + (F.col("n") > 0).cast("int")
    return acts.join(docs, "doc_id", "left").groupBy("action").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum(F.when(taken, chunks)), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.sum(F.when(taken, F.col("n"))), F.lit(0)).cast("long").alias("n_tokens"))


@query(
    f"""with c as {DISTINCT_CHUNKS}, g as (select id, status, json_extract_string(case when json_valid(passages) then passages end, '$[0].chunk_id') as chunk_id from escalations),
l as (select g.id, case when g.status = 'open' then 'answer' else coalesce(g.status, 'answer') end as expected_behavior, c.source_file, c.page_start, c.section_path[len(c.section_path)] as section from g left join c using (chunk_id))
select id as escalation_id, source_file, page_start, section from l where expected_behavior = 'answer' and source_file is not null and (page_start is not null or section is not null)"""
)
def labelled_questions(spark: SparkSession, d: str) -> DataFrame:
    """Open questions that name a source and a page or section: those that can be scored."""
    c = distinct_chunks(spark, d).select("chunk_id", "source_file", "page_start", F.try_element_at("section_path", F.lit(-1)).alias("section"))
    first = F.get(F.from_json("passages", "array<struct<chunk_id: string>>"), F.lit(0))["chunk_id"]
    g = table(spark, d, "escalations").where(F.coalesce(F.col("status"), F.lit("open")).isin("open", "answer")).select(F.col("id").alias("escalation_id"), first.alias("chunk_id"))
    return g.join(c, "chunk_id").where("source_file is not null and (page_start is not null or section is not null)").select("escalation_id", "source_file", "page_start", "section")


@query(
    f"""with c as (select doc_id, substring(sha1(to_json({{'chunker': chunker, 'chunker_params': chunker_params, 'embedding_model': embedding_model}})), 1, 12) as signature from {DISTINCT_CHUNKS} where doc_id is not null),
w as (select signature from c group by 1 order by count(*) desc, signature limit 1)
select c.doc_id, count(distinct c.signature) as n_signatures, bool_and(c.signature = w.signature) as is_current from c, w group by 1"""
)
def stale_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose chunks were made with other settings (chunker, parameters, model) than most chunks: an unchanged digest alone must not let an ingest skip them."""
    c = distinct_chunks(spark, d).where("doc_id is not null").select("doc_id", X.signature("chunker", "chunker_params", "embedding_model").alias("signature"))
    wanted = c.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(1).select(F.col("signature").alias("wanted"))
    return c.join(F.broadcast(wanted)).groupBy("doc_id").agg(F.count_distinct("signature").alias("n_signatures"), F.bool_and(F.col("signature") == F.col("wanted")).alias("is_current"))


@query(
    r"""with b as (select doc_id, block_idx, trim(text) as t, regexp_extract(text, '^\s*(\d+(?:\.\d+)*)\.?\s', 1) as number from blocks where text is not null)
select doc_id, block_idx, case when number <> '' then least(len(number) - len(replace(number, '.', '')) + 1, 6)::int end as depth, regexp_matches(t, '(?i)^(page\s+)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$') as is_page_number from b"""
)
def numbered_headings(spark: SparkSession, d: str) -> DataFrame:
    """Depth by the numbering a block begins with, and whether it is a page number alone."""
    b = table(spark, d, "blocks").where("text is not null")
    return b.select("doc_id", "block_idx", X.heading_depth("text").alias("depth"), X.is_page_number("text").alias("is_page_number"))


@query(
    """select distinct chunk_id, coalesce(try_cast(json_extract_string(case when json_valid(chunker_params) then chunker_params end, '$.max_tokens') as int), 400) as max_tokens, chunker_params is not null and not json_valid(chunker_params) as broken from chunks"""
)
def chunker_settings(spark: SparkSession, d: str) -> DataFrame:
    """The limit in a chunk's parameters, 400 where they are missing or broken."""
    c = table(spark, d, "chunks").select("chunk_id", "chunker_params")
    valid = F.from_json("chunker_params", "map<string, string>")
    return c.select("chunk_id", F.coalesce(F.get_json_object("chunker_params", "$.max_tokens").try_cast("int"), F.lit(400)).alias("max_tokens"), (F.col("chunker_params").isNotNull() & valid.isNull()).alias("broken")).distinct()


@query("""select event_id, user_id, ts from events where (starts_with(event_type, 'p') or event_type = 'error') and user_id is not null""")
def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the stages looked at: a common prefix of their type, or one type besides, and somebody to trace them to."""
    return table(spark, d, "events").where((F.col("event_type").startswith("p") | (F.col("event_type") == "error")) & F.col("user_id").isNotNull()).select("event_id", "user_id", "ts")
