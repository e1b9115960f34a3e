"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import graph, mixing, neardup, packing, pii, splitting, tokens, truncation, vectors
from quarryline.operators import search
from quarryline.session import materialize, table

# ---------------------------------------------------------------- 1 oversized blocks and chunks
P1 = {"limit": 400, "overlap": 40, "least": 120}


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 400 tokens of every block and distinct chunk above the limit."""
    return splitting.split_blocks_and_chunks(table(spark, d, "blocks"), table(spark, d, "chunks"), **P1)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every block and distinct chunk that had to be split."""
    return p1_pieces(spark, d).where("piece_index = 0 and n_pieces > 1").select("item_kind", "item_key")


# ---------------------------------------------------------------- 2 personal data
#: Key of the test tables; real data need one of their own in ``spark.quarryline.pseudonym.key``.
TEST_KEY = "key of the test tables"


def _free_texts(spark: SparkSession, d: str) -> DataFrame:
    return pii.free_texts(table(spark, d, "chunks"), table(spark, d, "feedback"), table(spark, d, "escalations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per mention of personal data in chunk texts, feedback comments and escalation notes."""
    return pii.find_mentions(_free_texts(spark, d), table(spark, d, "known_names")).select("tbl", "row_key", "pii_kind", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts, each once per key, with typed placeholders for the mentions and the rest unchanged."""
    key = spark.conf.get("spark.quarryline.pseudonym.key", TEST_KEY)
    return pii.redact(_free_texts(spark, d), table(spark, d, "known_names"), key.encode()).distinct()


def p2_contains_pii(spark: SparkSession, d: str) -> DataFrame:
    """Per document with chunks or a classification: contains_pii as set by hand and as found in its chunks."""
    chunks = table(spark, d, "chunks")
    hits = pii.find_mentions(chunks.select(F.lit("chunks").alias("tbl"), F.col("doc_id").alias("row_key"), "text"), table(spark, d, "known_names"))
    found = hits.select(F.col("row_key").cast("long").alias("doc_id"), F.lit(1).alias("found")).distinct()
    stored = table(spark, d, "document_classification").select("doc_id", F.col("contains_pii").alias("stored"))
    docs = chunks.select("doc_id").where("doc_id is not null").distinct()
    return docs.join(stored, "doc_id", "full").join(found, "doc_id", "left").select("doc_id", "stored", F.coalesce("found", F.lit(0)).alias("contains_pii"))


# ---------------------------------------------------------------- 4 most similar vectors
P4 = {"k": 5, "floor": 0.9}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of usable vectors of one model with a cosine of at least 0.90, one among the other's 5 most similar."""
    hits = vectors.nearest(table(spark, d, "emb"), "vec_id", "model", "vec", **P4)
    return hits.select(F.least("query_id", "vec_id").alias("vec_id_a"), F.greatest("query_id", "vec_id").alias("vec_id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other vectors of every usable vector with their dense_score, whatever it is."""
    hits = vectors.nearest(table(spark, d, "emb"), "vec_id", "model", "vec", k=P4["k"])
    return hits.select("model", F.col("query_id").alias("query_vec_id"), "hit_rank", "vec_id", F.col("cosine").alias("dense_score"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index per model: vectors whose id is divisible by 100 against an exact search over all vectors."""
    emb = table(spark, d, "emb")
    v = vectors.usable_vectors(emb, "vec_id", "model", "vec").select(F.col("model").alias("group"), F.col("vec_id").alias("id"), "vec")
    exact = search.dense_topk(v.where("id % 100 = 0"), v, P4["k"]).where(F.col("score") >= P4["floor"]).select(F.col("group").alias("model"), "query_id", F.col("id").alias("vec_id"))
    found = vectors.nearest(emb, "vec_id", "model", "vec", **P4).select("model", "query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["model", "query_id", "vec_id"], "left").groupBy("model").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


# ---------------------------------------------------------------- 5 near-duplicate chunks
P5 = {"width": 3, "threshold": 0.6, "min_words": 30}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunk ids whose texts share at least 0.6 of their runs of three words."""
    members, links = neardup.similar_pairs(table(spark, d, "chunks"), "chunk_id", "text", **P5)
    return neardup.expand_pairs(members, links).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk id of a group: its class and how many different texts its text is linked to."""
    members, links = neardup.similar_pairs(table(spark, d, "chunks"), "chunk_id", "text", **P5)
    links = materialize(links, "links")
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
    classes = graph.connected_classes(links).withColumnRenamed("id", "rep")
    return (
        members.join(copies, "rep")
        .join(classes, "rep", "left")
        .join(degree, "rep", "left")
        .where("n_copies > 1 or class_id is not null")
        .select(F.col("id").alias("chunk_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    )


# ---------------------------------------------------------------- 6 containers
CAPACITY = 2048


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, written once: everything after them reads a few bytes a document."""
    return materialize(tokens.count_tokens(table(spark, d, "documents"), "text", {"doc_id": "long", "source": "string"}), "tokens")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of a document above 2,048 tokens."""
    packed = packing.pack(_doc_tokens(spark, d), "doc_id", "n_tokens", CAPACITY)
    return packed.select(F.col("id").alias("doc_id"), "piece", "token_start", F.col("size").alias("n_tokens"), "container")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Pieces, tokens and fill of every container."""
    return packing.fill(packing.pack(_doc_tokens(spark, d), "doc_id", "n_tokens", CAPACITY), CAPACITY)


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row on the containers: documents placed, pieces placed twice, containers above capacity, documents divided although they fit."""
    p = materialize(packing.pack(_doc_tokens(spark, d), "doc_id", "n_tokens", CAPACITY), "packed")
    docs = p.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("k"), F.sum("size").alias("tokens"))
    bins = packing.fill(p, CAPACITY).agg(F.count_if(F.col("n_tokens") > CAPACITY).alias("n_overfull"))
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n") > F.col("k")).alias("n_twice"), F.count_if((F.col("k") > 1) & (F.col("tokens") <= CAPACITY)).alias("n_divided_small")).join(bins)


# ---------------------------------------------------------------- 7 mixture
def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mixing.mix(_doc_tokens(spark, d), table(spark, d, "mix_targets"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of a targeted source comes in the scheduled sequence."""
    texts, _, order = _mixture(spark, d)
    each = mixing.sequence(texts, order)
    return each.groupBy("source", "start", "id", "n_tokens").agg(F.count("slot").cast("int").alias("uses")).select(F.col("id").alias("doc_id"), "source", "n_tokens", "uses")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    return _mixture(spark, d)[1]


def p7_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the order in which the sources are interleaved."""
    texts, _, order = _mixture(spark, d)
    return mixing.sequence(texts, order).where("slot is not null").drop("start").withColumnRenamed("id", "doc_id")


def p7_lags(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the sequence: how far it ever is ahead of or behind its share, in blocks, and blocks outside their window (none)."""
    return mixing.lags(_mixture(spark, d)[2])


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts held, whether repeats keep their cap, whether the share is the target's to 1 % or all is used, and whether the sequence stays within a block."""
    texts, report, order = _mixture(spark, d)
    held = texts.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"))
    lag = mixing.lags(order).select("source", ((F.col("most_ahead") < 1) & (F.col("most_behind") < 1) & (F.col("n_outside") == 0)).alias("steady"))
    r = report.join(held, "source", "left").join(lag, "source", "left")
    all_used = F.col("used_tokens") >= F.col("held_tokens") * F.col("max_repeats")
    # what sources without enough text cannot give goes to the others by their shares, so these may be above their targets
    enough = all_used | (F.col("actual_share") >= F.col("target_share") * 0.99)
    return r.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), enough.alias("share_or_all_used"), F.coalesce("steady", F.lit(True)).alias("within_a_block"))


# ---------------------------------------------------------------- 8 texts cut off
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text does not reach its original end."""
    return truncation.cut_texts(table(spark, d, "documents")).where("is_cut").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, cut documents by kind of evidence, and the share that is cut."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return (
        truncation.cut_texts(table(spark, d, "documents"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), n("is_cut").alias("n_cut"), n("by_copy").alias("n_by_copy"), n("by_limit").alias("n_by_limit"), n("by_closing").alias("n_by_closing"))
        .withColumn("cut_share", F.col("n_cut") / F.col("n_docs"))
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_redacted": p2_redacted, "p2_contains_pii": p2_contains_pii, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_sequence": p7_sequence, "p7_lags": p7_lags, "p7_audit": p7_audit, "p6_audit": p6_audit, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall, "p5_found": p5_found, "p5_groups": p5_groups, "p8_found": p8_found, "p8_sources": p8_sources}


#: Brute force, or what must hold whatever the tokenizer counts.
SQL = {
    "p1_found": r"""with c as (select chunk_id, text from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last) = 1),
i as (select 'block' as item_kind, doc_id || '#' || block_idx as item_key, text from blocks union all select 'chunk', chunk_id, text from c)
select item_kind, item_key from i where len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) > 400""",
    "p4_found": """with v as (select vec_id, model, list_transform(vec, lambda x: x::double) as vec from emb where len(vec) = case model when 'hash-64' then 64 when 'mini-96' then 96 end and list_sum(list_transform(vec, lambda x: abs(x))) > 0),
s as (select a.model, a.vec_id as q, b.vec_id as o, list_cosine_similarity(a.vec, b.vec) as score from v a join v b on a.model = b.model and a.vec_id <> b.vec_id),
t as (select q, o, score from s qualify row_number() over (partition by model, q order by score desc, o) <= 5)
select distinct least(q, o) as vec_id_a, greatest(q, o) as vec_id_b from t where score >= 0.9""",
    "p5_found": r"""with t as (select distinct chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as ws from chunks where chunk_id is not null and text is not null),
n as (select row_number() over () as k, chunk_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from t where len(ws) >= 30),
e as (select k, chunk_id, len(g) as m, unnest(g) as s from n),
p as (select a.k, b.k as k2, any_value(a.chunk_id) as x, any_value(b.chunk_id) as y, any_value(a.m) as m, any_value(b.m) as m2, count(*) as common from e a join e b on a.s = b.s and a.chunk_id < b.chunk_id group by 1, 2)
select distinct x as chunk_id_a, y as chunk_id_b from p where common >= 0.6 * (m + m2 - common)""",
    "p5_groups": r"""with recursive t as (select distinct chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as ws from chunks where chunk_id is not null and text is not null),
m as (select chunk_id, array_to_string(ws, ' ') as seq, min(chunk_id) over (partition by array_to_string(ws, ' ')) as rep, count(*) over (partition by array_to_string(ws, ' ')) as n_copies from t where len(ws) >= 30),
n as (select rep, list_distinct(list_transform(range(1, len(string_split(seq, ' ')) - 1), lambda i: string_split(seq, ' ')[i] || ' ' || string_split(seq, ' ')[i + 1] || ' ' || string_split(seq, ' ')[i + 2])) as g from (select distinct rep, seq from m)),
e as (select rep, len(g) as k, unnest(g) as s from n),
p as (select a.rep as a, b.rep as b from e a join e b on a.s = b.s and a.rep <> b.rep group by 1, 2, a.k, b.k having count(*) >= 0.6 * (a.k + b.k - count(*))),
r as (select a as x, a as y from p union select r.x, p.b from r join p on p.a = r.y),
k as (select x as rep, min(y) as class_id from r group by 1), l as (select a as rep, count(*) as n_links from p group by 1)
select m.chunk_id, coalesce(k.class_id, m.rep) as class_id, coalesce(l.n_links, 0) as n_links, m.n_copies from m left join k using (rep) left join l using (rep) where m.n_copies > 1 or k.class_id is not null""",
    "p6_audit": """select count(*) as n_documents, 0::bigint as n_twice, 0::bigint as n_overfull, 0::bigint as n_divided_small from documents where text <> ''""",
    "p7_audit": """with t as (select source, sum(greatest(coalesce(target_share, 0), 0)) as target_share, max(coalesce(max_repeats, 1)) as max_repeats from mix_targets where source is not null group by 1),
d as (select source, count(*) as n from documents where text <> '' group by 1)
select t.source, round(t.target_share, 6) as target_share, t.max_repeats, coalesce(d.n, 0) as n_texts, true as within_repeats, true as share_or_all_used, true as within_a_block from t left join d using (source)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
