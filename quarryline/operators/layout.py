"""Documents as blocks, sections and token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as X


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Adds char_start and char_end of each block in the text its document's blocks form, joined by a blank line."""
    before = F.sum(F.length("text") + 2).over(W.partitionBy("doc_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length("text"))


def section_paths(blocks: DataFrame, deepest: int = 16) -> DataFrame:
    """Adds section_path: the headings open at each block, outermost first.

    A heading closes those of its level and deeper; levels below ``deepest`` count as it. One running window a level carries its last heading; a heading still open is one
    with no later heading of its level or above, so nothing is collected per document.
    """
    order = W.partitionBy("doc_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, 0)
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(deepest))
    head = F.col("kind") == "heading"
    df = blocks.withColumn("_l", F.when(head, level))
    seen = {n: F.last(F.when(F.col("_l") == n, F.struct(F.col("block_idx").alias("at"), F.col("text").alias("text"))), ignorenulls=True).over(order) for n in range(1, deepest + 1)}
    above = {n: F.max(F.when(F.col("_l") <= n, F.col("block_idx"))).over(order) for n in range(1, deepest + 1)}
    df = df.withColumns({f"_s{n}": c for n, c in seen.items()} | {f"_a{n}": c for n, c in above.items()})
    parts = [F.when(F.col(f"_s{n}.at") >= F.col(f"_a{n}"), F.col(f"_s{n}.text")) for n in range(1, deepest + 1)]
    path = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return df.withColumn("section_path", path).select(*blocks.columns, "section_path")


def fixed_windows(docs: DataFrame, most: int = 400, overlap: float = 0.12) -> DataFrame:
    """(doc_id, chunk_index, token_start, token_count, tokens): token windows with overlap; the last one reaches the end."""
    step = max(1, most - int(most * overlap))
    tok = docs.select("doc_id", X.tokens("text").alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.ceil((F.size("all") - most) / F.lit(step)), F.lit(0)).cast("int")
    # sliced before they are exploded, so that no window carries the whole text
    cut = lambda k: F.struct(k.alias("chunk_index"), (k * step).alias("token_start"), F.least(F.lit(most), F.size("all") - k * step).alias("token_count"), F.slice("all", k * step + 1, most).alias("tokens"))
    return tok.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), cut)).alias("w")).select("doc_id", "w.*")


def running_blocks(blocks: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """(doc_id, block_idx, reason) of blocks of paged documents to be stripped: texts that, digits apart, are on ``share`` of the document's pages (and ``least``), and bare page numbers."""
    b = blocks.where("page is not null and text is not null").select("doc_id", "block_idx", "page", F.trim("text").alias("t"), F.regexp_replace(X.squeeze(F.lower("text")), "[0-9]+", "#").alias("k"))
    pages = b.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = b.select("doc_id", "k", "page").distinct().groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("hits"))
    running = F.col("hits") >= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("pages")))
    return b.join(pages, "doc_id").join(seen, ["doc_id", "k"]).where(running | X.is_page_number("t")).select("doc_id", "block_idx", F.when(running, "running").otherwise("page_number").alias("reason"))


def block_pieces(blocks: DataFrame, most: int, namespace: str, params: str) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, block_idx, page_start, page_stop, token_count, tokens): blocks cut into windows of ``most`` tokens without overlap.

    Blank blocks give nothing; the index is dense within the document; the id is made of document, digest of the parameters and index.
    """
    tok = blocks.select("doc_id", "block_idx", "page", F.coalesce("page_end", "page").alias("page_stop"), X.tokens("text").alias("all")).where(F.size("all") > 0)
    cut = lambda k: F.struct(k.alias("part"), F.slice("all", k * most + 1, most).alias("tokens"))
    each = tok.select("doc_id", "block_idx", "page", "page_stop", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / most).cast("int")), cut)).alias("w")).select("*", "w.*")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("block_idx", "part")) - 1
    name = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("blocks"), F.substring(F.sha1(F.lit(params)), 1, 8), F.col("chunk_index").cast("string"))
    return each.withColumn("chunk_index", index).select(X.uuid5(namespace, name).alias("chunk_id"), "doc_id", "chunk_index", "block_idx", F.col("page").alias("page_start"), "page_stop", F.size("tokens").alias("token_count"), "tokens")


def block_at(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, point, block_idx): the last block that starts at or before each position; one sorted sweep a document, no range join."""
    b = block_offsets(blocks).select("doc_id", F.col("char_start").alias("point"), F.col("block_idx"), F.lit(0).alias("kind"))
    p = points.select("doc_id", F.col("point").cast("long").alias("point"), F.lit(None).cast("int").alias("block_idx"), F.lit(1).alias("kind"))
    order = W.partitionBy("doc_id").orderBy("point", "kind", "block_idx").rowsBetween(W.unboundedPreceding, 0)
    found = b.unionByName(p).withColumn("at", F.last("block_idx", ignorenulls=True).over(order))
    return found.where("kind = 1").select("doc_id", "point", F.col("at").alias("block_idx"))


def overlaps(chunks: DataFrame) -> DataFrame:
    """Adds the characters each chunk shares with the one before it in its document and chunker."""
    order = W.partitionBy("doc_id", "chunker").orderBy("chunk_index", "chunk_id")
    shared = F.greatest(F.lag("char_end").over(order) - F.col("char_start"), F.lit(0))
    return chunks.withColumn("overlap", F.coalesce(shared, F.lit(0))).withColumn("is_first", F.lag("chunk_id").over(order).isNull())


_TOKENS = re.compile(r"\w+|[^\w\s]")


def _windows(text: str, n: int, most: int) -> list[tuple[int, int, str]]:
    """(first token, tokens, text) of a text of ``n`` tokens: whole within ``most``, else windows of as many."""
    if n <= most:
        return [(0, n, text.strip())] if n else []
    spans = [m.span() for m in _TOKENS.finditer(text)]
    return [(i, min(most, n - i), text[spans[i][0] : spans[min(i + most, len(spans)) - 1][1]] if i < len(spans) else "") for i in range(0, n, most)]


def _pieces(text: str, n: int, most: int, sentences: list) -> list[tuple[int, int, str]]:
    """(first token, tokens, text) of the pieces of a text of ``n`` tokens: whole, else its sentences (tokens, text), of these the oversized by windows of ``most``."""
    if n <= most:
        return _windows(text, n, most)
    out, at = [], 0
    for k, sentence in ((x["n"], x["text"]) for x in sentences):
        out += [(at + i, size, piece) for i, size, piece in _windows(sentence, k, most)]
        at += k
    return out


def pack_sections(blocks: DataFrame, most: int = 400, least: int = 60) -> DataFrame:
    """(doc_id, chunk_index, section_path, first_block, last_block, first_token, end_token, token_count, text): blocks packed within sections up to ``most`` tokens.

    A section goes from a heading to the next; those without body are dropped. Sections below ``least`` tokens join the next of the same
    parent until they are not, whose heading stays inline; the path is the first one's. A block above ``most`` is packed by sentences, a sentence above it by windows of
    ``most``. A chunk begins at ``first_token`` of its first block and ends before ``end_token`` of its last; its text has a blank between pieces of a block and a blank line between blocks.
    The greedy fold runs over one document's blocks at a time, a batch of documents to a call.
    """
    n = F.coalesce(X.token_count("text"), F.lit(0))
    parts = F.when(n > most, F.transform(X.sentences("text"), lambda x: F.struct(X.token_count(x).alias("n"), x.alias("text"))))
    rows = section_paths(blocks).select("doc_id", "block_idx", "section_path", F.coalesce(F.col("kind") == "heading", F.lit(False)).alias("head"), n.alias("n"), parts.alias("parts"), F.coalesce("text", F.lit("")).alias("text")).where("head or n > 0")

    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "section_path", "head", "n", "parts", "text"))).alias("rows"))  # the blocks of one document

    def fold(doc_id: int, blocks: list) -> list[list]:
        sections: list[list] = []  # path, tokens of the body, rows (block, pieces) with the heading first
        for idx, path, head, size, parts, text in (b.values() for b in blocks):
            if head or not sections:
                sections.append([tuple(path), 0, 0, []])
            here = sections[-1]
            if head:
                here[2] = 1  # rows before the body
            else:
                here[1] += size
            here[3].append((idx, _pieces(text, size, most, parts)))
        sections = [s for s in sections if s[1]]
        out: list[list] = []
        k = 0
        while k < len(sections):
            path, total, heads, packed = sections[k]
            packed = packed[heads:]
            while total < least and k + 1 < len(sections) and sections[k + 1][0][:-1] == path[:-1]:
                k += 1
                total += sections[k][1]
                packed = packed + sections[k][3]
            k += 1
            fresh = True
            for idx, pieces in packed:
                for at, size, text in pieces:
                    if not size:
                        continue
                    if fresh or out[-1][7] + size > most:
                        out.append([doc_id, len(out), list(path), idx, idx, at, at, 0, ""])
                        fresh = False
                    out[-1][8] += ("" if not out[-1][8] else " " if out[-1][4] == idx else "\n\n") + text
                    out[-1][4], out[-1][6] = idx, at + size
                    out[-1][7] += size
        return out

    types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = ["doc_id", "chunk_index", "section_path", "first_block", "last_block", "first_token", "end_token", "token_count", "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [o for d, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for o in fold(d, r)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return whole.mapInArrow(run, "doc_id long, chunk_index int, section_path array<string>, first_block int, last_block int, first_token int, end_token int, token_count int, text string")


def _gaps(found: list[str], window: int, percentile: float, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, is_break) of the gap before every sentence but the first."""
    n = len(found)
    x = np.zeros((n + 1, buckets))
    for i, sentence in enumerate(found):
        at = [xxhash.xxh32_intdigest(w) % buckets for w in sentence.lower().split()]
        x[i + 1] = np.bincount(at, minlength=buckets) / max(1.0, np.sqrt(len(at)))
    total, i = np.cumsum(x, axis=0), np.arange(1, n)
    a, b = total[i] - total[np.maximum(i - window, 0)], total[np.minimum(i + window, n)] - total[i]
    norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    d = np.round(1 - np.divide((a * b).sum(1), norm, out=np.zeros(n - 1), where=norm > 0), 9)
    peak = pd.Series(d).rolling(2 * window + 1, center=True, min_periods=1).max().to_numpy()
    return d, (d >= np.quantile(d, percentile)) & (d >= peak - 1e-12)


def topic_breaks(docs: DataFrame, window: int = 2, percentile: float = 0.9, buckets: int = 256) -> DataFrame:
    """(doc_id, sentence, distance, is_break): breaks where the sentences before and after a gap differ most.

    Sentences are hashed bags of words; the distance of a gap is 1 - cosine of the ``window`` sentences on either side, a break is a peak at or above the document's percentile.
    """
    s = docs.select("doc_id", X.sentences("text").alias("s")).where(F.size("s") > 1)

    def gaps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            found = [(doc_id, *_gaps(s, window, percentile, buckets)) for doc_id, s in zip(batch["doc_id"], batch["s"])]
            sizes = [len(d) for _, d, _ in found]
            cat = lambda k: np.concatenate([f[k] for f in found]) if found else []
            yield pd.DataFrame({"doc_id": np.repeat([f[0] for f in found], sizes), "sentence": np.concatenate([np.arange(1, n + 1) for n in sizes]) if found else [], "distance": cat(1), "is_break": cat(2)})

    return s.mapInPandas(gaps, "doc_id long, sentence int, distance double, is_break boolean")


def semantic_chunks(docs: DataFrame, most: int = 400, least: int = 80, window: int = 2, percentile: float = 0.9, buckets: int = 256) -> DataFrame:
    """(doc_id, chunk_index, first_sentence, last_sentence, first_token, token_count, text): sentences packed between topic breaks.

    A chunk ends at a break once it has ``least`` tokens, and before it would exceed ``most``; a last chunk below ``least`` joins the one before where it
    fits. A sentence above ``most`` leaves as windows of ``most`` tokens, ``first_token`` being their place in it.
    """
    s = docs.select("doc_id", X.sentences("text").alias("s")).where(F.size("s") > 0).select("doc_id", "s", F.transform("s", X.token_count).alias("n"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            out = []
            for doc_id, found, sizes in zip(batch["doc_id"], batch["s"], batch["n"]):
                shift = _gaps(found, window, percentile, buckets)[1] if len(found) > 1 else []
                groups: list[list[int]] = []  # first, last, tokens
                for i, k in enumerate(map(int, sizes)):
                    if not groups or groups[-1][2] + k > most or (shift[i - 1] and groups[-1][2] >= least):
                        groups.append([i, i, 0])
                    groups[-1][1], groups[-1][2] = i, groups[-1][2] + k
                if len(groups) > 1 and groups[-1][2] < least and groups[-2][2] + groups[-1][2] <= most:
                    _, last, k = groups.pop()
                    groups[-1][1], groups[-1][2] = last, groups[-1][2] + k
                cut = [(a, z, at, n, text) for a, z, k in groups for at, n, text in _windows(" ".join(found[a : z + 1]), k, most)]
                out += [(doc_id, i, *c) for i, c in enumerate(cut)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "first_sentence", "last_sentence", "first_token", "token_count", "text"])

    return s.mapInPandas(pack, "doc_id long, chunk_index int, first_sentence int, last_sentence int, first_token int, token_count int, text string")
