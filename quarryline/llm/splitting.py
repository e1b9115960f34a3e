"""Splitting texts above a token limit: content-defined cuts snapped to natural boundaries.

A rolling hash over the tokens marks landmarks. From the last cut, the first landmark at least ``least``
tokens away picks the cut: the natural boundary nearest to it (paragraph, else sentence, else clause, else white space)
within ``least`` and the most that limit and overlap allow; without a landmark, the last such boundary. An edit
moves only the cuts near it, because landmarks depend on the tokens around them alone. Every piece but the first begins ``overlap``
tokens before its cut.

Defined results: null, empty and blank texts and texts within the limit give one piece or none (``only_oversized``); text[char_start:char_end] is the
piece, and the pieces without their overlaps join to the whole text; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import layout
from quarryline.session import materialize

#: A token: a run of Unicode letters, digits or underscore, or one other character that is not white space.
TOKEN = re.compile(r"\w+|[^\w\s]")
WINDOW, DIVISOR = 12, 48
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _strengths(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """For each token, how natural a cut before it is: 4 paragraph, 3 sentence or line, 2 clause, 1 white space, 0 none."""
    out = np.zeros(len(starts), np.int8)
    for i in range(1, len(starts)):
        a, b = ends[i - 1], starts[i]
        if a == b:
            continue
        gap = text[a:b]
        if "\n" in gap:
            out[i] = 4 if gap.count("\n") > 1 else 3
        else:
            c = text[a - 1]
            out[i] = 3 if c in ".!?…。" or (c in "\"')]»”" and text[a - 2 : a - 1] in tuple(".!?…")) else 2 if c in ",;:" else 1
    return out


def _landmarks(words: list[str]) -> np.ndarray:
    """True before token i when the hash of the WINDOW tokens before it is a multiple of DIVISOR."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros(len(h), bool)
    if len(h) > WINDOW:
        roll = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            roll += h[WINDOW - 1 - k : len(h) - k] * np.uint64(pow(int(_MUL), k, 2**64))
        roll ^= roll >> np.uint64(31)
        out[WINDOW:] = ((roll * _MUL) >> np.uint64(33))[:-1] % np.uint64(DIVISOR) == 0
    return out


def cuts(text: str, limit: int, overlap: int, least: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(cut positions in tokens, from 0, without the end) and the character spans of the tokens."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [0], spans
    strength = _strengths(text, [a for a, _ in spans], [b for _, b in spans])
    marks = np.flatnonzero(_landmarks([text[a:b] for a, b in spans]))
    at, out = 0, [0]
    while True:
        # the first piece has no overlap before it
        most = limit if at == 0 else limit - overlap
        if n - at <= most:
            return out, spans
        lo, hi = at + min(least, most), min(at + most, n - 1)
        k = np.searchsorted(marks, lo)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= hi else None
        here = strength[lo : hi + 1]
        at = hi if mark is None else mark
        for kinds in (4, 3, 2, 1):
            found = np.flatnonzero(here >= kinds)
            if len(found):
                at = lo + int(found[-1] if mark is None else found[np.abs(found + lo - mark).argmin()])
                break
        out.append(at)


def split_texts(df: DataFrame, key_cols: list[str], text_col: str, *, limit: int = 400, overlap: int = 40, least: int = 120, only_oversized: bool = True, mark_others: bool = False) -> DataFrame:
    """The key columns (as strings) and piece_index, n_pieces, char_start, char_end, overlap_tokens, token_count, text of every piece.

    With ``mark_others`` the texts within the limit (and null ones) give a row with a piece_index of -1 and no text.
    """
    if not 0 <= overlap < limit - least:
        raise ValueError("overlap and least piece must fit into the limit")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows: list[tuple] = []
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
            for key, text in zip(keys, batch.column(batch.num_columns - 1).to_pylist()):
                # a token is one character at least
                if text is None or (only_oversized and (len(text) <= limit or len(TOKEN.findall(text)) <= limit)):
                    if mark_others:
                        rows.append((*key, -1, 0, None, None, None, None, None))
                    continue
                at, spans = cuts(text, limit, overlap, least)
                if not spans:
                    continue
                for i, a in enumerate(at):
                    end = at[i + 1] if i + 1 < len(at) else len(spans)
                    first = max(0, a - overlap) if i else 0
                    start_char = spans[first][0] if i else 0
                    end_char = spans[end][0] if end < len(spans) else len(text)
                    rows.append((*key, i, len(at), start_char, end_char, a - first, end - first, text[start_char:end_char]))
            if rows:
                types = [pa.string()] * len(key_cols) + [pa.int32()] * 6 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*key_cols, *NAMES])

    NAMES = ["piece_index", "n_pieces", "char_start", "char_end", "overlap_tokens", "token_count", "text"]
    src = (df if mark_others else df.where(F.col(text_col).isNotNull())).select(*(F.col(k).cast("string").alias(k) for k in key_cols), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{k}` string" for k in key_cols) + ", piece_index int, n_pieces int, char_start int, char_end int, overlap_tokens int, token_count int, text string"
    return src.mapInArrow(run, schema)


def block_paths(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, block_idx, section_path) of the wanted blocks: the headings open at the block, outermost first."""
    heads = blocks.where("kind = 'heading' and text is not null").select("doc_id", "block_idx", F.trim("text").alias("text"), "kind", "level")
    marks = wanted.join(heads, ["doc_id", "block_idx"], "left_anti").select("doc_id", "block_idx", F.lit("").alias("text"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"))
    near = heads.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(marks)
    return layout.section_paths(near).select("doc_id", "block_idx", "section_path").join(wanted, ["doc_id", "block_idx"], "left_semi")


def split_blocks_and_chunks(blocks: DataFrame, chunks: DataFrame, **limits: int) -> DataFrame:
    """Pieces of every oversized block and distinct chunk with their section_path.

    A chunk_id delivered several times counts once: its text as last ingested (of a tie one by digest), whatever its size.
    """
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("block_idx").cast("string"))
    b = split_texts(blocks.where("doc_id is not null and block_idx is not null"), ["doc_id", "block_idx"], "text", **limits).withColumns({"doc_id": F.col("doc_id").cast("long"), "block_idx": F.col("block_idx").cast("int")})
    b = materialize(b, "pieces")  # few: only oversized blocks have pieces
    paths = block_paths(blocks, b.select("doc_id", "block_idx").distinct())
    b = b.join(paths, ["doc_id", "block_idx"]).select(F.lit("block").alias("item_kind"), key.alias("item_key"), "doc_id", *_OUT, "section_path")
    named = chunks.where("chunk_id is not null").select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen"), F.to_json(F.struct("section_path")).alias("path"), "text")
    # deliveries within the limit take part in what counts as last, so that an older, longer text does not stay;
    # a chunk_id with very many deliveries is folded before the shuffle
    c = materialize(split_texts(named.withColumn("print", F.xxhash64("text")), ["chunk_id", "doc_id", "seen", "path", "print"], "text", mark_others=True, **limits), "deliveries")
    mine = F.struct("seen", "print", "doc_id", "path")
    last = c.groupBy("chunk_id").agg(F.max(mine).alias("last"))
    c = c.where("piece_index >= 0").join(last, "chunk_id").where(mine.eqNullSafe(F.col("last"))).dropDuplicates(["chunk_id", "piece_index"])
    c = c.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), F.col("doc_id").cast("long").alias("doc_id"), *_OUT, F.from_json("path", "section_path array<string>")["section_path"].alias("section_path"))
    return b.unionByName(c)


_OUT = ["piece_index", "n_pieces", "char_start", "char_end", "overlap_tokens", "token_count", "text"]
