"""Texts that were cut off: near-copies that go on, lengths piled up at a source's limit, closing words that close nothing.

Three kinds of evidence, each over all rows:

* ``copy``: the min-hash values of the windows of a text (``WINDOW`` successive shingles of five words each) are banded two
  successive different values to a band, over the whole text. A text asks with its rarest bands, as many as leave a near-copy no way round them
  (at least the share ``kept`` is common to near-copies); pairs that share fewer are pruned, the others are aligned on their whole texts:
  chained common shingles, then a banded edit distance from the last of them to the end that comes first. A pair counts if the
  shingles of the one text and of the other up to that end reach ``similarity``; this bounds how far apart a common band may stand in the two. The text
  that ends early is cut when the other goes on within the word or sentence, or by more than ``extra`` words.
* ``limit``: ``pile`` or more different texts of a source have its greatest length (in characters or UTF-8 bytes) exactly.
* ``closing``: of a text without closing punctuation, the share of places in the corpus where its last two words
  (backed off to the last) end a paragraph is below ``terminal``, its own place left out; the shorter context weighs one place for every ``TEXTS`` texts. A closing paragraph of up to 6 words is
  judged first by how often paragraphs that begin with these words end there ("Status: open"). A last word that is the beginning of a
  word at least ``fragment`` times as frequent as itself (its places at ends apart) is a fragment and closes nothing.

Defined results: null ids are left out; null and blank texts are not cut (they reach no end to miss); a null
source counts as a source of its own; all evidence is gathered from different texts (by a digest of 64 bits), however many copies there are of one; repeated rows of one id give one row, cut if any of them is; empty input gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.llm import sketch as S
from quarryline.session import materialize

PARAGRAPH = re.compile(r"\n\s*\n|\n(?=\s*[-–•(\"\d|©])")
DIGIT = re.compile(r"\d")
#: Ids of 8 bytes sent to every task at most; more are joined by shuffle.
MOST_BROADCAST_IDS = 1_000_000
WINDOW, SHINGLE, OPENING = 16, 5, 6
#: A band held by more texts is hot: its texts meet the ``REACH`` that go on furthest after it, and all others if none of these shows them to be cut.
HOT, REACH = 64, 4
#: Words between the last common shingle and the end that are aligned by edit distance; a near-copy differs less.
REST, LEAST = 64, 8
#: Texts of fewer words have too few windows; they ask with the band of their beginning.
SHORT = 2 * WINDOW + SHINGLE
#: Of up to this many different texts the prior of a closing context weighs one place, of more in proportion.
TEXTS = 10_000
# marks that stand for an ellipsis put where a text was cut
DOTS = "…"
# what may follow the last mark of a finished sentence
CLOSERS = "\"'”’»)]*_"
STOPS = ".!?:;。！？"


class TokenIds(S.WordIds):
    """Word -> id of its lower-cased form; the lowest bit tells whether it has a digit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word.lower()) & ~1 | bool(DIGIT.search(word))
        return x


def shapes(ids: np.ndarray) -> np.ndarray:
    """The ids with all words that have a digit taken as one."""
    return np.where(ids & np.uint64(1), np.uint64(1), ids)


def ends_open(text: str) -> bool:
    """No closing punctuation at the end, an ellipsis sign apart."""
    t = text.rstrip().rstrip(DOTS).rstrip()
    core = t.rstrip(CLOSERS)
    if not core:
        return False
    if core[-1] in STOPS:
        return False
    last = t.rsplit("\n", 1)[-1].strip()
    return not (last.startswith(("©", "http")) or t[-1] in CLOSERS)


def _pairs(ids: np.ndarray) -> np.ndarray:
    h = (ids[:-1] * S._M1) ^ ids[1:]
    h ^= h >> S._S
    return (h * S._M2).view(np.int64)


def _single(ids: np.ndarray) -> np.ndarray:
    return (ids * S._M3).view(np.int64)


def _openings(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(paragraphs, keys) for each of the first ``OPENING`` beginnings of the paragraphs at ``starts``."""
    out, h = [], np.full(len(starts), 0x51ED27, np.uint64)
    for k in range(OPENING):
        has = np.flatnonzero(sizes > k)
        h[has] = (h[has] ^ ids[starts[has] + k]) * S._M1
        h[has] ^= h[has] >> S._S
        out.append((has, h[has].view(np.int64)))
    return out


def window_minima(grams: np.ndarray, first: np.ndarray, many: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``grams``, text) of the least shingle of every window of ``size`` shingles, in order; texts have ``many`` shingles from ``first`` on."""
    full = np.maximum(many - size + 1, 0)
    text = np.repeat(np.arange(len(first)), full)
    if not len(text):
        return np.zeros(0, np.int64), text
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(full) - full, full)
    view = np.lib.stride_tricks.sliding_window_view(grams, size)
    at = np.concatenate([some + view[some].argmin(1) for some in np.array_split(start, len(start) // 100_000 + 1)])
    new = np.concatenate([[True], (at[1:] != at[:-1])])
    return at[new], text[new]


def bands(grams: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in its text, text, whether of a beginning) of the bands of every text, by text.

    A band is two successive different window minima; besides these, the least of the first s and of the first 2 s shingles, for s = 2, 4, 8.
    """
    many = np.maximum(n_words - SHINGLE + 1, 0)
    at, own = window_minima(grams, first, many)
    two = np.flatnonzero(own[1:] == own[:-1])
    parts = [(grams[at[two]], grams[at[two + 1]], at[two], own[two], np.zeros(len(two), bool))]
    for s in (2, 4, 8):
        has = np.flatnonzero(many >= 2 * s)
        if len(has):
            view = np.lib.stride_tricks.sliding_window_view(grams, 2 * s)[first[has]]
            parts.append((view[:, :s].min(1) + np.uint64(s), view.min(1), first[has], has, np.ones(len(has), bool)))
    x, y, at, own, head = (np.concatenate(c) for c in zip(*parts))
    h = (x * S._M1) ^ y
    h ^= h >> S._S
    order = np.argsort(own, kind="stable")
    return (h * S._M2).view(np.int64)[order], (at - first[own])[order], own[order], head[order]


def _scan(df: DataFrame, flush: int = 400_000, docs_at_once: int = 1000) -> DataFrame:
    """One pass over different texts (same, text), two kinds of rows.

    ``total`` null: a text's lengths, ending, last word and bands. With ``word``: a task's places of a word. Else (context, total, ends): a task's places
    of a pair of successive words, a word or a beginning of a paragraph, and those that end a paragraph unpunctuated.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenIds()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        vocabulary: Counter[str] = Counter()

        def known() -> pa.RecordBatch:
            named = {"word": pa.array(list(vocabulary)), "total": pa.array(list(vocabulary.values()), pa.int64())}
            out = pa.RecordBatch.from_arrays([named.get(n, pa.nulls(len(vocabulary), t)) for n, t in FIELDS.items()], names=list(FIELDS))
            vocabulary.clear()
            return out

        def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            k, t, e = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(k, return_inverse=True)
            return u, np.bincount(at, t, len(u)).astype(np.int64), np.bincount(at, e, len(u)).astype(np.int64)

        def counts(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            named = dict(zip(("context", "total", "ends"), (pa.array(v) for v in x)))
            return pa.RecordBatch.from_arrays([named.get(n, pa.nulls(len(x[0]), t)) for n, t in FIELDS.items()], names=list(FIELDS))

        for batch in (whole.slice(k, docs_at_once) for whole in parts for k in range(0, whole.num_rows, docs_at_once)):
            out: dict[str, list] = {k: [] for k in FIELDS}
            flat: list[str] = []
            first, n_words, p_start, p_size, p_end, line = [], [], [], [], [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                first.append(len(flat))
                body = text.rstrip().rstrip(DOTS + "�").rstrip()
                last = 0
                for para in PARAGRAPH.split(body):
                    found = S.WORD.findall(para)
                    if found:
                        p_start.append(len(flat))
                        p_size.append(len(found))
                        p_end.append(para.rstrip()[-1:].isalnum())
                        last = len(found)
                        flat += found
                n_words.append(len(flat) - first[-1])
                line.append(len(p_start) - 1 if 0 < last <= OPENING else -1)
                out["same"].append(key)
                out["n_chars"].append(len(text))
                out["n_bytes"].append(len(text.encode("utf-8", "surrogatepass")))
                out["open"].append(ends_open(text))
                out["broken"].append(text.rstrip().endswith("�"))
                out["word"].append(flat[-1].lower() if last else None)
            docs = len(first)
            if not docs:
                continue
            ids = np.fromiter((memo[w] for w in flat), np.uint64, len(flat))
            grams = S.shingle_hashes(ids, SHINGLE)
            _, where, times = np.unique(ids, return_index=True, return_counts=True)
            for k, n in zip(where.tolist(), times.tolist()):
                if not int(ids[k]) & 1:
                    vocabulary[flat[k].lower()] += n
            if len(vocabulary) > flush:
                yield known()
            band, at, own, head = bands(grams, np.array(first), np.array(n_words))
            edges = np.searchsorted(own, np.arange(docs + 1))
            for lo, hi in zip(edges, edges[1:]):
                # a band that comes twice is held where it comes first
                u, k = np.unique(band[lo:hi], return_index=True)
                out["keys"].append(u.tolist())
                out["at"].append(at[lo:hi][k].tolist())
                tops = band[lo:hi][head[lo:hi]]
                out["head"].append(int(tops[-1]) if len(tops) and n_words[len(out["head"])] < SHORT else None)
            ids = shapes(ids)  # for the contexts, numbers are alike
            one, two = _single(ids), _pairs(ids)
            for f, n in zip(first, n_words):
                out["last2"].append(int(two[f + n - 2]) if n > 1 else None)
                out["last1"].append(int(one[f + n - 1]) if n else None)
            ps, pn, pe = np.array(p_start, np.int64), np.array(p_size, np.int64), np.array(p_end, bool)
            opened = _openings(ids, ps, pn)
            whole = np.zeros(len(ps), np.int64)
            for has, h in opened:
                whole[has] = h
            out["line"] = [int(whole[k]) if k >= 0 else None for k in line]
            out["n_words"] = n_words
            profile = {k: pa.array(v, t) if len(v) else pa.nulls(docs, t) for (k, v), t in zip(out.items(), FIELDS.values())}
            yield pa.RecordBatch.from_arrays(list(profile.values()), names=list(FIELDS))

            if len(ids):
                inside = np.ones(len(ids), bool)
                inside[ps + pn - 1] = False
                seen = [one, two[inside[:-1]], *(h for _, h in opened)]
                stop, short = ps + pn - 1, pe & (pn <= OPENING)
                ended = [one[stop[pe]], two[stop[pe & (pn > 1)] - 1], whole[short]]
                u, n = np.unique(np.concatenate(seen), return_counts=True)
                v, m = np.unique(np.concatenate(ended), return_counts=True)
                e = np.zeros(len(u), np.int64)
                e[np.searchsorted(u, v)] = m
                held.append((u, n, e))
            if sum(len(x[0]) for x in held) > flush:
                held = [fold()]
                if len(held[0][0]) > flush // 2:
                    yield counts(held.pop())
        if held:
            yield counts(fold())
        if vocabulary:
            yield known()

    return df.mapInArrow(run, "same long, n_words int, n_chars long, n_bytes long, open boolean, broken boolean, last2 long, last1 long, line long, keys array<long>, at array<int>, head long, word string, context long, total long, ends long")


FIELDS = {
    "same": pa.int64(), "n_words": pa.int32(), "n_chars": pa.int64(), "n_bytes": pa.int64(), "open": pa.bool_(), "broken": pa.bool_(),
    "last2": pa.int64(), "last1": pa.int64(), "line": pa.int64(), "keys": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "head": pa.int64(), "word": pa.string(),
    "context": pa.int64(), "total": pa.int64(), "ends": pa.int64(),
}


class Text:
    """Words, their ids and shingles of one text to be aligned."""

    def __init__(self, text: str, memo: S.WordIds) -> None:
        self.text, self.words = text, S.words(text)
        self.ids = np.fromiter((memo[w] for w in self.words), np.uint64, len(self.words))
        self.grams = S.shingle_hashes(self.ids, SHINGLE)
        u, at, n = np.unique(self.grams, return_index=True, return_counts=True)
        self.once, self.at = u[n == 1], at[n == 1]

    def gap(self, k: int) -> str:
        """What stands between words ``k - 1`` and ``k``."""
        spans = [m.span() for m in S.WORD.finditer(self.text)]
        return self.text[spans[k - 1][1] : spans[k][0]]


def _chain(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest run of common shingles that comes in the same order in both texts; ``i`` increases."""
    if (np.diff(j) > 0).all():
        return i, j
    tops, ends, back = [], [], np.empty(len(j), np.int64)
    for k, y in enumerate(j.tolist()):
        at = bisect_left(tops, y)
        back[k] = ends[at - 1] if at else -1
        tops[at:], ends[at:] = [y] + tops[at + 1 :], [k] + ends[at + 1 :]
    k, out = ends[-1], []
    while k >= 0:
        out.append(k)
        k = back[k]
    return i[out[::-1]], j[out[::-1]]


def _end_in(rest: list[str], other: list[str], slack: int = 6) -> tuple[int, int]:
    """(cost, words of ``other`` used): the cheapest place for the end of ``rest``, near the diagonal; a last word that ``other``'s begins with costs nothing."""
    other = other[: len(rest) + slack]
    row = list(range(len(other) + 1))
    for k, w in enumerate(rest):
        new, last = [k + 1], k + 1 == len(rest)
        for m, v in enumerate(other):
            same = w == v or (last and v.startswith(w))
            new.append(min(row[m] + (not same), row[m + 1] + 1, new[m] + 1) if abs(k - m) <= slack else len(rest) + 1)
        row = new
    return min((c, abs(m - len(rest)), m) for m, c in enumerate(row))[::2]


def compare(x: Text, y: Text, open_x: bool, open_y: bool, similarity: float, extra: int) -> tuple[bool, bool | None]:
    """(whether the two are near-copies up to the end that comes first, which one is cut: True the first, False the second, None neither)."""
    _, a, b = np.intersect1d(x.once, y.once, assume_unique=True, return_indices=True)
    if not len(a):
        return False, None
    i, j = x.at[a], y.at[b]
    order = np.argsort(i)
    i, j = _chain(i[order], j[order])
    rest_x, rest_y = x.words[i[-1] + SHINGLE :], y.words[j[-1] + SHINGLE :]
    first = (len(rest_x), len(x.words[-1])) <= (len(rest_y), len(y.words[-1]))
    t, f, is_open = (x, y, open_x) if first else (y, x, open_y)
    rest, other = (rest_x, rest_y) if first else (rest_y, rest_x)
    i, j = (i, j) if first else (j, i)
    if len(rest) > REST or len(t.words) < LEAST:
        return False, None
    cost, used = _end_in(rest, other)
    if not rest and f.words[j[-1] + SHINGLE - 1] != t.words[-1] or 2 * cost > len(rest):
        return False, None
    end = int(j[-1]) + SHINGLE + used  # f's words up to the place where t ends
    mine, theirs = np.unique(t.grams), np.unique(f.grams[: max(0, end - SHINGLE + 1)])
    common = len(np.intersect1d(mine, theirs, assume_unique=True))
    if common < similarity * (len(mine) + len(theirs) - common):
        return False, None
    if f.words[end - 1] != t.words[-1] and f.words[end - 1].startswith(t.words[-1]):
        return True, first  # cut within a word
    left = len(f.words) - end
    goes_on = left > extra or (left > 0 and is_open and not any(c in f.gap(end) for c in ".!?\n"))
    return True, first if goes_on else None


def _aligned(pairs: DataFrame, similarity: float, extra: int) -> DataFrame:
    """Of rows (a, b, text_a, text_b, open_a, open_b): near-copies (doc_id, near, cut), a row for either text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = S.WordIds()
        for batch in parts:
            known: dict[int, Text] = {}
            rows = []
            for a, b, text_a, text_b, open_a, open_b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = (known.get(k) or known.setdefault(k, Text(t, memo)) for k, t in ((a, text_a), (b, text_b)))
                near, first = compare(x, y, open_a, open_b, similarity, extra)
                if near:
                    rows += [(a, first is True), (b, first is False)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_()))], names=["doc_id", "cut"])

    return pairs.select("a", "b", "text_a", "text_b", "open_a", "open_b").mapInArrow(run, "doc_id long, cut boolean").groupBy("doc_id").agg(F.max("cut").alias("cut"))


def _few(ids: DataFrame) -> DataFrame:
    """Written ids; a number known to be small goes to every task, so that only the rows they stand for are shuffled."""
    ids = materialize(ids, "ids")
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids


def near_copies(profiles: DataFrame, texts: DataFrame, kept: float, similarity: float, extra: int, hot: int = HOT, reach: int = REACH) -> DataFrame:
    """(doc_id, cut) of the texts that have a near-copy, from (doc_id, n_words, keys, at, head, open) of different texts and (doc_id, text).

    A text shares at least ``ceil(kept * m)`` of its ``m`` bands with a near-copy, so one of its ``m - ceil(kept * m) + 1`` rarest is
    among them; the bands no other text has are the rarest. Only these few are asked for, and of their holders those where the band stands
    about as far from the beginning: at a similarity s, insertions come to ``1 / s - 1`` of the text at most.
    """
    each = F.explode(F.arrays_zip("keys", "at")).alias("k")
    rows = profiles.select("doc_id", "n_words", each).select("doc_id", "n_words", F.col("k.keys").alias("key"), "k.at").repartition("key")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(rows.join(counts.hint("shuffle_hash"), "key"), "held")
    by = W.partitionBy("doc_id")
    ranked = held.join(profiles.select("doc_id", F.size("keys").alias("m"), "head"), "doc_id").withColumn("shared", F.count(F.lit(1)).over(by)).withColumn("r", F.row_number().over(by.orderBy("n", F.desc("at"))))
    zone = F.floor(F.log(1 + F.col("at") / 8) * 3).cast("int")
    rare = F.when(F.col("head").isNull(), F.col("r") <= F.col("shared") - F.ceil(F.lit(kept) * F.col("m")) + 1).otherwise(F.col("key") == F.col("head"))
    asks = materialize(ranked.where(rare).select("key", "doc_id", "n_words", "at", "n", zone.alias("zone")), "asks")
    holders = held.select("key", "n", F.col("doc_id").alias("other"), F.col("n_words").alias("other_words"), F.col("at").alias("other_at"), zone.alias("zone"))
    drift = (1 / similarity - 1) / similarity * F.least("n_words", "other_words") + SHINGLE

    def ordered(df: DataFrame) -> DataFrame:
        near = df.where((F.col("doc_id") != F.col("other")) & (F.abs(F.col("at") - F.col("other_at")) <= drift))
        return near.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()

    far = F.row_number().over(W.partitionBy("key", "zone").orderBy(F.desc(F.col("other_words") - F.col("other_at")), "other"))
    met = ordered(asks.where(F.col("n") <= hot).join(holders.where(F.col("n") <= hot).drop("n", "zone"), "key"))
    met = met.unionByName(ordered(asks.where(F.col("n") > hot).join(holders.where(F.col("n") > hot).drop("n").withColumn("r", far).where(F.col("r") <= reach), ["key", "zone"])))

    def settled(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "met")
        both = lambda df: _few(df.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        near = profiles.join(both(pairs), "doc_id", "left_semi")
        end = lambda k: near.select(F.col("doc_id").alias(k), F.col("keys").alias(f"keys_{k}"), F.col("open").alias(f"open_{k}"))
        common, least = F.size(F.array_intersect("keys_a", "keys_b")), F.ceil(F.lit(kept) * F.least(F.size("keys_a"), F.size("keys_b")))
        likely = materialize(pairs.join(end("a"), "a").join(end("b"), "b").where(common >= least).select("a", "b", "open_a", "open_b"), "likely")
        whole = texts.join(both(likely), "doc_id", "left_semi")
        text = lambda k: whole.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
        return materialize(_aligned(likely.join(text("a"), "a").join(text("b"), "b"), similarity, extra), "aligned")

    first = settled(met.distinct())
    # texts that those going on furthest don't show to be cut meet all that hold their hot bands, whatever near-copies they have
    rest = materialize(asks.where(F.col("n") > hot).join(first.where("cut"), "doc_id", "left_anti"), "rest")
    if rest.isEmpty():
        return first
    return first.unionByName(settled(ordered(rest.join(holders.drop("n", "zone"), "key")))).groupBy("doc_id").agg(F.max("cut").alias("cut"))


def different_texts(src: DataFrame, docs: DataFrame) -> DataFrame:
    """(same, text): every text once, from rows (doc_id, text, same) and (doc_id, same) of all of them; copies are all but the first of the ids that have a text."""
    held = _few(docs.groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "least"))
    rows = src.join(held, "same", "left")
    # a text that comes twice under one id is left over twice
    again = rows.where(F.col("doc_id") == F.col("least")).select("same", "text").dropDuplicates(["same"])
    return rows.where("least is null").select("same", "text").unionByName(again)


def cut_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, kept: float = 0.35, similarity: float = 0.8, extra: int = 14, pile: int = 3, terminal: float = 0.15, fragment: int = 20
) -> DataFrame:
    """One row per id: doc_id, source, by_copy, by_limit, by_closing, is_cut, terminality (null for closed endings)."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    src = src.withColumn("same", F.xxhash64("text"))
    docs = materialize(src.select("doc_id", "source", "same"), "docs")
    texts = different_texts(src, docs)
    scan = materialize(_scan(texts), "scan")
    prof = scan.where("total is null").drop("context", "total", "ends")
    lean = prof.drop("keys", "at", "head")

    # near-copies
    copies = near_copies(prof.select(F.col("same").alias("doc_id"), "n_words", "keys", "at", "head", "open"), texts.withColumnRenamed("same", "doc_id"), kept, similarity, extra)
    by_copy = copies.where("cut").select(F.col("doc_id").alias("same"), F.lit(True).alias("by_copy"))

    # lengths piled up at the greatest length of a source; one row a source
    sized = docs.join(lean.select("same", "n_chars", "n_bytes"), "same")
    most = sized.groupBy("source").agg(F.max("n_chars").alias("most_chars"), F.max("n_bytes").alias("most_bytes"))
    most = most.select(F.col("source").alias("of"), "most_chars", "most_bytes")
    at_chars, at_bytes = F.col("n_chars") == F.col("most_chars"), F.col("n_bytes") == F.col("most_bytes")
    longest = sized.join(most, F.col("source").eqNullSafe(F.col("of"))).where(at_chars | at_bytes)
    enough = lambda at: F.count_distinct(F.when(at, F.col("same"))) >= pile
    piled = longest.groupBy(F.col("of"), "most_chars", "most_bytes").agg(enough(at_chars).alias("chars_piled"), enough(at_bytes).alias("bytes_piled"))
    known = sized.join(piled, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("by_limit", (at_chars & F.col("chars_piled")) | (at_bytes & F.col("bytes_piled")))

    # closing words: every open text asks for its last two words, its last word and its closing line
    counts = scan.where("context is not null").groupBy("context").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    is_open = lean.where("open and not broken")
    ask = is_open.select("same", F.posexplode(F.array("last2", "last1", "line")).alias("slot", "context")).where("context is not null")
    slot = lambda k, c: F.max(F.when(F.col("slot") == k, F.col(c)))
    seen = ask.join(counts, "context").groupBy("same").agg(*(slot(k, c).alias(f"{c[0]}{n}") for k, n in ((0, 2), (1, 1), (2, 0)) for c in ("total", "ends")))
    less = lambda c: F.greatest(F.coalesce(c, F.lit(0)) - 1, F.lit(0))
    # what is known of shorter contexts weighs as much against a longer one however many texts there are, else the few others cut at the same words vouch for an end in a large corpus
    weight = max(1.0, lean.count() / TEXTS)
    back = (less(F.col("e1")) + 0.1 * weight) / (less(F.col("t1")) + weight)
    back = (less(F.col("e2")) + back * weight) / (less(F.col("t2")) + weight)
    score = F.when(F.col("line").isNull(), back).otherwise((less(F.col("e0")) + back * weight) / (less(F.col("t0")) + weight))
    beginnings = (
        scan.where("total is not null and word is not null").groupBy("word").agg(F.sum("total").alias("n")).where(F.col("n") >= fragment)
        .select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.col("word").substr(F.lit(1), i - 1))).alias("word"))
        .where("word <> ''").groupBy("word").agg(F.max("n").alias("longer"))
    )
    is_fragment = F.coalesce(F.col("longer") >= fragment * (F.coalesce(F.col("t1") - F.col("e1"), F.lit(0)) + 1), F.lit(False))
    closing = (
        is_open.select("same", "line", "word").join(seen, "same", "left").join(beginnings, "word", "left")
        .select("same", F.when(is_fragment, F.lit(0.0)).otherwise(score).alias("terminality"))
    )

    yes = lambda c: F.coalesce(c, F.lit(False))
    told = lean.select("same", "broken").join(closing, "same", "left").join(by_copy, "same", "left")
    rows_ = known.join(told, "same").select(
        "doc_id", "source", yes(F.col("by_copy")).alias("by_copy"), yes(F.col("by_limit")).alias("by_limit"), (F.col("broken") | yes(F.col("terminality") < terminal)).alias("by_closing"), "terminality"
    )
    return rows_.groupBy("doc_id").agg(F.min("source").alias("source"), *(F.max(c).alias(c) for c in ("by_copy", "by_limit", "by_closing")), F.min("terminality").alias("terminality")).withColumn("is_cut", F.expr("by_copy or by_limit or by_closing"))
