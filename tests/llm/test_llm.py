"""Operators for training data against brute force, exact round trips and edge cases."""

import datetime as dt
import glob
import heapq
import os
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import graph, mixing, neardup, packing, pii, queries, splitting, tokens, truncation, vectors
from quarryline.llm import sketch as S

random.seed(1)
VOCAB = ["".join(random.choice("bdfgklmnprst") + random.choice("aeiou") for _ in range(random.randint(2, 4))) + random.choice(["", "n", "s"]) for _ in range(4000)]


def prose(n, rng=random):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, share, rng=random):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split())


# ---------------------------------------------------------------- splitting
def test_split_round_trip_and_limits(spark):
    texts = {"para": "\n\n".join(prose(70) + "." for _ in range(20)), "solid": "語" * 30 + "x" * 5000, "marks": "-" * 1500, "long": prose(60_000), "fits": prose(400), "blank": "  \n", "none": None, "accents": "é, " * 900}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "key string, text string, piece_index int")  # a clashing column
    got = splitting.split_texts(df, ["key"], "text").toPandas()
    assert set(got.key) == {"para", "marks", "long", "accents"}
    for key, g in got.groupby("key"):
        text, at = texts[key], 0
        for p in g.sort_values("piece_index").itertuples():
            assert p.text == text[p.char_start : p.char_end] and len(splitting.TOKEN.findall(p.text)) == p.token_count <= 400
            assert p.overlap_tokens == (40 if p.piece_index else 0) and len(splitting.TOKEN.findall(text[p.char_start : at])) == p.overlap_tokens
            at = p.char_end
        assert at == len(text)
    every = splitting.split_texts(df, ["key"], "text", only_oversized=False).toPandas()
    assert set(every.key) == {"para", "solid", "marks", "long", "fits", "accents"}


def test_split_edits_move_only_near_cuts():
    words = prose(6000).split()
    new = words[:3000] + ["inserted"] + words[3000:]
    at = lambda ws: {text[: s[a][0]] and " ".join(ws[a : a + 5]) for text in [" ".join(ws)] for c, s in [splitting.cuts(text, 400, 40, 120)] for a in c[1:]}
    a, b = at(words), at(new)
    assert len(a - b) <= 4 and len(a & b) > 10


def test_split_prefers_paragraphs():
    text = "\n\n".join(prose(100, random.Random(i)) + "." for i in range(12))
    c, spans = splitting.cuts(text, 400, 40, 120)
    assert all("\n\n" in text[spans[a - 1][1] : spans[a][0]] for a in c[1:])


def test_split_prefers_paragraphs_to_sentences():
    """Where both are within reach, the cut is at the end of a paragraph."""
    rng = random.Random(31)
    text = "\n\n".join(" ".join(prose(11, rng) + "." for _ in range(9)) for _ in range(20))
    c, spans = splitting.cuts(text, 400, 40, 120)
    assert len(c) > 5 and all("\n\n" in text[spans[a - 1][1] : spans[a][0]] for a in c[1:])


def test_split_takes_the_last_delivery(spark):
    """A chunk whose last delivery fits the limit (or has no text) is not split, whatever it was before."""
    day = lambda n: dt.datetime(2025, 1, n)
    blocks = spark.createDataFrame([], "doc_id long, block_idx int, text string, kind string, level int")
    rows = [("short", prose(900), day(1)), ("short", "fits now", day(2)), ("long", "fitted", day(1)), ("long", prose(900), day(2)), ("gone", prose(900), day(1)), ("gone", None, day(3))]
    chunks = spark.createDataFrame([(k, 1, ["a"], t, d) for k, t, d in rows], "chunk_id string, doc_id long, section_path array<string>, text string, ingested_at timestamp")
    assert {r.item_key for r in splitting.split_blocks_and_chunks(blocks, chunks).collect()} == {"long"}


def test_split_tables(spark):
    blocks = spark.createDataFrame([(1, 0, "Top", "heading", 1), (1, 1, prose(900), "paragraph", None), (2, 0, None, "paragraph", None), (None, 1, prose(900), "paragraph", None)], "doc_id long, block_idx int, text string, kind string, level int")
    old, new = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    chunks = spark.createDataFrame([("c", 1, ["a", "b"], prose(500), old), ("c", 1, ["n"], prose(950), new), ("c", 1, ["n"], prose(950, random.Random(9)), None), ("s", 1, None, "short", new)], "chunk_id string, doc_id long, section_path array<string>, text string, ingested_at timestamp")
    got = splitting.split_blocks_and_chunks(blocks, chunks).toPandas()
    assert set(zip(got.item_kind, got.item_key)) == {("block", "1#1"), ("chunk", "c")}
    assert {tuple(p) for p in got[got.item_kind == "block"].section_path} == {("Top",)} and {tuple(p) for p in got[got.item_kind == "chunk"].section_path} == {("n",)}
    assert splitting.split_blocks_and_chunks(blocks.limit(0), chunks.limit(0)).count() == 0


# ---------------------------------------------------------------- personal data
NAMES = [(g, "given") for g in "Tamla Tamric Tamra Orla Orric Orra Fenric Fenla Fenra Quinette Will".split()] + [(f, "family") for f in "Wexford Wexberg Wexley Hollford Hollberg Hollley Drexford Drexberg Drexley N'Dovi".split()]


@pytest.mark.parametrize(
    "text,found",
    [
        ("mail <a.b+c@mail.example.org>, mailto:x@y.test now", [("email", "a.b+c@mail.example.org"), ("email", "x@y.test")]),
        ("odd x1 (at) mail (dot) firm (dot) example and y @ z.test", [("email", "x1 (at) mail (dot) firm (dot) example"), ("email", "y @ z.test")]),
        ("icon@2x.png kyc-desk@ @channel v2.4@build too low @ 0.31", []),
        ("call (884) 555-0111 or +1 526 555 0165, 0033 1 99 00 28 12; 030/23125-109", [("phone", "(884) 555-0111"), ("phone", "+1 526 555 0165"), ("phone", "0033 1 99 00 28 12"), ("phone", "030/23125-109")]),
        ("EUR 423.938.00 on 2024-05-05 16:40, CASE 5414-80-1077, batch 783-63-61083, 69.12.30, LEI 000051354967TEST", []),
        ("ID X40420525, SSN QQ 24 69 17 C, 00652135-M, 943-37-6143, 26.06.92-297.27", [("id_number", x) for x in ("X40420525", "QQ 24 69 17 C", "00652135-M", "943-37-6143", "26.06.92-297.27")]),
        ("at Flat 15, 224 Juniper Street, Town; Lindenweg 9; 34 rue des Aulnes; P.O. Box 31; Ostbrinker Straße 7", [("address", x) for x in ("Flat 15, 224 Juniper Street", "Lindenweg 9", "34 rue des Aulnes", "P.O. Box 31", "Ostbrinker Straße 7")]),
        ("35 Street trading licences, box 4 of the form, page 38, Lane 2 of the chart, Unit 3 of the course", []),
        ("Dr Wexford met Orla T. Hollberg-Wexley, DREXLEY, TAMRA and O. Drexford", [("name", "Wexford"), ("name", "Orla T. Hollberg-Wexley"), ("name", "DREXLEY, TAMRA"), ("name", "O. Drexford")]),
        ("Wexford Capital, Hollberg & Sole Ltd, Wexley Shipping GmbH; Will they?", []),
        ("contact Zora N'Dovi or Tamra Wexley at tamra.wexley@x.test", [("name", "Zora N'Dovi"), ("name", "Tamra Wexley"), ("email", "tamra.wexley@x.test")]),
        ("trace 00048797, +999 20 3969 567, paid (030/23125-471), (+49) 30 23125 459", [("phone", "+999 20 3969 567"), ("phone", "030/23125-471"), ("phone", "(+49) 30 23125 459")]),
        ("Orric L. de Quorra and Tamra van Esk; Dr von Holm; de Lund, Fenla; Respuesta de Quorra; copia de Wexford Capital", [("name", "Orric L. de Quorra"), ("name", "Tamra van Esk"), ("name", "von Holm"), ("name", "de Lund, Fenla")]),
        ("", []),
    ],
)
def test_mentions(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.Finder(NAMES)(text)] == found


def test_pseudonyms():
    for size in (1, 2, 10, 97, 1000):
        image = [pii.permute(i, size, b"k", "x") for i in range(size)]
        assert sorted(image) == list(range(size)) and [pii.unpermute(y, size, b"k", "x") for y in image] == list(range(size))
    a = pii.pseudonym("phone", "+1 526 555 0165", b"k")
    assert a == pii.pseudonym("phone", "+1 526 555 0165", b"k") != "+1 526 555 0165" and re.fullmatch(r"\+1 \d{3} \d{3} \d{4}", a) and a != pii.pseudonym("phone", "+1 526 555 0165", b"other")
    dated = pii.pseudonym("id_number", "26.06.92-297.27", b"k")
    assert re.fullmatch(r"\d\d\.\d\d\.\d\d-\d{3}\.\d\d", dated)
    good = pii.pseudonym("id_number", "26.06.09-297.27", b"k")
    dt.datetime.strptime(good[:8], "%y.%m.%d")
    assert pii.pseudonym("name", "Wexley, Orla", b"k") == pii.pseudonym("name", "Orla  Wexley", b"k")
    assert pii.pseudonym("email", "A@b.test", b"k") == pii.pseudonym("email", "a (at) b (dot) test", b"k")


def test_numbers_keep_their_checks():
    """Valid numbers become valid ones, invalid ones invalid ones, one for one, whatever the notation."""
    key = b"k"
    new = lambda v: pii.pseudonym("id_number", v, key)
    spanish = [f"{n:08}{pii._SPANISH[n % 23]}" for n in range(5_000_000, 5_000_400)]
    image = {new(v) for v in spanish}
    assert len(image) == 400 and all(pii._SPANISH[int(v[:8]) % 23] == v[8] for v in image) and not image & set(spanish)
    assert new("00652135-M") != "00652135-M" and new("00652135M") == new("00652135-M").replace("-", "")
    bad = new("12345678A")
    assert pii._SPANISH[int(bad[:8]) % 23] != bad[8]
    foreign = "X1234567" + pii._SPANISH[1234567 % 23]
    out = new(foreign)
    assert re.fullmatch(r"[XYZ]\d{7}[A-Z]", out) and pii._SPANISH[("XYZ".index(out[0]) * 10**7 + int(out[1:8])) % 23] == out[8]
    belgian = f"85.07.30-033.{97 - 850730033 % 97:02}"
    out = re.sub(r"\D", "", new(belgian))
    assert 97 - int(out[:9]) % 97 == int(out[9:]) and dt.datetime.strptime(out[:6], "%y%m%d")
    tax = "8609574271"
    out = new(tax + str(pii._tax_check(tax)))
    assert len(out) == 11 and int(out[10]) == pii._tax_check(out[:10]) and out[0] != "0"
    nir = "2 55 08 14 168 025 "
    out = re.sub(r"\D", "", new(nir + f"{pii._nir_key(re.sub(' ', '', nir)):02}"))
    assert pii._nir_key(out[:13]) == int(out[13:]) and 1 <= int(out[3:5]) <= 12
    assert pii._ssn_ok(int(new("123-45-6789").replace("-", ""))) and not pii._ssn_ok(int(new("943-37-6143").replace("-", "")))
    nino = new("QQ 24 69 17 C")
    assert re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-D]", nino) and nino[:2] != "QQ" and new("qq246917c") == nino.replace(" ", "").lower()
    assert re.fullmatch(r"[A-Z]\d{8}", new("X40420525"))
    one = {re.sub(r"\D", "", pii.pseudonym("phone", v, key))[-10:] for v in ("+1 526 555 0165", "526-555-0165", "(526) 555-0165", "1 526 555 0165", "001-526-555-0165")}
    assert len(one) == 1
    same = {re.sub(r"\D", "", pii.pseudonym("phone", v, key))[-9:] for v in ("+44 20 7946 095", "020 7946 095", "0044 20 7946 095", "(+44) 20 7946 095")}
    assert len(same) == 1
    for n in (11, 13, 15):
        x = 10**n // 7
        assert pii.unpermute(pii.permute(x, 10**n, key, "x"), 10**n, key, "x") == x


@pytest.mark.parametrize(
    "text,found",
    [
        ("SSN 123-45-6789 and 078-05-1120, not 000-12-3456", [("id_number", "123-45-6789"), ("id_number", "078-05-1120")]),
        ("call +1-202-555-0143 202.555.0144 or +49 30 2312 5459", [("phone", "+1-202-555-0143"), ("phone", "202.555.0144"), ("phone", "+49 30 2312 5459")]),
        ("pay to GB82 WEST 1234 5698 7654 32 now", []),
        ("NIE X1234567L, tax 86095742719, bad 86095742710", [("id_number", "X1234567L"), ("id_number", "86095742719")]),
        ("Dr Johnson, Mr. Ana Maria Lopez and Quinette Garcia Lopez; Dr Johnson & Sons; Quinette Will They", [("name", "Johnson"), ("name", "Ana Maria Lopez"), ("name", "Quinette Garcia Lopez")]),
    ],
)
def test_mentions_beyond_the_tables(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.Finder(NAMES)(text)] == found


def test_long_lists_of_names(spark):
    """Beyond the names that go to every task, a text gets the listed names among its words."""
    names = spark.createDataFrame(NAMES + [("Zzyzx", "family"), ("Aabab", "given"), ("Qurz", "family")], "name string, name_kind string")
    t = spark.createDataFrame([("chunks", "1", "Aabab Zzyzx met Dr. ZZYZX and Orla Qurz", 0), ("chunks", "2", "nobody", 0)], "tbl string, row_key string, text string, listed int")
    all_ = sorted(map(tuple, pii.find_mentions(t, names).collect()))
    assert all_ == sorted(map(tuple, pii.find_mentions(t, names, most=5).collect())) and [r[3] for r in all_] == [0, 20, 30]
    assert pii.redact(t, names, b"k", most=5).count() == 2
    with pytest.raises(ValueError):
        pii.redact(t, names, b"")


def test_pii_tables(spark):
    names = spark.createDataFrame(NAMES + [(None, "given")], "name string, name_kind string")
    text = "Tamra Wexley, call +1 526 555 0165. " + prose(30_000)
    t = spark.createDataFrame([("chunks", "1", text, 0), ("chunks", "1", text, 0), ("chunks", "2", None, 0), ("chunks", None, text, 0), ("feedback", "1", "", 0)], "tbl string, row_key string, text string, start_pos int")
    got = sorted((r.tbl, r.row_key, r.pii_kind, r.start_pos) for r in pii.find_mentions(t, names).collect())
    assert got == [("chunks", "1", "name", 0), ("chunks", "1", "phone", 19)]
    red = pii.redact(t, names, b"k").where("n_mentions > 0").distinct().collect()
    assert len(red) == 1 and red[0].text.startswith("[NAME:") and "[PHONE:+1 " in red[0].text and red[0].text.endswith(text[-500:])
    assert pii.find_mentions(t.limit(0), names.limit(0)).count() == 0


def test_redacted_keeps_texts_without_mention(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("known_names", NAMES, "name string, name_kind string")
    write("chunks", [("c1", "nothing here"), ("c1", "nothing here"), ("c2", "call (884) 555-0111"), ("c3", None)], "chunk_id string, text string")
    write("feedback", [(1, "fine"), (2, "")], "id long, comment string")
    write("escalations", [(7, "no one")], "id long, note string")
    got = sorted((r.tbl, r.row_key, r.n_mentions, r.text) for r in queries.p2_redacted(spark, str(tmp_path)).collect())
    assert [g[:3] for g in got] == [("chunks", "c1", 0), ("chunks", "c2", 1), ("escalations", "7", 0), ("feedback", "1", 0), ("feedback", "2", 0)]
    assert [g[3] for g in got if not g[2]] == ["nothing here", "no one", "fine", ""] and got[1][3].startswith("call [PHONE:")


# ---------------------------------------------------------------- vectors
def brute(x, ids, k, floor):
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in np.lexsort((ids, -s[i]))[:k] if s[i, j] >= floor}


def test_vectors_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 16))
    x = (centres[rng.integers(0, 150, 3000)] + 0.25 * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 3, (3000, 1))
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "id long, model string, vec array<float>")
    got = {(r.query_id, r.vec_id) for r in vectors.nearest(df, "id", "model", "vec", k=5, floor=0.9, list_rows=200, sample=2000).collect()}
    want = brute(x, np.arange(3000), 5, 0.9)
    assert len(want) > 5000 and len(got & want) / len(want) >= 0.97 and len(got) <= 1.01 * len(want)


def test_vectors_with_two_levels_of_lists(spark):
    """More lists than coarse centroids: coarse and fine ones together, at a recall of 0.95 and more."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(120, 16))
    x = centres[rng.integers(0, 120, 2500)] + 0.25 * rng.normal(size=(2500, 16))
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "id long, model string, vec array<float>")
    got = {(r.query_id, r.vec_id) for r in vectors.nearest(df, "id", "model", "vec", k=5, floor=0.9, list_rows=40, most_lists=8, sample=1500, probes=6).collect()}
    want = brute(x, np.arange(2500), 5, 0.9)
    assert len(got & want) / len(want) >= 0.95 and len(got) <= 1.01 * len(want)
    z = vectors.Quantizer(vectors._unit(x.astype(np.float32)), 60, 8, 8, 4, 1)
    assert z.lists == 64 and len(np.unique(z.near(vectors._unit(x.astype(np.float32)), 1))) > 30


def test_fitting_many_lists_takes_little_memory():
    """Scores of the sample against the centroids are made in parts, with one level of lists and with two."""
    import tracemalloc

    x = vectors._unit(np.random.default_rng(8).normal(size=(30_000, 16)).astype(np.float32))
    for lists in (1000, 3000):
        tracemalloc.start()
        z = vectors.Quantizer(x, lists, 1000, 8, 1, 1)
        vectors._grid(z, 10**6, x, 4096, 4)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert z.lists == lists and peak < 80e6, peak
        assert (z.near(x[:100], 4) == z.near(x, 4)[:100]).mean() > 0.99


def test_vectors_blocks_lose_nothing(spark):
    x = np.random.default_rng(5).normal(size=(400, 8))
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "id long, model string, vec array<float>")
    got = {(r.query_id, r.vec_id) for r in vectors.nearest(df, "id", "model", "vec", k=3, list_rows=200, probes=2, rerank=400, block=60).collect()}
    assert got == brute(x, np.arange(400), 3, -9)


def test_vectors_between_many_lists_are_found():
    """Vectors between centroids are posted under more lists than those amid one, so that near ones meet however many lists there are."""
    rng = np.random.default_rng(9)
    x = vectors._unit((np.repeat(rng.normal(size=(4000, 16)), 2, axis=0) + 0.2 * rng.normal(size=(8000, 16))).astype(np.float32))
    z = vectors.Quantizer(x, 800, 4096, 8, 8, 1)
    z.set_margin(x, 5)
    lists, posted = z.posted(x, 5)
    meet = lambda on: ((lists[1::2] == lists[::2, :1]) & on[1::2]).any(1) | ((lists[::2] == lists[1::2, :1]) & on[::2]).any(1)
    assert abs(posted.mean() * lists.shape[1] - 5) < 0.1
    assert meet(posted).mean() > meet(np.arange(20) < np.full((8000, 1), 5)).mean() and meet(posted).mean() >= 0.97
    assert vectors.list_count(200_000, 400, 2048, 4096, 4096) == 500 and vectors.list_count(6_000_000, 400, 2048, 4096, 4096) == 2048 and vectors.list_count(16_777_216, 400, 2048, 4096, 4096) == 4096


def test_vectors_edges(spark):
    one = [1.0, 2.0, 2.0]
    rows = [(i, "m", one) for i in range(20)] + [(30, "m", [2.0, 4.0, 4.0]), (31, "m", None), (32, "m", []), (33, "m", [0.0] * 3), (34, "m", [1.0]), (None, "m", one), (35, None, one), (36, "m", [float("nan"), 1.0, 1.0]), (40, "solo", [1.0, 1.0]), (0, "m", one)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, model string, vec array<float>, cosine string")
    got = vectors.nearest(df, "id", "model", "vec", k=5, floor=0.9).toPandas()
    assert set(got.query_id) == set(range(20)) | {30} and (got.groupby("query_id").size() == 5).all() and (got.query_id != got.vec_id).all()
    assert sorted(got[got.query_id == 7].vec_id) == [0, 1, 2, 3, 4]
    assert vectors.nearest(df.limit(0), "id", "model", "vec").count() == 0


# ---------------------------------------------------------------- near-duplicates
def true_pairs(texts, width, threshold, least):
    sets = {k: set(zip(*(w[i:] for i in range(width)))) for k, t in texts.items() if t and len(w := S.words(t)) >= max(least, width)}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates_match_brute_force(spark):
    texts = {}
    for g in range(60):
        base = prose(120)
        for c in range(random.choice((1, 2, 4))):
            texts[f"{g}-{c}"] = edited(base, random.choice((0, 0.01, 0.03, 0.2)))
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "id string, text string, rep int")
    for width, threshold, least in ((3, 0.6, 30), (5, 0.8, 0)):
        m, links = neardup.similar_pairs(df, "id", "text", width=width, threshold=threshold, min_words=least)
        got = {(r.a, r.b) for r in neardup.expand_pairs(m, links).collect()}
        want = true_pairs(texts, width, threshold, least)
        assert got <= want and len(got) >= 0.97 * len(want) > 20


def test_near_duplicates_hot_bucket(spark):
    base = prose(200)
    texts = {f"{i:03}": base + f" end{i}" for i in range(90)}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    m, links = neardup.similar_pairs(df, "id", "text", bucket=8)
    assert neardup.expand_pairs(m, links).count() == 90 * 89 // 2
    classes = graph.connected_classes(links)
    assert classes.count() == 90 and classes.select("class_id").distinct().count() == 1


def test_near_duplicates_edges(spark):
    t = prose(50)
    rows = [("a", t), ("a", t), ("b", t.upper()), ("c", None), (None, t), ("d", ""), ("e", "short text"), ("f", prose(20_000))]
    df = spark.createDataFrame(rows, "id string, text string")
    m, links = neardup.similar_pairs(df, "id", "text", min_words=30)
    assert {(r.a, r.b) for r in neardup.expand_pairs(m, links).collect()} == {("a", "b")} and links.count() == 0 and m.count() == 3
    m, links = neardup.similar_pairs(df.limit(0), "id", "text")
    assert m.count() == links.count() == 0 and graph.connected_classes(links).count() == 0


def test_stopping_rules():
    """Pairs at the threshold are lost by no batch more often than its part allows."""
    rules = neardup.min_matches(0.6, 112, 16, 0.001)
    assert [n for n, _ in rules] == list(range(16, 113, 16)) and all(0 < m < 0.6 * n for n, m in rules)
    bits = neardup.most_differing(0.6, 64, 0.001)
    assert 15 <= bits <= 30
    rng = np.random.default_rng(1)
    part, lost = 0.01 / 8, 0
    values = rng.random((20_000, 112)) < 0.6
    agree = values[:, :64] | (rng.random((20_000, 64)) < 0.5)
    ok = (~agree).sum(1) <= neardup.most_differing(0.6, 64, part)
    for n, m in neardup.min_matches(0.6, 112, 16, part):
        ok &= values[:, :n].sum(1) >= m
    lost = 1 - ok.mean()
    assert lost <= 0.02, lost


def test_copies_in_blocks(spark):
    """A text with many copies, linked to one with many: all pairs, whatever the blocks."""
    t = prose(60)
    df = spark.createDataFrame([(f"a{i:02}", t) for i in range(25)] + [(f"b{i:02}", t + " more") for i in range(12)], "id string, text string")
    m, links = neardup.similar_pairs(df, "id", "text")
    assert links.count() == 1 and neardup.expand_pairs(m, links, block=4).count() == 37 * 36 // 2


def test_classes_of_a_path(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r.id: r.class_id for r in graph.connected_classes(links).collect()}
    assert len(got) == 43 and {got[k] for k in got if k[0] != "x" and k[0] != "y"} == {"000"} and got["y"] == got["x"] == "x"


# ---------------------------------------------------------------- containers
def test_packing(spark):
    sizes = [random.choice((1, 5, 40, 300, 300, 300, 999, 1000, 2500)) for _ in range(3000)] + [0, None]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "id long, n int, container string")
    got = packing.pack(df, "id", "n", 1000).toPandas()
    whole = {i: s for i, s in enumerate(sizes) if s}
    assert got.groupby("id")["size"].sum().to_dict() == whole and not got.duplicated(["id", "piece"]).any()
    assert (got[got.id.map(whole) <= 1000].groupby("id").size() == 1).all() and got["size"].max() <= 1000
    used = got.groupby("container")["size"].sum()
    bins = []  # first fit by decreasing size, piece by piece
    for s in sorted(got["size"].tolist(), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= s), None)
        if k is None:
            bins.append(1000 - s)
        else:
            bins[k] -= s
    assert used.max() <= 1000 and len(used) <= 1.05 * len(bins) + 1, (len(used), len(bins))
    assert sorted(used.index) == list(range(len(used)))


def test_packing_over_many_ranges(spark):
    """Small ranges, matched across, fill as well as one."""
    rng = random.Random(9)
    sizes = [min(1000, max(1, int(rng.lognormvariate(4.5, 1.2)))) for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n int")
    got = packing.pack(df, "id", "n", 1000, range_rows=40, salt_rows=100).toPandas()
    assert sorted(zip(got.id, got["size"])) == list(enumerate(sizes))
    used = got.groupby("container")["size"].sum()
    assert used.max() <= 1000 and len(used) <= 1.03 * sum(sizes) / 1000 + 1 and sorted(used.index) == list(range(len(used)))


def test_brackets():
    matches, gaps, docs = packing.brackets([(0, 3, 5), (1, 2, 4), (2, 7, 1), (3, 9, 0)])
    assert matches == [(0, 0, 1, 0, 2), (1, 0, 2, 0, 4), (0, 2, 2, 4, 3), (2, 0, 3, 0, 1)] and docs == {0: 0, 1: 2, 2: 7, 3: 1} and gaps == {0: 5, 1: 4, 2: 1}


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "id long, n int")
    assert packing.pack(empty, "id", "n", 10).count() == 0
    same = spark.createDataFrame([(1, 10)] * 7, "id long, n int")  # repeated rows of a full container each
    assert packing.pack(same, "id", "n", 10).select("container").distinct().count() == 7
    f = packing.fill(packing.pack(same, "id", "n", 10), 10).toPandas()
    assert (f.fill == 1.0).all()


# ---------------------------------------------------------------- mixture
def earliest_first(counts):
    """One run over all slots."""
    n = sum(counts.values())
    jobs = sorted((j * n // m, -(-(j + 1) * n // m), s, j) for s, m in counts.items() for j in range(m))
    at, ready, out = 0, [], []
    for t in range(n):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        due, s, j = heapq.heappop(ready)
        assert due > t
        out.append((s, j))
    return out


@pytest.mark.parametrize("counts,segment", [({"a": 50, "b": 31, "c": 12, "d": 7, "zero": 0}, 8), ({f"s{i}": i * i + 1 for i in range(9)}, 16), ({"one": 1}, 4)])
def test_segments_give_the_order_of_one_run(spark, counts, segment):
    order = mixing.schedule(spark.createDataFrame(list(counts.items()), "source string, n_blocks long"), segment)
    got = [(r.source, r.block) for r in order.orderBy("slot").collect()]
    assert got == earliest_first(counts)
    done, n = dict.fromkeys(counts, 0), len(got)
    for t, (s, _) in enumerate(got, 1):
        done[s] += 1
        assert all(abs(done[k] - Fraction(m, n) * t) < 1 for k, m in counts.items())
    assert mixing.lags(order).where("n_outside > 0 or most_ahead >= 1 or most_behind >= 1").count() == 0


def test_quotas_fill_small_sources_first(spark):
    rows = [("big", 0.5, 1, 1000), ("mid", 0.3, 2, 1000), ("small", 0.2, 2, 20), ("none", 0.1, 1, 0), ("off", 0.0, 5, 50)]
    df = spark.createDataFrame(rows, "source string, share double, most int, held long")
    quota = lambda b: {r.source: r.quota for r in mixing.quotas(df, b).collect()}
    assert quota(840) == {"big": 500, "mid": 300, "small": 40, "none": 0, "off": 0}
    assert quota(100) == {"big": 50, "mid": 30, "small": 20, "none": 0, "off": 0}
    assert quota(10_000) == {"big": 1000, "mid": 2000, "small": 40, "none": 0, "off": 0}
    assert quota(0) == dict.fromkeys(("big", "mid", "small", "none", "off"), 0) and mixing.quotas(df.limit(0), None).count() == 0


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "tiny"]), rng.randint(1, 60)) for i in range(3000)] + [(9001, None, 5), (9002, "other", 5), (9003, "mid", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.45, 1), ("mid", 0.25, 3), ("tiny", 0.25, 2), ("gone", 0.05, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    uses, report, order = mixing.mix(sizes, targets, budget=80_000, block=300, segment=64)
    u = uses.toPandas()
    r = report.toPandas().set_index("source")
    held = u.groupby("source").n_tokens.sum()
    assert (u.groupby("source").uses.max() <= u.source.map({"big": 1, "mid": 3, "tiny": 2}).groupby(u.source).first()).all()
    assert r.used_tokens["tiny"] == 2 * held["tiny"] and r.used_tokens["gone"] == 0 and abs(r.actual_share.sum() - 1) < 1e-9
    assert abs(r.used_tokens["big"] / r.used_tokens["mid"] - 9 / 5) < 0.02
    s = mixing.sequence(uses, order, block=300).toPandas()
    s = s[s.slot.notna()]
    assert len(s) == u.uses.sum() and s.groupby("id").size().to_dict() == u[u.uses > 0].set_index("id").uses.to_dict()
    # after any slot each source is close to its part of the tokens
    total, took = s.n_tokens.sum(), s.sort_values(["slot", "position"])
    for k in ("big", "mid", "tiny"):
        gap = (took.n_tokens * (took.source == k)).cumsum() - took.n_tokens.cumsum() * (s[s.source == k].n_tokens.sum() / total)
        assert gap.abs().max() < 2 * 300 + 60
    none, report, order = mixing.mix(sizes.limit(0), targets)
    assert none.count() == 0 and report.agg(F.sum("used_tokens")).first()[0] == 0 and order.count() == 0


def test_mix_keeps_small_sources(spark):
    """Sources far below a block keep all their uses; a lost slot is an error."""
    rows = [(i, "big", 100) for i in range(4000)] + [(5000 + i, "mid", 100) for i in range(2000)] + [(9001, "s1", 7), (9002, "s2", 3), (9003, "s2", 2), (9004, "s3", 2400)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 1), ("s1", 0.03, 2), ("s2", 0.03, 1), ("s3", 0.04, 1)], "source string, target_share double, max_repeats int")
    uses, _, order = mixing.mix(sizes, targets, segment=100)
    s, u = mixing.sequence(uses, order).where("slot is not null").toPandas(), uses.toPandas()
    assert s.groupby("id").size().to_dict() == u[u.uses > 0].set_index("id").uses.to_dict() and set(s.source) == {"big", "mid", "s1", "s2", "s3"}
    with pytest.raises(Exception, match="no slot for source s1"):
        mixing.sequence(uses, order.where("source <> 's1'")).collect()


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, café!"), (2, ""), (3, None), (4, "line one\n" * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text", {"doc_id": "long"}).collect()}
    assert set(got) == {1, 2, 4} and got[1] == 5 and got[2] == 0 and got[4] == 3 * 200_000


def test_long_texts_have_the_tokens_of_the_whole(spark):
    """White space over line breaks, form feeds and line separators divide no long text."""
    import base64

    import tiktoken

    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        enc = tiktoken.Encoding("v", pat_str=tokens.DEFAULT_PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rng = random.Random(8)
    odd = ["a", "b2", "'s", "é", ".", "\n", "\n\n", " ", "  ", "\f", "\u2028", "\x1c", "\t", "\u00a0", "word", "\r\n"]
    texts = ["a\n\n\nb" * 210_000, "".join(rng.choice(odd) for _ in range(700_000)), "line one\n" * 120_000]
    assert all(len(t) >= 1_000_000 for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text", {"doc_id": "long"}).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert len(list(tokens.stretches(texts[1]))) > 5 and "".join(tokens.stretches(texts[1])) == texts[1]


# ---------------------------------------------------------------- cut-off texts
def test_cut_texts(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join(rng.choice(VOCAB[:600]) for _ in range(rng.randint(7, 17))).capitalize() + "."
    full = [" ".join(sentence() for _ in range(10)) for _ in range(150)]
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate(full)]
    rows += [(1000 + i, "s0", full[i][: rng.randint(250, 500)].rstrip(". ")) for i in range(30)]  # cut copies
    rows += [(2000 + i, "s1", full[i] + "\n\nPrepared by the desk") for i in range(30, 60)]  # copies with a closing line
    rows += [(3000 + i, "lim", (sentence() * 12)[:500]) for i in range(8)]  # piled up at 500
    rows += [(4000, "s2", None), (4001, "s2", "  "), (4002, None, "Short end."), (4003, "s2", "The quick thing…"), (4004, "s2", "broken �"), (4002, None, "Short end.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, is_cut string")
    got = truncation.cut_texts(df).toPandas().set_index("doc_id")
    cut = set(got.index[got.is_cut])
    assert {1000 + i for i in range(30)} <= cut and {3000 + i for i in range(8)} <= cut and 4004 in cut
    assert not cut & (set(range(150)) | {2000 + i for i in range(30, 60)} | {4001, 4002}) and 4000 not in got.index
    assert got.by_limit.sum() == 8 and got.loc[[1000 + i for i in range(30)]].by_copy.mean() > 0.9
    assert truncation.cut_texts(df.limit(0)).count() == 0


def test_cut_texts_behind_one_preamble(spark):
    """Different texts that share their first 64 words and are cut at the source's limit count each; copies of one text count once."""
    rng = random.Random(12)
    preamble = prose(80, rng)
    rows = [(i, "form", (preamble + " " + prose(120, rng))[:900]) for i in range(5)] + [(100 + i, "same", (prose(300, random.Random(3)))[:900]) for i in range(5)]
    assert all(len(t) == 900 for _, _, t in rows)
    got = truncation.cut_texts(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas().set_index("doc_id")
    assert got.by_limit.to_dict() == {i: True for i in range(5)} | {100 + i: False for i in range(5)}


def copies_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_cut_copies_with_edits(spark):
    """Edits close to the end, changed beginnings and short texts keep the evidence of the copy; copies that end together give none."""
    rng = random.Random(21)
    rows, cut, whole = [], set(), set()
    for g in range(40):
        full = prose(220, rng).split()
        rows.append((g, None, " ".join(full) + "."))
        near_end = full[: 120 + g]
        near_end[-2 - g % 3] = "edited"
        rows.append((100 + g, None, " ".join(near_end)))
        head = ["changed", "title", "of", "the", "copy"][: 2 + g % 4] + full[4 : 150 + g]
        rows.append((200 + g, None, " ".join(head)))
        rows.append((300 + g, None, " ".join(full[: 12 + g % 8])))
        same_end = list(full)
        same_end[30] = "other"
        rows.append((400 + g, None, " ".join(same_end) + "."))
        rows.append((500 + g, None, " ".join(full[60:90]) + "."))  # an excerpt is no cut copy
        cut |= {100 + g, 200 + g, 300 + g}
        whole |= {g, 400 + g, 500 + g}
    got = {r.doc_id for r in truncation.cut_texts(copies_frame(spark, rows)).where("by_copy").collect()}
    assert len(got & cut) >= 0.98 * len(cut) and not got & whole, (len(got & cut), len(cut), got & whole)


def test_cut_copies_in_a_hot_group(spark):
    """Very many different copies of one text: every cut one is found without meeting all others."""
    rng = random.Random(22)
    full, rows = prose(150, rng).split(), []
    for i in range(200):
        mine = list(full)
        mine[rng.randrange(150)] = f"w{i}"
        rows.append((i, "s", " ".join(mine[: 100 + i % 30] if i % 2 else mine) + ("" if i % 2 else ".")))
    got = {r.doc_id for r in truncation.cut_texts(copies_frame(spark, rows)).where("by_copy").collect()}
    assert got == {i for i in range(200) if i % 2}


def test_cut_copy_behind_others_that_go_on_further(spark):
    """All bands of a cut text and its source are hot and many other texts go on further after them; near-copies with the same end settle nothing."""
    rng = random.Random(23)
    body, tail, starts = prose(120, rng), prose(40, rng), [prose(6, rng), prose(6, rng)]
    words = body.split()
    twin = " ".join([*words[:30], "other", *words[31:]])
    rows = [(i, "s", t) for i, t in enumerate([f"{starts[0]} {body}", f"{starts[0]} {twin}", f"{starts[1]} {body} {tail}.", f"{starts[1]} {twin} {tail}."])]
    for at in range(0, 51, 10):
        for _ in range(70):
            rows.append((len(rows), "s", f"{prose(6 + at, rng)} {' '.join(words[at : at + 70])} {prose(200, rng)}."))
    got = {r.doc_id for r in truncation.cut_texts(copies_frame(spark, rows)).where("by_copy").collect()}
    assert got == {0, 1}


def test_copies_of_a_text_do_not_vouch_for_its_end(spark):
    """Every text under many ids, and some twice under one, is judged as if it came once."""
    rng = random.Random(24)
    sentence = lambda: " ".join(rng.choice(VOCAB[:300]) for _ in range(9)).capitalize() + "."
    rows = [(i, "s", " ".join(sentence() for _ in range(6)) + (" " + " ".join(rng.choice(VOCAB[:300]) for _ in range(4)) if i % 3 == 0 else "")) for i in range(90)]
    columns = ["by_copy", "by_limit", "by_closing", "is_cut"]
    once = {r.doc_id: tuple(r[c] for c in columns) for r in truncation.cut_texts(copies_frame(spark, rows)).collect()}
    many = [(k * 1000 + i, s, t) for i, s, t in rows for k in (0, 0, *range(1, 12))]
    got = truncation.cut_texts(copies_frame(spark, many)).collect()
    assert sum(c[2] for c in once.values()) > 20 and len(got) == 90 * 12
    assert all(tuple(r[c] for c in columns) == once[r.doc_id % 1000] for r in got)


def test_few_texts_cut_at_the_same_words_do_not_vouch_in_a_large_corpus(spark, monkeypatch):
    """One other place of the last two words weighs less the more texts there are."""
    monkeypatch.setattr(truncation, "TEXTS", 50)
    rng = random.Random(12)
    texts = [prose(30 + k % 40, rng) + " alpha " + prose(10, rng) + "." for k in range(600)] + [prose(n, rng) + " zeta alpha" for n in (40, 55)]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id for r in truncation.cut_texts(df).where("by_closing").collect()}
    assert {600, 601} <= got and len(got) <= 4


def test_bands_are_shared_by_common_runs():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    b = np.concatenate([rng.integers(0, 2**63, 17, dtype=np.uint64), a[30:110]])
    flat = np.concatenate([a, b, a[:13], a[:4]])
    first, n = np.array([0, 200, 297, 310]), np.array([200, 97, 13, 4])
    key, at, own, head = truncation.bands(S.shingle_hashes(flat, truncation.SHINGLE), first, n)
    assert (np.diff(own) >= 0).all() and set(own.tolist()) == {0, 1, 2} and (at >= 0).all() and (at < n[own]).all()
    keys = [set(key[own == k].tolist()) for k in range(3)]
    assert len(keys[0] & keys[1]) >= 5 and keys[2] <= keys[0] and len(keys[0]) < 40 and head[own == 2].all()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    flat = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and flat(got) == flat(want)
