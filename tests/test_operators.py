import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarryline.operators import history, layout, search
from quarryline.sources import files

T0 = dt.datetime(2025, 1, 1)
month = lambda k: T0 + dt.timedelta(days=30 * k)
SCHEMA = "snap_id long, snapshot_at timestamp, received_at timestamp, doc_id long, doc_hash string, status string, version int"
A, B = "a" * 64, "b" * 64


def snaps(spark, rows):
    return spark.createDataFrame([(i, *r, 9) for i, r in enumerate(rows)], SCHEMA)


def chains(spark, rows):
    out = history.history_from_deliveries(snaps(spark, rows))
    return sorted((r.entity, r.version, r.digest, r.valid_from, r.valid_to) for r in out.collect())


def test_history_versions(spark):
    rows = [(month(0), month(0), 1, A, "indexed"), (month(1), month(1), 1, "SHA256:" + A.upper(), "indexed"), (month(2), month(2), 1, B + " ", "indexed"), (month(3), month(3), 1, None, "failed"), (month(4), month(4), 1, None, "deleted"), (month(5), month(5), 1, A, "indexed")]
    assert chains(spark, rows) == [(1, 1, A, month(0), month(2)), (1, 2, B, month(2), month(4)), (1, 3, A, month(5), None)]


def test_history_late_correction_and_repeats(spark):
    first = [(month(0), month(0), 1, A, "indexed"), (month(1), month(1), 1, B, "indexed"), (month(0), month(0), 2, B, "indexed")]
    late = [(month(1), month(3), 1, A, "indexed")]  # corrects month 1
    assert chains(spark, first + first + late) == [(1, 1, A, month(0), None), (2, 1, B, month(0), None)]
    # the same whatever the order of delivery
    assert chains(spark, (late + first)[::-1]) == chains(spark, first + late)


def test_history_edges(spark):
    assert chains(spark, []) == []
    assert chains(spark, [(month(0), None, 1, A, "indexed"), (None, month(0), 1, B, "indexed"), (month(1), month(1), None, B, "indexed"), (month(1), month(1), 1, None, "indexed"), (month(0), month(0), 3, None, "deleted")]) == [(1, 1, A, month(0), None)]


def test_history_store_touches_only_affected(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = history.HistoryStore(spark, root, buckets=8)
    assert store.history().count() == 0
    store.apply(history.observations(snaps(spark, [(month(0), month(0), d, A, "indexed") for d in range(40)])))
    before = store.manifest()
    store.apply(history.observations(snaps(spark, [(month(1), month(1), 7, B, "indexed")])))
    after = store.manifest()
    assert sum(before["buckets"][b] != after["buckets"][b] for b in before["buckets"]) == 1
    assert store.history().count() == 41 and store.raw().count() == 41
    with pytest.raises(Exception):
        store.apply(spark.createDataFrame([(1,)], "wrong int"))
    assert store.manifest() == after
    store.vacuum()
    assert store.history().count() == 41 and store.raw().count() == 41


def test_history_store_keeps_its_buckets_and_refuses_a_second_writer(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    at = lambda k, h: history.observations(snaps(spark, [(month(k), month(k), d, h, "indexed") for d in range(9)]))
    history.HistoryStore(spark, root, buckets=4).apply(at(0, A))
    with pytest.raises(ValueError):
        history.HistoryStore(spark, root, buckets=8).apply(at(1, B))
    store, other = history.HistoryStore(spark, root), history.HistoryStore(spark, root)
    held = other.manifest()
    store.apply(at(1, B))
    other.manifest = lambda: held  # a writer that began before the other was done
    with pytest.raises(RuntimeError, match="another update"):
        other.apply(at(2, A))
    assert store.history().count() == 18 and store.history().where("valid_to is null").count() == 9


def test_section_paths(spark):
    rows = [(1, 0, "P", "heading", 1), (1, 1, "F", "heading", 2), (1, 2, "x", "paragraph", None), (1, 3, "S", "heading", 2), (1, 4, "y", "paragraph", None), (1, 5, "Q", "heading", None), (1, 6, "z", "paragraph", None)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx int, text string, kind string, level int")
    got = {r.block_idx: r.section_path for r in layout.section_paths(df).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6)] == [["P"], ["P", "F"], ["P", "F"], ["P", "S"], ["P", "S"], ["Q"]]
    packed = layout.pack_sections(df, most=5, least=1).orderBy("chunk_index").collect()
    assert [(r.section_path, r.first_block) for r in packed] == [(["P", "F"], 2), (["P", "S"], 4), (["Q"], 6)]


def test_fixed_windows_cover_everything(spark):
    df = spark.createDataFrame([(1, "w " * 1000), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.token_start, r.token_count) for r in layout.fixed_windows(df).collect())
    assert got == [(1, 0, 0, 400), (1, 1, 352, 400), (1, 2, 704, 296), (4, 0, 0, 1)]


def test_dense_topk_matches_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(120, 8))
    x[5] = x[6]
    df = spark.createDataFrame([("m", i, v.tolist()) for i, v in enumerate(x)], "group string, id long, vec array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in search.dense_topk(df.where("id % 10 = 0"), df, 3, query_block=4, vector_block=16).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for q in range(0, 120, 10):
        s = y @ y[q]
        s[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == np.lexsort((np.arange(120), -s))[:3].tolist()


def test_visibility(spark):
    rows = [("t1", "tenant", None), ("t2", "public", None), (None, "public", None), ("t1", "private", "u"), ("t1", "private", "v"), ("t1", None, None), ("t1", "private", None)]
    df = spark.createDataFrame(rows, "t string, v string, o string")
    see = lambda *a: [r[0] for r in df.select(search.visible(F.col("t"), F.col("v"), F.col("o"), *a)).collect()]
    assert see(F.lit("t1"), F.lit("u")) == [True, False, True, True, False, True, False]
    assert see(None, None) == [False, False, True, False, False, False, False]
    assert see(F.lit("t1"), F.lit("u"), F.lit(True)) == [True] * 7


def test_fuse(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "q int, i string, r int")
    assert [r.i for r in search.fuse(df, "q", "i", "r", 2).orderBy("fused_rank").collect()] == ["b", "a"]


def test_folder(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{root}/sub")
    put = lambda n, t: open(f"{root}/{n}", "w").write(t)
    put("a.md", '---\ntitle: "My Policy"\nJurisdiction: QM\n---\n# Head\n\npara one\nline two\n\n## Sub ##\n```\ncode\n\n# not head\n```\nafter\n')
    put("open.md", "```\nnever closed\n\nstill code")
    put("sub/b.html", "<title>T</title><nav>no</nav><h2>H</h2><p>Hello <b>w</b></p><ul><li><p>in li</p></li></ul><table><tr><td>a<td>b</tr><tr><td>c</tr></table><script>x</script>")
    put("sub/b.html.meta.json", json.dumps({"doc_type": "guide"}))
    put("a.md.meta.json", "[1]")
    put("skip.bin", "x")
    docs, blocks = files.load_folder(spark, root)
    d = {r.source_file: r for r in docs.collect()}
    assert set(d) == {"a.md", "open.md", "sub/b.html"}
    assert (d["a.md"].title, d["a.md"].jurisdiction, d["a.md"].doc_type, d["sub/b.html"].doc_type, d["open.md"].title, d["a.md"].visibility) == ("My Policy", "QM", "unknown", "guide", "open", "tenant")
    text = lambda n: [(r.text, r.kind, r.level) for r in blocks.where(F.col("doc_id") == d[n].doc_id).orderBy("block_idx").collect()]
    assert text("a.md") == [("Head", "heading", 1), ("para one line two", "paragraph", None), ("Sub", "heading", 2), ("```\ncode\n\n# not head\n```", "paragraph", None), ("after", "paragraph", None)]
    assert text("open.md") == [("```\nnever closed\n\nstill code", "paragraph", None)]
    assert text("sub/b.html") == [("T", "heading", 0), ("H", "heading", 2), ("Hello w", "paragraph", None), ("in li", "paragraph", None), ("a | b\nc", "paragraph", None)]


def test_feedback_stream_over_many_files(spark, tmp_path):
    """More files than a trigger takes, in no order of time: nothing is dropped as late and the least loaded_at of an id counts."""
    from quarryline.streaming import streams

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(i, f"t{i}", "up", f"first {i}", day(500 - 25 * i), day(500 - 25 * i)) for i in range(20)]
    rows += [(i, f"t{i}", "down", f"again {i}", day(500 - 25 * i), day(560 - 25 * i)) for i in range(0, 20, 3)]  # repeated after the watermark
    rows += [(i, f"t{i}", "down", f"earlier {i}", day(500 - 25 * i), day(499 - 25 * i)) for i in (1, 2)] + [(3, "t3", "down", "unknown", day(425), None)]
    at = tmp_path / "feedback.parquet"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "id long, trace_id string, rating string, comment string, created_at timestamp, loaded_at timestamp").coalesce(1).write.mode("append").parquet(str(at))
    got = {r.id: r.comment for r in streams.stream_feedback(spark, str(tmp_path)).collect()}
    assert got == {i: f"earlier {i}" if i in (1, 2) else f"first {i}" for i in range(20)}
    assert streams.stream_feedback(spark, str(tmp_path)).count() == 20


def test_pack_sections_splits_oversized_blocks(spark):
    """No chunk above the limit, no token lost; tiny sections join by their own size, not by the last chunk's."""
    big = " ".join(["One two three four."] * 5 + ["Long " * 23 + "end."])
    rows = [(1, 0, "H", "heading", 1), (1, 1, big, "paragraph", None), (1, 2, "a b", "paragraph", None), (1, 3, "K", "heading", 1), (1, 4, "c d", "paragraph", None), (1, 5, "L", "heading", 1), (1, 6, "e", "paragraph", None)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx int, text string, kind string, level int")
    got = layout.pack_sections(df, most=10, least=3).orderBy("chunk_index").collect()
    assert [(r.section_path, r.first_block, r.last_block, r.first_token, r.end_token, r.token_count) for r in got] == [
        (["H"], 1, 1, 0, 10, 10), (["H"], 1, 1, 10, 20, 10), (["H"], 1, 1, 20, 25, 5), (["H"], 1, 1, 25, 35, 10), (["H"], 1, 1, 35, 45, 10), (["H"], 1, 2, 45, 2, 7), (["K"], 4, 6, 0, 1, 4),
    ]


def test_pack_sections_keeps_the_text(spark):
    """Every chunk's text has its tokens, and all bodies come out whole and in order."""
    big = "First part here. " + "word, " * 30 + "stop. Last one."
    rows = [(1, 0, "H", "heading", 1), (1, 1, big, "paragraph", None), (1, 2, " a  b ", "paragraph", None), (1, 3, None, "paragraph", None), (1, 4, "K", "heading", 2), (1, 5, "c", "paragraph", None)]
    got = layout.pack_sections(spark.createDataFrame(rows, "doc_id long, block_idx int, text string, kind string, level int"), most=12, least=0).orderBy("chunk_index").collect()
    assert all(len(layout._TOKENS.findall(r.text)) == r.token_count <= 12 for r in got)
    assert layout._TOKENS.findall(" ".join(r.text for r in got)) == layout._TOKENS.findall(f"{big} a b c") and "\n\na  b" in got[-2].text


def test_semantic_chunks(spark):
    a, b = "Sanctions screening covers every payment today.", "Retention schedules follow local archive rules."
    df = spark.createDataFrame([(1, " ".join([a] * 6 + [b] * 6)), (2, "word " * 25 + "end."), (3, ""), (4, None), (5, "Short one.")], "doc_id long, text string")
    full = lambda **k: sorted(tuple(r) for r in layout.semantic_chunks(df, **k).collect())
    got = lambda **k: [r[:-1] for r in full(**k)]
    assert [len(layout._TOKENS.findall(r[-1])) for r in full(most=10, least=2)] == [r[-2] for r in full(most=10, least=2)] and full(most=60, least=20)[0][-1] == " ".join([a] * 6)
    assert got(most=60, least=20) == [(1, 0, 0, 5, 0, 42), (1, 1, 6, 11, 0, 42), (2, 0, 0, 0, 0, 27), (5, 0, 0, 0, 0, 3)]
    assert [r[4:] for r in got(most=10, least=2) if r[0] == 2] == [(0, 10), (10, 10), (20, 7)]
    assert [r[3:] for r in got(most=50, least=45) if r[0] == 1] == [(6, 0, 49), (11, 0, 35)]  # the tail does not fit
    assert [r[1:] for r in got(most=100, least=43) if r[0] == 1] == [(0, 0, 11, 0, 84)]


def test_ingest_over_many_files_and_after_a_failure(spark, tmp_path):
    """Changed documents replace their old rows; a batch given twice lands the same rows."""
    from quarryline.streaming import streams

    at = tmp_path / "documents.parquet"
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [(i, "s", f"text {i}", "indexed", day(i)) for i in range(12)] + [(i, "t", f"new {i}", "indexed", day(50 + i)) for i in range(4)] + [(5, "s", "text 5", "indexed", day(70)), (6, "s", "text 6", "failed", day(70))]
    for r in rows:
        spark.createDataFrame([r], "doc_id long, source string, text string, status string, updated_at timestamp").coalesce(1).write.mode("append").parquet(str(at))
    got = {r.doc_id: r.source for r in streams.stream_ingest(spark, str(tmp_path)).collect()}
    assert got == {i: "t" if i < 4 else "s" for i in range(12)}
    land = streams.land_documents(f"{tmp_path}/again")
    batch = spark.createDataFrame([(1, "s", "h1", day(1)), (2, "s", "h2", day(1))], "doc_id long, source string, text_hash string, updated_at timestamp")
    for epoch in (0, 0, 1, 1):
        land(batch, epoch)
    land(batch.where("doc_id = 1").withColumn("text_hash", F.lit("h3")), 2)
    out = streams.landed(spark, f"{tmp_path}/again", streams.INGESTED)
    assert out.count() == 3 and {r.doc_id: r.text_hash for r in streams.current_documents(out).collect()} == {1: "h3", 2: "h2"}


def test_rate_windows_over_many_files(spark, tmp_path):
    from quarryline.streaming import streams

    at = tmp_path / "events.parquet"
    for k in range(12):  # no order of time: the later files hold the earlier events
        spark.createDataFrame([(1, T0 + dt.timedelta(minutes=30 * (12 - k) % 90))], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(at))
    got = streams.stream_rate_windows(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 12 and len(got) == 3 and all(r.over_limit == (r.n > 2) for r in got)
    events = streams.table_stream(spark, str(tmp_path), "events", files=100)
    q = streams.closed_windows(events).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("closed").count() <= 3


def test_repeated_front_matter_keys(spark):
    df = spark.createDataFrame([("---\ntitle: a\nTitle: b\nx: 1\n---\nbody",), ("no head",)], "t string")
    assert [r.m for r in df.select(files.front_matter("t").alias("m")).collect()] == [{"title": "b", "x": "1"}, {}]


def test_citations(spark):
    """Out of range, unsupported, foreign and refused markers are dropped; a rejected one may come later; private without owner may be cited."""
    from quarryline.operators import citations as C

    text = "Customer due diligence must be refreshed every 14 months by the onboarding desk."
    answer = "Bananas grow on purple mountains daily [1]. Due diligence is refreshed every 14 months [1][2]. See [3]. There is insufficient evidence about sanctions [4]. Refresh [5]\nnothing [9]"
    answers = spark.createDataFrame([(7, answer), (8, None), (9, "no marker")], "q int, answer string")
    src = spark.createDataFrame([(7, 1, text, "t1", "tenant", None), (7, 2, text, "t2", "public", None), (7, 3, text, "t1", "private", None), (7, 4, text, "t1", "tenant", None), (7, 5, text, None, "private", "other")], "q int, marker int, text string, tenant string, vis string, owner string")
    m = C.supported(C.cited_passages(answers, "answer").join(src, ["q", "marker"]), "passage", "text")
    ok = F.col("supported")
    see = C.may_cite(F.col("tenant"), F.col("vis"), F.col("owner"), F.lit("t1"), F.lit("me"))
    got = {r.marker: r.piece for r in C.first_accepted(m, ["q"], ok & see).collect()}
    assert got == {1: 1, 3: 2}
    assert {r.marker for r in m.where(ok).select("marker").collect()} == {1, 2, 3, 5}


def test_audit_chain_faults(spark):
    from quarryline.operators import audit

    key, rows = b"k", spark.createDataFrame([(i, f"v{i}", None if i == 2 else "x") for i in range(5)], "i int, v string, w string").withColumn("payload", audit.canonical("v", "w"))
    assert rows.where("i = 2").first().payload == '{"v":"v2","w":null}'
    chain = audit.chained(rows, "i", "payload", key).select("sequence", "payload", "prev_hash", "record_hash").cache()
    state = lambda df: tuple(audit.verdict(audit.verified(df, "payload", key)).first())
    assert state(chain) == (5, True, None, None) and chain.where("prev_hash is null").count() == 1
    at3 = F.col("sequence") == 3
    assert state(chain.withColumn("payload", F.when(at3, "x").otherwise(F.col("payload")))) == (5, False, 3, "hash")
    assert state(chain.withColumn("record_hash", F.when(at3, "x").otherwise(F.col("record_hash")))) == (5, False, 3, "hash")
    broken = chain.withColumn("prev_hash", F.when(at3, "other").otherwise(F.col("prev_hash")))
    assert state(broken.withColumn("record_hash", F.when(at3, audit.link(F.col("prev_hash"), F.col("payload"), key)).otherwise(F.col("record_hash")))) == (5, False, 3, "link")
    assert state(chain.limit(0)) == (0, True, None, None)


def test_threshold_choice(spark):
    from quarryline.operators import aggregates

    choose = lambda rows, floors: next(r.threshold for r in aggregates.threshold_choice(spark.createDataFrame(rows, "p double, bucket string"), [0.3, 0.5, 0.7], 0.15, (0.4, 0.3, 0.3), floors).collect() if r.chosen)
    rows = [(0.1, "out_of_corpus"), (0.4, "underspecified"), (0.6, "answer"), (0.9, "answer")]
    assert choose(rows, (0.9, 0.9)) == 0.5 and choose(rows, (2.0, 0.9)) == 0.5  # no threshold meets the floors: the best of all
    assert choose([(0.9, "answer")], (0.9, 0.9)) == 0.3  # the lowest of equals


def test_running_blocks_and_pieces(spark):
    rows = [(1, 5 * p + k, t, p, None) for p in range(1, 6) for k, t in enumerate([f"Policy  manual {p}", "body text " * p, f"Page {p} of 5"])] + [(2, 0, "Policy manual", 1, None), (2, 1, " ", 1, None), (2, 2, "a b c", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx int, text string, page int, page_end int")
    got = {(r.doc_id, r.block_idx): r.reason for r in layout.running_blocks(df).collect()}
    assert got == {(1, 5 * p + k): "running" for p in range(1, 6) for k in (0, 2)}
    p = layout.block_pieces(df.where("doc_id = 2"), 2, files.NAMESPACE, "{}").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.block_idx, r.tokens) for r in p] == [(0, 0, ["Policy", "manual"]), (1, 2, ["a", "b"]), (2, 2, ["c"])] and len({r.chunk_id for r in p}) == 3


def test_search_filters_and_store_changes(spark):
    df = spark.createDataFrame([(1, "a.md", "guide", "QM"), (2, "b.md", "policy", None)], "doc_id long, source_file string, doc_type string, jurisdiction string")
    ids = lambda c: [r.doc_id for r in df.where(c).collect()]
    assert ids(search.where()) == [1, 2] and ids(search.where(doc_type="guide", source_file="a.md")) == [1] and ids(search.where(document_scope=["b.md"], doc_id=2)) == [2] and ids(search.where(jurisdiction="QM", doc_type="policy")) == []
    fresh = df.where("doc_id = 2").withColumn("doc_type", F.lit("new"))
    assert sorted((r.doc_id, r.doc_type) for r in search.upserted(df, fresh, "doc_id").collect()) == [(1, "guide"), (2, "new")]
    q = spark.createDataFrame([(1, "alpha beta", "t1"), (2, "alpha beta", None)], "question_id long, text string, tenant string")
    p = spark.createDataFrame([("a", "alpha beta gamma", "t1", "tenant", None), ("b", "alpha", "t2", "public", None), ("c", "alpha beta", None, "public", None), ("d", "alpha beta", "t1", "private", "u"), ("e", None, "t1", None, None)], "passage_id string, text string, tenant_id string, visibility string, owner_id string")
    found = search.hybrid(q, p, 5).orderBy("question_id", "fused_rank").collect()
    assert [(r.question_id, r.passage_id, r.n_lists) for r in found] == [(1, "c", 2), (1, "a", 2), (2, "c", 2)]


def test_bm25_writes_no_postings(spark, monkeypatch):
    """The best passages by BM25 against brute force, ties by id, over several blocks of both sides; what is written grows with passages and questions, not with their common words."""
    import math
    import random

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    p = [(f"p{i}", " ".join(rng.sample(vocab, 25) + rng.choices(vocab, k=5))) for i in range(300)] + [("none", None), *((f"same{i}", "w1 w2 w3") for i in range(9))]
    q = [(i, " ".join(rng.sample(vocab, 6))) for i in range(20)] + [(90, "absent"), (91, "")]
    written = []
    plain = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: written.append(plain(df, name)) or written[-1])
    questions, passages = spark.createDataFrame(q, "question_id long, text string"), spark.createDataFrame(p, "passage_id string, text string")
    got = {(r.question_id, r["rank"]): (r.passage_id, r.score) for r in search.bm25_topk(questions, passages, 7).collect()}
    assert sum(df.count() for df in written) < 310 + 150
    words = {k: t.split() for k, t in p if t}
    mean = sum(map(len, words.values())) / len(words)
    for k, t in q:
        df = {w: sum(w in ws for ws in words.values()) for w in t.split()}
        score = lambda ws: sum(math.log(1 + (len(p) - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in df)  # noqa: B023, E731
        best = sorted((-round(score(ws), 6), name) for name, ws in words.items() if set(ws) & set(df))[:7]
        assert [got.get((k, r + 1)) for r in range(len(best))] == [(name, -s) for s, name in best] and (k, len(best) + 1) not in got
    blocks = search.bm25_best(questions, passages, 7, question_block=4, passage_block=50, most_blocks=2, most_terms=3)
    assert {(r.question_id, r["rank"]): (r.passage_id, r.score) for r in blocks.collect()} == got


def test_cached_answers_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(hours=i), " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 6)))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, at timestamp, k string")
    got = {r.id: (r.tier, r.answered_by) for r in search.cached_answers(df, df, 0.7, 50 * 3_600_000_000).collect()}
    for i, at, k in rows:
        a, best = set(k.split()), None
        for j, t, o in rows[:i]:
            b = set(o.split())
            s = len(a & b) / (len(a) * len(b)) ** 0.5
            if at - t <= dt.timedelta(hours=50) and (s >= 0.7 - 1e-12 or k == o):
                best = min(filter(None, (best, (k != o, -round(s, 6), t, j))))
        assert got[i] == (("miss", None) if best is None else ("semantic" if best[0] else "exact", best[3])), i


def test_lookup_splits_hot_keys(spark):
    from quarryline.operators import joins

    many = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(200)] + [(900, None), (901, "absent")], "i int, k string")
    one = spark.createDataFrame([("hot", 1), *((f"k{i}", 2) for i in range(7)), ("unused", 3)], "k string, v int")
    for how in ("inner", "left"):
        got, want = joins.lookup(many, one, "k", how, part_rows=10), many.join(one, "k", how)
        key = lambda r: (r.i, r.k, r.v)
        assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, map(key, want.collect()))) and got.columns == want.columns
    assert joins.lookup(many.limit(0), one, "k").count() == 0
    with pytest.raises(ValueError):
        joins.lookup(many.withColumn("_part", F.lit(1)), one, "k")
