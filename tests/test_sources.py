"""Readers and writers on small files, and the page source against a server of this process."""

import http.server
import json
import threading

import pytest

from corpusloom.operators import pages, serving, training
from corpusloom.sources import readers
from corpusloom.sources.http import WebPages


@pytest.fixture
def site():
    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/good"
            self.send_response(200 if good else 404)
            self.end_headers()
            self.wfile.write("<title>é</title>".encode() if good else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_that_fail_are_null_rows(spark, site):
    spark.dataSource.register(WebPages)
    rows = spark.read.format("web_pages").option("urls", f"{site}/good {site}/bad").option("delay", "0").load().collect()
    assert {(r.url.rsplit("/")[-1], r.status, r.html) for r in rows} == {("good", 200, "<title>é</title>"), ("bad", None, None)}


def test_documents_and_chunks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(2):
        (tmp_path / "d" / f"{i}.json").write_text(json.dumps({"doc_id": f"d{i}", "content": "x\ny", "scraped_at": "2026-01-02T03:04:05+00:00", "section_headers": ["h"]}, indent=2))
    docs = readers.documents(spark, str(tmp_path / "d")).orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == ["d0", "d1"] and docs[0].parent_url is None and docs[0].section_headers == ["h"]
    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": "a_chunk_000", "chunk_index": 0}, {"chunk_id": "a_chunk_001", "chunk_index": 1}]))
    chunks = readers.chunks(spark, str(tmp_path / "c.json"))
    assert chunks.count() == 2
    readers.write_chunks(chunks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_results_of_new_files_only(spark, tmp_path):
    for run in ("r1", "r2"):
        readers.write_results(spark.createDataFrame([(run, "long")], "id string, retrieved_context string"), str(tmp_path / "res"), run)
    files = spark.read.json(str(tmp_path / "res")).select("id", "run_ts", "_metadata.file_path")
    known = files.where("run_ts = 'r1'").selectExpr("file_path AS path")
    assert [r.id for r in readers.new_results(spark, str(tmp_path / "res"), known).collect()] == ["r2"]
    assert "retrieved_context" not in files.columns


def test_upsert_and_replace(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int"), spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in pages.upsert(old, new, "k", "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in pages.replace_by_key(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_index_and_report(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "rent is due"), (2, None)], "id long, content string")
    serving.build_index(chunks, str(tmp_path / "index"))
    rows = spark.read.parquet(str(tmp_path / "index")).collect()
    assert {len(r.embedding) for r in rows} == {serving.DIMENSIONS} and {r.model for r in rows} == {"hashed_bag"}
    with pytest.raises(ValueError):
        serving.index(chunks, "none")
    assert serving.report(spark.createDataFrame([("a", 1)], "k string, n int"), "T").endswith("| a | 1 |")


def test_training_set_formats(spark):
    pair = spark.createDataFrame([("q ", " a", "c")], "question string, answer string, context string")
    rows = serving.training_set([(pair, "golden", 2), (pair, "instruction", 1), (pair, "rag", 1)], "S").collect()
    assert sorted(r.source for r in rows) == ["golden", "golden", "instruction", "rag"]
    by = {r.source: r.content for r in rows}
    assert by["instruction"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>"
    assert by["rag"].startswith("<|im_start|>system\nS\n\nRETRIEVED CONTEXT:\nc\n\nQUESTION: q<|im_end|>")


def test_systematic_sample_over_many_blocks(spark):
    rows = spark.range(0, 400_000, 3)
    got = sorted(r.id for r in training.systematic(rows, "id", 40_000, 3).collect())
    assert got == [0, 120_000, 240_000]


def _chats(spark, rows):
    return spark.createDataFrame(rows, "chat_id long, answered boolean, answer string, sources array<struct<rank:int,title:string,source_url:string,content:string,score:double>>")


def test_chat_sink_equals_chat_events_and_replays_add_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.sources import chat_sink
    from corpusloom.streaming import events

    first = [(1, True, "You may\npay rent", [(1, "t", "u", "c" * 600, 0.5)]), (2, True, None, None)]
    second = [(3, True, "", [(1, "a", "b", None, None), (2, "x", "y", "z", 1.0)]), (4, False, None, [(1, "t", "u", "c", 1.0)]), (5, True, "one  two ", [])]
    for i, part in enumerate((first, second)):
        _chats(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(_chats(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = chat_sink.write_chats(events.chat_rows(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    both = _chats(spark, first + second)
    sources = both.select("chat_id", F.explode("sources").alias("s")).select("chat_id", "s.*")
    want = sorted(map(tuple, events.chat_events(sources, both.where("answered").select("chat_id", "answer")).collect()))
    got = chat_sink.read_chats(spark, str(tmp_path / "out"))
    assert {r["batch"] for r in got.select("batch").distinct().collect()} == {0, 1}
    rows = sorted(map(tuple, got.select("chat_id", "seq", "event", "data").collect()))
    assert [r for r in rows if r[3] != "[]"] == want  # a chat with an empty list of sources says so in the stream alone

    writer = chat_sink.ChatWriter(str(tmp_path / "out"))  # the last batch once more, as after a failure before the checkpoint
    again = writer.write(iter([{"chat_id": 9, "seq": 1, "event": "token", "data": "x"}]))
    writer.commit([again, None], 1)
    lost = writer.write(iter([{"chat_id": 9, "seq": 1, "event": "token", "data": "x"}]))
    writer.abort([lost], 2)
    assert sorted(map(tuple, chat_sink.read_chats(spark, str(tmp_path / "out")).select("chat_id", "seq", "event", "data").collect())) == rows
    assert len(list((tmp_path / "out" / "files").glob("*.jsonl"))) <= 4


def test_server_sent_text(spark):
    from corpusloom.streaming import events

    rows = spark.createDataFrame([(1, 1, "token", "a\nb")], "chat_id long, seq int, event string, data string")
    assert events.sse(rows).first()["text"] == "event: token\ndata: a\ndata: b\n\n"


def test_upsert_ties_are_the_same_each_time(spark):
    from corpusloom.operators import pages

    old = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "key string, at int, v string")
    new = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("c", 1, "new")], "key string, at int, v string")
    got = {tuple(r) for r in pages.upsert(old, new.repartition(3), "key", "at").collect()}
    assert got == {tuple(r) for r in pages.upsert(old, new.coalesce(1), "key", "at").collect()}
    assert {(k, v) for k, _, v in got if k != "a"} == {("b", "old"), ("c", "new")} and {v for k, _, v in got if k == "a"} <= {"x", "y"}


def test_results_that_arrive_in_two_files_give_the_same_aggregates(spark, tmp_path):
    import json
    import random

    from corpusloom.operators import evaluate
    from corpusloom.streaming import results

    r = random.Random(4)
    rows = [(r.randint(1, 3), r.random() < 0.6, r.random() < 0.5) for _ in range(300)]
    keys = ("run", "in_retrieval", "in_generation")
    (tmp_path / "in").mkdir()
    put = lambda name, part: (tmp_path / "in" / name).write_text(json.dumps([dict(zip(keys, x, strict=True)) for x in part]))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert results.kept_aggregates(spark, out) is None
    for i, part in enumerate((rows[:120], rows[120:200], rows[200:])):  # each time the query starts again from its checkpoint
        put(f"r{i}.json", part)
        query = results.keep_counts(results.fact_stream(spark, str(tmp_path / "in")), out, check)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        seen = spark.createDataFrame(rows[: (120, 200, 300)[i]], results.FACTS)
        assert sorted(map(tuple, results.kept_aggregates(spark, out).collect())) == sorted(map(tuple, evaluate.run_aggregates(seen).collect()))
    assert len(list((tmp_path / "out").glob("batch=*"))) <= results.KEPT


def test_listings_are_followed_by_their_cursors(spark):
    import json
    from urllib.parse import parse_qs, urlsplit

    from corpusloom.sources.listings import PagedListing

    post = lambda i: {"kind": "t3", "data": {"id": f"p{i}", "subreddit": "s", "title": f"t{i}", "selftext": "x", "permalink": f"/p{i}", "score": i, "num_comments": 0, "created_utc": 1.0}}
    pages = {("a", None): (["1", "2"], "c&1"), ("a", "c&1"): (["3"], "c2"), ("a", "c2"): (["4"], None), ("b", None): (["5"], "lost"), ("loop", None): (["6"], "x"), ("loop", "x"): (["7"], "x")}

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            parts = urlsplit(self.path)
            found = pages.get((parts.path.strip("/"), parse_qs(parts.query).get("after", [None])[0]))
            self.send_response(200 if found else 500)
            self.end_headers()
            if found:
                self.wfile.write(json.dumps({"data": {"after": found[1], "children": [post(int(i)) for i in found[0]]}}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        spark.dataSource.register(PagedListing)
        read = spark.read.format("paged_listing").option("urls", f"{base}/a?limit=2 {base}/b {base}/loop").option("delay", "0")
        rows = read.load().collect()
        assert [(r["listing"].split("/")[3][:1], r["page"], r["value"] is None) for r in sorted(rows, key=lambda r: (r["listing"], r["page"]))] == [("a", 0, False), ("a", 1, False), ("a", 2, False), ("b", 0, False), ("b", 1, True), ("l", 0, False), ("l", 1, False)]
        found = readers.posts(read.load().where("value is not null").select("value"))
        assert sorted(r["id"] for r in found.collect()) == [f"p{i}" for i in range(1, 8)]
        assert read.option("pages", "1").load().count() == 3
    finally:
        server.shutdown()


def test_keyed_table_rewrites_touched_buckets_alone(spark, tmp_path):
    from corpusloom.operators.keyed import KeyedTable

    t = KeyedTable(spark, str(tmp_path / "t"), "key", "key string, at int, v string", buckets=8)
    make = lambda rows: spark.createDataFrame(rows, "key string, at int, v string")
    assert t.rows.count() == 0
    t.upsert(make([(f"k{i}", 1, "first") for i in range(40)] + [(None, 1, "none"), ("k0", 0, "older")]), "at")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    t.upsert(make([("k3", 2, "second"), ("k3", 0, "late"), ("new", 1, "third")]), "at")
    after = files()
    got = {r["key"]: r["v"] for r in t.rows.collect()}
    assert got == {f"k{i}": "first" for i in range(40)} | {None: "none", "k3": "second", "new": "third"}
    changed = {p.split("_bucket=")[1].split("/")[0] for p in set(before) ^ set(after)}
    assert 1 <= len(changed) <= 2 and all(after[p] == n for p, n in before.items() if p in after)
    t.replace(make([("k5", 1, "a"), ("k5", 1, "b")]))
    assert sorted(r["v"] for r in t.rows.where("key = 'k5'").collect()) == ["a", "b"] and t.rows.count() == 43
    t.upsert(make([]), "at")
    assert t.rows.count() == 43
