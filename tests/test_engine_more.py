"""Operators whose results SQL cannot state, held against plain Python."""

import json
import math
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.functions import chunking
from corpusloom.functions.stem import stem
from corpusloom.operators import chunk, evaluate, pages, retrieval, serving, training
from corpusloom.sources import readers

TEXTS = ["Tenants rented apartments", "the renting of an apartment by a tenant", "heaters were heating", "", "nothing in common here"]


def brute_bm25(texts, query, terms):
    docs = [terms(t) for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    least = 0.25 * sum(raw.values()) / len(raw)
    weight = {t: w if w >= 0 else least for t, w in raw.items()}
    return [sum(weight.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in terms(query)) for d in docs]


def test_stemmed_bm25_and_shared_statistics(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    queries = spark.createDataFrame([(1, "renting tenants heat heat"), (2, "apartments"), (3, None)], "query_id long, content string")
    terms = lambda t: [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
    known = retrieval.statistics(docs, chunk.stemmed_tokens)
    assert known.n == 5
    for q, text in ((1, "renting tenants heat heat"), (2, "apartments"), (3, "")):
        want = brute_bm25(TEXTS, text, terms)
        for stats in (None, known):
            found = {r.id: r.score for r in retrieval.bm25_topk(docs, queries, 5, chunk.stemmed_tokens, stats).where(F.col("query_id") == q).collect()}
            assert found == pytest.approx(dict(enumerate(want)), abs=1e-9)
    known.release()


def test_statistics_of_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "id long, content string")
    queries = spark.createDataFrame([(1, "word")], "query_id long, content string")
    assert retrieval.statistics(docs).n == 0 and retrieval.bm25_topk(docs, queries, 3).count() == 0


def test_chunks_by_a_tokenizer(spark):
    """The rules of splitting and overlap, written out over the library's tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    text = "\n\n".join(f"Part {i}. " + " ".join(f"word{i}x{j} goes on." for j in range(60)) for i in range(12))
    rows = chunk.chunk(spark.createDataFrame([("d", "guide", text)], "doc_id string, content_type string, content string"), path).orderBy("chunk_index").collect()
    pieces = chunking.split_to_fit(text, tokens=chunking.encoded(path))
    assert "".join(pieces) == text and all(len(ids(p)) <= 800 for p in pieces) and len(pieces) > 3
    want = [pieces[0]]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        tail = library.decode(ids(before)[-200:], skip_special_tokens=False) if len(ids(before)) > 200 else ""
        cut = re.search(r"\n\n+", tail) or re.search(r"(?<=[.!?])\s+", tail)
        want.append((tail[cut.end() :] if cut else tail) + piece)
    assert [r.content for r in rows] == [w.strip() for w in want if len(w.strip()) >= 50]
    assert [r.content for r in rows] != [r.content for r in chunk.chunk(spark.createDataFrame([("d", "guide", text)], "doc_id string, content_type string, content string")).orderBy("chunk_index").collect()]


def test_crawl_follows_what_the_predicate_lets_through(spark):
    edges = spark.createDataFrame([("a", "ok1"), ("a", "no"), ("no", "ok9"), ("ok1", "ok2"), ("ok2", "ok3"), ("ok3", "ok4"), ("ok2", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "url string")
    found = {r.url: (r.depth, r.parent_url) for r in pages.crawl(edges, roots, 3, lambda u: F.startswith(u, F.lit("ok"))).collect()}
    assert found == {"a": (0, None), "ok1": (1, "a"), "ok2": (2, "ok1"), "ok3": (3, "ok2")}


def test_json_arrays_raw_pages_and_audits(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", f"text {i}\n\"quoted\"") for i in range(7)], "chunk_id string, content string").repartition(3)
    readers.write_json_arrays(rows, str(tmp_path / "chunks"))
    for f in (tmp_path / "chunks").glob("part-*"):
        json.loads(f.read_text())
    assert sorted(r.chunk_id for r in readers.chunks(spark, str(tmp_path / "chunks")).where("chunk_id is not null").collect()) == [f"c{i}" for i in range(7)]
    pages_ = readers.literal_rows(spark, [("u", "<p>x</p>")], "url string, html string")
    for _ in range(2):
        readers.write_raw(pages_, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    entries = spark.createDataFrame([("e1",), ("e2",)], "id string")
    issues = spark.createDataFrame([("e1", "x", "c1"), ("e1", "y", None)], "entry_id string, check string, chunk_id string")
    readers.write_audit(evaluate.audit_report(issues, entries, "golden"), str(tmp_path / "audit"), "r1")
    assert sorted((r.entry_id, r.num_issues) for r in spark.read.json(str(tmp_path / "audit")).collect()) == [("e1", 2), ("e2", 0)]


def test_index_of_another_model_is_not_read(spark, tmp_path):
    serving.build_index(spark.createDataFrame([(1, "a b")], "id long, content string"), str(tmp_path / "i"))
    assert serving.read_index(spark, str(tmp_path / "i")).count() == 1
    with pytest.raises(ValueError):
        serving.read_index(spark, str(tmp_path / "i"), "other")


def test_search_addresses_and_parents(spark):
    urls = readers.search_urls(spark.createDataFrame([("boston",)], "forum string"), spark.createDataFrame([("rent & heat",)], "query string"))
    assert urls.first().url == "https://www.reddit.com/r/boston/search.json?q=rent+%26+heat&restrict_sr=on&sort=relevance&t=all&limit=25"
    docs = spark.createDataFrame([("d", "old", "u", "x", 1, "h"), ("d", "new", "u", "y", 2, "h")], "doc_id string, title string, source_url string, content string, scraped_at int, content_hash string")
    assert [(r.doc_id, r.title) for r in readers.parents(docs).collect()] == [("d", "new")]


def test_backends(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id long, embedding array<double>")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    chunks = spark.createDataFrame([(1, 7, 0), (2, 7, 1)], "id long, doc long, idx int")
    q = spark.createDataFrame([(5, "a", [1.0, 0.0])], "query_id long, content string, embedding array<double>")
    corpus = retrieval.Corpus(v, docs, chunks)
    found = {r.id: r.score for r in retrieval.retrieve("vector", corpus, q, 2, backend="similarity").collect()}
    assert found == pytest.approx({1: 1.0, 2: 0.6})
    with pytest.raises(ValueError):
        retrieval.retrieve("auto_merge", corpus, q, 2, backend="similarity")
    assert retrieval.retrieve("no such", corpus, q, 1).columns == retrieval.retrieve("vector", corpus, q, 1).columns


def test_pairs_fall_back(spark):
    none = spark.createDataFrame([], "question string, source_chunks array<struct<chunk_id:string,title:string,source_url:string>>")
    saved = spark.createDataFrame([("s",)], "question string")
    assert training.retrieval_pairs(none, none, saved).first().question == "s"
    assert training.retrieval_pairs(none, none, saved.limit(0), lambda: saved.withColumn("question", F.lit("made"))).first().question == "made"
    assert training.retrieval_pairs(none, none).count() == 0


def test_posts_whose_answer_is_no_json(spark):
    posts = spark.createDataFrame([(1, "q")], "query_id long, content string")
    results = spark.createDataFrame([(1, 3, 1)], "query_id long, id long, rank int")
    chunks = spark.createDataFrame([(3, "t", "u", "x" * 2000)], "id long, title string, source_url string, content string")
    bad = serving.enriched_posts(posts, results, chunks, lambda q, s: F.lit("no json")).first()
    assert (bad.expected_answer, bad.key_facts, bad.source_chunks[0].chunk_id) == ("", [], "3")
    seen = serving.enriched_posts(posts, results, chunks, lambda q, s: F.to_json(F.struct(F.length(s).cast("string").alias("answer")))).first()
    assert seen.expected_answer == str(len("[Source 1: t (u)]\n") + 1500)


def test_report_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(serving, "REPORT_ROWS", 2)
    assert serving.report(spark.range(2), "T").count("\n") == 5
    with pytest.raises(ValueError):
        serving.report(spark.range(3), "T")


def test_results_of_all_kinds_and_registering(spark):
    rows = [(1, 7, 0, "Heat is off.", 0, 2), (2, 7, 1, "Rent is due.", 0, 2), (3, 8, 0, "Mold is here.", 0, 1)]
    texts = spark.createDataFrame(rows, "id long, doc long, idx int, content string, window_start int, window_end int")
    corpus = retrieval.Corpus(texts.select("id", serving.hashed_bag("content").alias("embedding")), texts, texts, texts)
    q = spark.createDataFrame([(5, "heat is off")], "query_id long, content string").withColumn("embedding", serving.hashed_bag("content"))
    top = {n: retrieval.results(n, corpus, q, 2).where("rank = 1").first() for n in ("bm25", "vector", "auto_merge", "sentence_window")}
    assert (top["bm25"].chunk_id, top["bm25"].content) == ("1", "Heat is off.") and top["vector"].chunk_id == "1"
    assert top["auto_merge"].chunk_id == "7_merged" and top["auto_merge"].content == "Heat is off.\n\nRent is due."
    assert top["sentence_window"].content == "Heat is off. Rent is due."
    corpus.release()
    retrieval.register("own", lambda c, q, k: retrieval.retrieve("bm25", c, q, k))
    try:
        assert retrieval.results("own", corpus, q, 1).first().chunk_id == "1"
        with pytest.raises(ValueError):
            retrieval.register("own", None)
    finally:
        retrieval.RETRIEVERS.pop("own")
    corpus.release()


def test_chunks_as_a_table_function(spark):
    text = "\n\n".join(f"Part {i}. " + "words go on. " * 120 for i in range(5))
    docs = spark.createDataFrame([("a", "guide", text), ("b", "faq", "short")], "doc_id string, content_type string, content string")
    chunk.register_table_functions(spark)
    found = spark.sql("SELECT d.doc_id, c.chunk_index, c.content FROM {docs} d, LATERAL chunk_rows(d.doc_id, d.content_type, d.content) c", docs=docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, chunk.chunk(docs).select("doc_id", "chunk_index", "content").collect()))


def test_model_scorer_loads_once_a_task(spark):
    def load():
        return lambda pairs: [float(len(a) + len(b)) for a, b in pairs]

    rows = spark.createDataFrame([("ab", "c"), (None, "xyz")], "a string, b string").coalesce(1)
    assert [r.s for r in rows.select(serving.model_scorer(load)(F.col("a"), F.col("b")).alias("s")).collect()] == [3.0, 3.0]


def test_runs_and_valid_scores(spark):
    made = evaluate.runs(3, lambda i: spark.createDataFrame([("q", i / 10, 0.5)], "question_id string, retrieval_coverage double, generation_correctness double"))
    row = evaluate.question_runs(made).first()
    assert (row.runs, row.retrieval_mean, row.retrieval_std, row.generation_std, row.unstable) == (3, 0.1, 0.1, 0.0, False)
    scores = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "s double").select(evaluate.valid(F.col("s")).alias("s"))
    assert [r.s for r in scores.collect()] == [None, 0.0, 1.0]
