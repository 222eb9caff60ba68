"""Hand-derived cases of the operators' finer rules."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, html, text
from corpusloom.functions.stem import stem
from corpusloom.operators import chunk, clean, evaluate, pages, retrieval, training
from corpusloom.sources import readers
from corpusloom.streaming import events


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("x")).first().x


def test_headings_join_the_next_body(spark):
    rows = [("a", 0, "# One"), ("a", 1, "body one"), ("a", 2, "TWO"), ("a", 3, "## Three "), ("a", 4, "body two"), ("a", 5, "# End"), ("b", 0, "# X"), ("b", 1, "Y 2.1")]
    got = {(r.doc_id, r.chunk_index): r.content for r in clean.merge_headings(spark.createDataFrame(rows, "doc_id string, chunk_index int, content string")).collect()}
    assert got == {("a", 1): "# One\n\nbody one", ("a", 4): "TWO\n\n## Three\n\nbody two\n\n# End", ("b", 1): "# X\n\nY 2.1"} or got == {("a", 1): "# One\n\nbody one", ("a", 4): "TWO\n\n## Three\n\nbody two\n\n# End", ("b", 0): "# X", ("b", 1): "Y 2.1"}


def test_dedup_keeps_the_first(spark):
    rows = [(3, "Same  text"), (1, " same text\n"), (2, "other")]
    got = clean.dedup_by_content(spark.createDataFrame(rows, "seq int, content string"), "seq")
    assert sorted(r.seq for r in got.collect()) == [1, 2]


@pytest.mark.parametrize(
    "predicate,content,gone",
    [
        (clean.is_non_english, "é" * 60, True), (clean.is_non_english, "é" * 50, False), (clean.is_endnote, "12 https://example.org/page", False), (clean.is_endnote, "(3) 4-5", True),
        (clean.is_header_only, "# a\n# b\n# c\n# d\nx", True), (clean.is_header_only, "# a\nbody text", False), (clean.is_short, " x" * 49, True), (clean.is_short, "x" * 100, False),
        (clean.is_boilerplate, "a\nb", True), (clean.is_boilerplate, "Back to top " + "y" * 150, True), (clean.is_boilerplate, "z" * 60, False), (clean.is_home_buying, "homebuyer and home buyer", True), (clean.is_home_buying, "homebuyer homebuyer tenant", False),
        (lambda c: clean.is_link_list(c, F.lit("d")), "one\ntwo\nthree", True), (lambda c: clean.is_link_list(c, F.lit("d")), "One.\nTwo.\nThree.", False), (lambda c: clean.is_link_list(c, F.lit("d")), "Contents ... 5", True),
    ],
)
def test_predicates(spark, predicate, content, gone):
    assert one(spark, content, predicate) is gone


def test_bm25_fills_with_rows_without_match(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple fig"), (3, "plum"), (4, "fig"), (5, "nut")], "id long, content string")
    got = retrieval.bm25_topk(docs, spark.createDataFrame([(7, "apple")], "query_id long, content string"), 4).orderBy("rank").collect()
    assert [r.id for r in got][:2] == [2, 1] and [r.id for r in got][2:] == [3, 4] and got[3].score == 0


def test_fusion_ties_and_flat_lists(spark):
    v = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.5, 2)], "query_id long, id long, distance double, rank int")
    b = spark.createDataFrame([(1, 12, 3.0, 1), (1, 11, 3.0, 2)], "query_id long, id long, score double, rank int")
    got = retrieval.fuse(v, b, 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(10, 0.0), (11, 0.0), (12, 0.0)]


def test_reciprocal_ranks(spark):
    rows = [(1, 0, 5, 1), (1, 0, 6, 2), (1, 1, 6, 1), (1, 1, 7, 2)]
    got = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id long, list int, id long, rank int"), 3).orderBy("rank").collect()
    assert [r.id for r in got] == [6, 5, 7] and math.isclose(got[0].score, 1 / 62 + 1 / 61)


def test_a_hit_that_came_as_neighbour_does_not_expand(spark):
    chunks = spark.createDataFrame([(i, 1, i) for i in range(12)] + [(50, 2, 0)], "id long, doc long, idx int")
    hits = spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 2, 0.8), (1, 50, 3, 0.7), (1, 9, 4, 0.6)], "query_id long, id long, rank int, score double")
    got = retrieval.expand_neighbours(hits, chunks, 4).orderBy("rank").collect()
    assert [r.id for r in got] == [5, 4, 6, 50, 9, 8, 10]
    assert math.isclose({r.id: r.score for r in got}[6], 0.9 * 0.8)


def test_auto_merge_at_the_threshold(spark):
    chunks = spark.createDataFrame([(i, 1, i, f"t{i}") for i in range(5)] + [(10 + i, 2, i, f"u{i}") for i in range(6)], "id long, doc long, idx int, content string")
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 10, 0.8, 2), (1, 3, 0.7, 3), (1, 12, 0.6, 4)], "query_id long, id long, score double, rank int")
    got = retrieval.auto_merge(hits, chunks, spark.createDataFrame([(1, "u2 t0")], "query_id long, content string"), 5).collect()
    assert {r.chunk_id for r in got} == {"1_merged", "10", "12"}
    assert {r.chunk_id: r.content for r in got}["1_merged"] == "t0\n\nt1\n\nt2\n\nt3\n\nt4"


def test_windows_merge_into_the_first_overlap_and_stop_at_k(spark):
    rows = [(1, 1, 9, 0, 4, 0.1, 1), (1, 2, 9, 10, 14, 0.2, 2), (1, 3, 9, 3, 11, 0.3, 3), (1, 4, 8, 0, 2, 0.4, 4), (1, 5, 8, 1, 5, 0.5, 5)]
    hits = spark.createDataFrame(rows, "query_id long, id long, doc long, window_start int, window_end int, distance double, rank int")
    got = retrieval.merge_windows(hits, 3).orderBy("rank").collect()
    assert [(r.id, r.window_start, r.window_end) for r in got] == [(1, 0, 11), (2, 10, 14), (4, 0, 2)]


def test_vector_search_skips_nulls_and_takes_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 1.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(5)] + [(9, None)], "query_id long, embedding array<float>")
    got = retrieval.vector_topk(vectors, queries, 2).collect()
    assert len(got) == 10 and all(r.id != 3 for r in got)
    corpus = retrieval.Corpus(vectors, spark.createDataFrame([(1, "a")], "id long, content string"), vectors)
    with pytest.raises(ValueError):
        retrieval.retrieve("none", corpus, queries, 2, strict=True)
    assert sorted(map(tuple, retrieval.retrieve("none", corpus, queries, 2).collect())) == sorted(map(tuple, got))


def test_bm25_in_blocks_equals_one_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 9))) for i in range(40)] + [(90, ""), (91, None)], "id long, content string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 2} w{i} none") for i in range(9)] + [(20, "")], "query_id long, content string")
    whole = sorted(map(tuple, retrieval.bm25_topk(docs, queries, 7).collect()))
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 8)
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 4)
    monkeypatch.setattr(retrieval, "GAIN_CELLS", 12)
    assert sorted(map(tuple, retrieval.bm25_topk(docs, queries, 7).collect())) == whole and len(whole) == 70


def test_ranking_metrics(spark):
    results = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query_id long, id long, rank int")
    truth = spark.createDataFrame([(1, 6), (1, 7), (1, 8), (2, 1), (3, 1)], "query_id long, id long")
    got = {r.query_id: r for r in evaluate.ranking_metrics(results, truth).collect()}
    assert (got[1].mrr, got[1].hit) == (0.5, 1) and math.isclose(got[1].recall, 1 / 3)
    assert math.isclose(got[1].ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[2].ndcg, got[3].mrr, got[3].ndcg, got[3].hit) == (0, 0, 0, 0)


def test_majority_tie_goes_to_the_first_run(spark):
    votes = spark.createDataFrame([("f", "b", 1), ("f", "a", 2), ("f", "a", 3), ("f", "b", 4)], "fact string, label string, run int")
    assert evaluate.majority(votes, "label", "run", "fact").first().majority == "b"


def test_stats_of_one_run(spark):
    r = evaluate.run_stats(spark.createDataFrame([(0.5,)], "v double").withColumn("g", F.lit(1)), "v", "g").first()
    assert (r["mean"], r["std"], r.ci_95_low, r.ci_95_high) == (0.5, 0.0, 0.5, 0.5)


def test_attribution(spark):
    facts = spark.createDataFrame([("q", a, b) for a in (True, False) for b in (True, False)], "q string, in_retrieval boolean, in_generation boolean")
    r = evaluate.attribution_counts(facts, "q").first()
    assert (r.covered, r.generation_miss, r.hallucinated, r.retrieval_miss, r.facts) == (1, 1, 1, 1, 4)


def test_verdicts(spark):
    judged = "Fact 1 : yes\nFACT 2: NO - yes later\nfact 11: YES"
    assert [one(spark, judged, lambda c, i=i: text.fact_verdict(c, F.lit(i))) for i in (1, 2, 3)] == [True, False, False]


def test_citations_overlap(spark):
    assert one(spark, "see MGL c.186, s.15B", text.citations) == ["GL c.186", "MGL c.186, s.15B"] or "MGL c.186, s.15B" in one(spark, "see MGL c.186, s.15B", text.citations)


def test_scalar_functions(spark):
    assert one(spark, "a-b\n\n\n\nc  d", text.regulation_text) == "a-b\n\nc d"
    assert one(spark, "```json\n{}\n```", text.unfenced) == "{}"
    assert one(spark, "x\n**Confidence:** 9/10", text.confidence) == 9 and one(spark, "**Confidence:** 11", text.confidence) is None
    assert one(spark, "[Source 1: a\n[Source 2: b]", text.closed_citations) == "\\[Source 1: a\\]\n\\[Source 2: b\\]"
    assert one(spark, "fact (Source 3, p.2) end", text.without_source_note) == "fact  end"
    assert one(spark, "a## b\n## c\n## d", lambda c: text.keep_separator_split(c, "\n## ")) == ["a## b", "\n## c", "\n## d"]
    assert one(spark, "tenant law is here", lambda c: text.containment(F.lit("the tenant law text"), c)) == pytest.approx(2 / 3)


def test_small_sections_are_not_joined_again():
    body = "x" * 3195
    assert chunking.split_to_fit(f"a\n## b\n## {body}\n## c") == ["a", "\n## b", f"\n## {body}", "\n## c"]
    assert [len(p) for p in chunking.split_to_fit("y" * 7000)] == [3200, 3200, 600]


def test_overlap_starts_at_a_blank_line():
    first = "z" * 700 + "\n\n" + "tail of it " * 30
    assert chunking.with_overlap([first, "next"])[1] == "tail of it " * 30 + "next"
    assert chunking.with_overlap(["short", "next"])[1] == "next"


def test_sentences_and_abbreviations():
    assert chunking.sentences("See c. 186. Rent, e.g. Heat, is due. Item 15B. Is it? Yes 4. No.") == ["See c. 186.", "Rent, e.g. Heat, is due.", "Item 15B. Is it?", "Yes 4. No."]


def test_chunk_router(spark):
    long = "word " * 900
    rows = [("q_faq_full_page", "faq", "x"), ("f", "faq", "Q?"), ("s", "statute", "Head " * 20 + "\n(a) " + "first part " * 10 + "\nSection 2 " + "second part " * 10), ("g", "guide", " short "), ("l", "guide", long)]
    got = chunk.chunk(spark.createDataFrame(rows, "doc_id string, content_type string, content string")).collect()
    by = {d: [r.content for r in got if r.doc_id == d] for d in "fsgl"}
    assert "q_faq_full_page" not in {r.doc_id for r in got} and by["f"] == ["Q?"] and by["g"] == [" short "] and len(by["s"]) == 3
    assert {r.chunk_id for r in got if r.doc_id == "s"} == {"s_chunk_000", "s_chunk_001", "s_chunk_002"}


def test_longest_answer_keeps_the_first_of_equals(spark):
    rows = [(1, "Q a", "xx"), (2, "q  A ", "yyy"), (3, "q a", "zzz")]
    got = training.longest_answers(spark.createDataFrame(rows, "seq int, question string, answer string"), "seq").collect()
    assert [r.seq for r in got] == [2]


def test_split_has_at_least_one_validation_row(spark):
    parts = [r.part for r in training.split(spark.range(5), F.col("id")).collect()]
    assert sorted(parts) == ["train"] * 4 + ["validation"]


def test_pages(spark):
    page = """<html><head><title> T &amp; U </title></head><body><nav><a href="/n">n</a></nav><main><h1>Head</h1><p>One <b>two</b><br>three</p>
    <div class="ad-box">gone</div><ul><li>x</li></ul><a href="b.pdf#p">doc</a><!-- c --><img src="i"><dl><dt>Q?</dt><dd>A.</dd></dl></main></body></html>"""
    root = html.parse(page)
    assert html.title(root) == "T & U" and html.headings(root) == ["Head"]
    assert html.links(root, "https://e.org/d/") == ["https://e.org/d/b.pdf", "https://e.org/n"] and html.pdf_links(root, "https://e.org/d/") == ["https://e.org/d/b.pdf"]
    assert html.questions(root) == [("Q?", "A.", "")]
    md = html.markdown(html.without_noise(html.main_part(root)))
    assert md.startswith("# Head\n\nOne **two**\nthree") and "gone" not in md and "* x" in md
    docs = pages.documents_of(spark.createDataFrame([("https://e.org/faq", page), ("https://e.org/none", None)], "url string, html string"), "web", 5).collect()
    assert [d.content_type for d in docs] == ["faq"] and docs[0].doc_id == "web_e_org_faq"


def test_headings_as_questions():
    root = html.parse("<h2>Cat</h2><h3>Why?</h3><p>So.</p><p>And.</p><h4>Empty?</h4><h3>How?</h3><p>Thus.</p>")
    assert html.questions(root) == [("Why?", "So.\nAnd.", "Cat"), ("How?", "Thus.", "Cat")]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("happily", "happili"), ("skies", "sky"), ("evictions", "evict"), ("tenancy", "tenanc"), ("housing", "hous"), ("yes", "yes")])
def test_stem(word, want):
    assert stem(word) == want


def test_samples_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("<|im_start|>user\na\n\nb<|im_end|>",), ("two",)], "content string").coalesce(1)
    readers.write_samples(rows, str(tmp_path / "s"))
    back = readers.samples(spark, str(tmp_path / "s"))
    assert sorted(r.content for r in back.collect()) == sorted(r.content for r in rows.collect())
    assert readers.is_chatml(back.where("content like '<|%'"))


def test_posts_of_a_listing(spark):
    raw = '{"data":{"children":[{"kind":"t3","data":{"id":"a","subreddit":"s","title":"t","permalink":"/p","created_utc":1.0}},{"kind":"t5","data":{"id":"b"}}]}}'
    got = readers.posts(spark.createDataFrame([(raw,)], "value string")).collect()
    assert [(p.id, p.selftext, p.score, p.url) for p in got] == [("a", "", 0, "https://www.reddit.com/p")]


def test_stream_equals_batch(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/events.parquet")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.event_stream(spark, str(tmp_path / "in"), table.schema), late="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = events.windowed(table.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_first_seen_in_a_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00', 'A b'), (timestamp'2024-01-01 00:01:00', 'a  B'), (timestamp'2024-01-01 00:02:00', 'c') AS t(ts, content)").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("ts timestamp, content string").parquet(str(tmp_path / "in"))
    q = events.first_seen(rows, text.dedup_key(F.col("content"))).writeStream.outputMode("append").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def test_context_holds_whole_texts(spark, tmp_path):
    import hashlib

    from corpusloom import plans

    text = "heat " * 200 + "the end"
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "heat")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.QUERIES["context_assembly"](spark, str(tmp_path)).first().context
    assert got == hashlib.md5(f"[Source 1: en (s)]\n{text}".encode()).hexdigest()


def by_sense(c):
    """A model that knows two words for one thing."""
    return F.when(c.rlike("landlord|lessor"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def test_multiquery_finds_what_only_vectors_find(spark):
    docs = spark.createDataFrame([(i, f"filler text {i}") for i in range(30)] + [(99, "duties of the lessor")], "id long, content string")
    corpus = retrieval.Corpus(docs.select("id", by_sense(F.col("content")).alias("embedding")), docs, docs, embed=by_sense)
    queries = spark.createDataFrame([(7, "landlord landlord")], "query_id long, content string")
    assert [(r.query_id, r.id) for r in retrieval.retrieve("multiquery", corpus, queries, 2).where("rank = 1").collect()] == [(7, 99)]
    assert len(retrieval.variants(F.col("content"))) == 3


def test_sentence_window_finds_what_only_vectors_find(spark):
    rows = [(i, 1, i, f"filler text {i}.", max(0, i - 1), min(30, i + 2)) for i in range(30)] + [(99, 2, 0, "Duties of the lessor.", 0, 2), (100, 2, 1, "They are many.", 0, 2)]
    sentences = spark.createDataFrame(rows, "id long, doc long, idx int, content string, window_start int, window_end int")
    corpus = retrieval.Corpus(sentences, sentences, sentences, sentences, embed=by_sense)
    first = retrieval.retrieve("sentence_window", corpus, spark.createDataFrame([(7, "landlord")], "query_id long, content string"), 2).where("rank = 1").first()
    assert (first.query_id, first.id, first.expanded) == (7, 99, "Duties of the lessor. They are many.")


def test_sentence_ids_do_not_collide(spark):
    rows = [(d, i) for d in (-1, 0, 1, 2, 2**32 - 1) for i in (0, 100_000, 200_000, 2**31 - 1)]
    made = spark.createDataFrame(rows, "doc long, idx int").select(retrieval.sentence_id(F.col("doc"), F.col("idx")).alias("id"))
    assert [r.id for r in made.collect()] == [d * 2**31 + i for d, i in rows] and made.distinct().count() == len(rows)
    with pytest.raises(Exception, match="within 32 bits"):
        spark.createDataFrame([(2**32, 0)], "doc long, idx int").select(retrieval.sentence_id(F.col("doc"), F.col("idx"))).collect()


def test_long_documents_keep_their_sentences(spark, tmp_path):
    from corpusloom.plans.retrieval import _corpus

    long = "The heat is off again here. " * 100_010
    spark.createDataFrame([(1, long), (2, "Another one is here. It has two sentences.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    ids = _corpus(spark, str(tmp_path)).sentences.select("id", "doc")
    assert ids.where("doc = 1").count() > 100_000 and ids.select("id").distinct().count() == ids.count()


def test_counts_along_the_way_equal_those_of_the_passes(spark, data):
    from corpusloom.plans import text

    chunks, *rest = text._cleaned(spark, data)
    cleaned, counts = clean.clean_counted(chunks, *rest)
    got = sorted(map(tuple, cleaned.select("doc_id", "chunk_index", "content").collect()))
    assert got == sorted(map(tuple, clean.clean(chunks, *rest).select("doc_id", "chunk_index", "content").collect()))
    assert counts() == {r["step"]: r["removed"] for r in clean.removed_counts(chunks, *rest).collect()}
