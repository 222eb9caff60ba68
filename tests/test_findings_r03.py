"""What the findings of round three were about."""

import math

from corpusloom import plans
from corpusloom.functions import html
from corpusloom.operators import serving
from pyspark.sql import functions as F


def test_embeddings_in_double_precision(spark):
    row = spark.createDataFrame([("rent rent heat lease mold",)], "content string").select(serving.hashed_bag("content").alias("v")).first()
    whole = [x for x in row.v if x]
    least = min(map(abs, whole))
    counts = [round(x / least) for x in whole]
    assert whole == [n / math.sqrt(sum(c * c for c in counts)) for n in counts]


def test_first_sentence_is_of_the_first_source(spark):
    posts = spark.createDataFrame([(1, "q")], "query_id long, content string")
    results = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")
    texts = lambda first: spark.createDataFrame([(7, "t", "a.org", first), (8, "t", "u", "Later. Words")], "id long, title string, source_url string, content string")
    said = lambda first: serving.enriched_posts(posts, results, texts(first)).first().expected_answer
    assert said("no end of a sentence") == ""
    assert said("an end\n\n---\n\nhere. Two.") == "an end\n\n---\n\nhere."
    assert serving.ask(posts, results, texts("none")).first().answer.startswith("\n\n---\n**Sources:**")
    alone = spark.createDataFrame([("no source named. Two.", "none")], "a string, b string").select(*[serving.first_sentence(F.lit("q"), F.col(c)) for c in "ab"]).first()
    assert tuple(alone) == ("no source named.", "")


def _pages(spark, tmp_path):
    cut = "<html><head><title>{x}</title></head><body><h1>{x}</h1></body></html>"
    rows = [(i, "https://a.org/", cut.format(x=x)) for i, x in enumerate(["a &lt;b&gt; &amp;&amp; c", "cut &amp;&am", "cut &amp", "say &quot;x&quot; &#39;", "&amp;lt;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return ["a <b> && c", "cut &&am", "cut &amp", "say &quot;x&quot; &#39;", "&lt;"]


def test_titles_decode_the_references_of_their_sql(spark, tmp_path):
    expected = _pages(spark, tmp_path)
    assert [r.title for r in plans.QUERIES["html_title"](spark, str(tmp_path)).orderBy("page_id").collect()] == expected
    assert html.title(html.parse("<title>say &quot;x&quot;</title>")) == 'say "x"'


def test_headings_decode_the_references_of_their_sql(spark, tmp_path):
    expected = _pages(spark, tmp_path)
    assert [r.headings for r in plans.QUERIES["html_headings"](spark, str(tmp_path)).orderBy("page_id").collect()] == expected


def test_pages_of_one_part_are_dealt_out(spark):
    from corpusloom.operators import pages

    one = spark.range(3).select(F.col("id").cast("string").alias("url"), F.lit("<h2>c</h2><h3>q?</h3><p>a</p>").alias("html")).coalesce(1)
    assert pages._dealt(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "RoundRobinPartitioning" in pages.question_rows(one)._jdf.queryExecution().toString()
    assert pages.question_rows(one).count() == 3


def test_removed_counts_merges_the_lines_once(spark):
    from corpusloom.operators import clean

    rows = spark.createDataFrame([("1", 0, "# Head"), ("1", 1, "x " * 80), ("2", 0, "x " * 80), ("2", 1, "short")], "doc_id string, chunk_index int, content string")
    found = clean.removed_counts(rows)
    assert {r.step: r.removed for r in found.collect()} == {r.step: r.removed for r in clean_again(clean, rows)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2


def clean_again(clean, rows):
    cleaned, counts = clean.clean_counted(rows)
    cleaned.collect()
    return rows.sparkSession.createDataFrame(list(counts().items()), "step string, removed long").collect()


def _texts():
    import random

    r = random.Random(3)
    odd = ["don't", "\u00e9t\u00e9", "\u65e5\u672c\u8a9e" * 40, "<|endoftext|>", "\n\n", "\n", "  ", "\t ", "\u00a0", "\x1c", "\u2003", "12345", "!!", "\U0001f600", "end. ", "\n## head ", "x" * 900, "-" * 700]
    word = lambda: r.choice(odd) if r.random() < 0.2 else "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
    return ["", " ", "\n" * 3000, "y" * 5000, " x" * 1700, *["".join(word() + r.choice([" ", " ", "", "\n", ". "]) for _ in range(r.choice([30, 400, 3000]))) for _ in range(40)]]


def _whole(tokens):
    """The same tokenizer, asked for whole texts alone."""
    from corpusloom.functions import chunking

    class Whole:
        count = staticmethod(lambda text: len(tokens.tokenizer.encode(text, add_special_tokens=False).ids))
        fits = staticmethod(lambda text, n: Whole.count(text) <= n)
        tail = staticmethod(lambda text, n: tokens.tokenizer.decode(tokens.tokenizer.encode(text, add_special_tokens=False).ids[-n:], skip_special_tokens=False))

    return chunking, Whole()


def test_tokens_of_parts_are_those_of_the_whole():
    import public_tokenizers

    tokens = __import__("corpusloom.functions.chunking", fromlist=["x"]).encoded(public_tokenizers.path("byte_bpe_50k.json"))
    chunking, whole = _whole(tokens)
    assert tokens.by_parts
    for text in _texts():
        n = whole.count(text)
        assert [tokens.fits(text, m) for m in (n - 1, n, n + 1, 200, 800)] == [whole.fits(text, m) for m in (n - 1, n, n + 1, 200, 800)]
        assert all(tokens.tail(text, m) == whole.tail(text, m) for m in (1, 7, 200))
        for kind in ("guide", "statute", "faq"):
            assert chunking.chunks_of("d", kind, text, tokens) == chunking.chunks_of("d", kind, text, whole)


def test_no_more_is_encoded_than_an_answer_needs():
    """Of a long text that does not fit, each rule asked for all tokens, and each of its words was encoded by itself."""
    import public_tokenizers
    from corpusloom.functions import chunking

    tokens, read = chunking._Encoded(public_tokenizers.path("byte_bpe_50k.json")), []
    tokens.ids = lambda text: read.append(len(text)) or tokens._ids(text)
    text = " ".join(f"word{i}" for i in range(20_000))
    assert not tokens.fits(text, 800) and tokens.fits("short", 800) and sum(read) < 10_000
    assert len(chunking.split_to_fit(text, tokens=tokens)) == 20_000 and sum(read) < 50_000


def test_other_tokenizers_are_asked_for_whole_texts(tmp_path):
    from corpusloom.functions import chunking
    from tokenizers import Tokenizer, models, pre_tokenizers

    for split in (pre_tokenizers.ByteLevel(add_prefix_space=True), pre_tokenizers.Whitespace(), None):
        own = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=[("a", "b")]))
        if split is not None:
            own.pre_tokenizer = split
        own.save(path := str(tmp_path / "own.json"))
        tokens = chunking._Encoded(path)
        assert not tokens.by_parts and tokens.fits("ab ab", tokens.count("ab ab")) and not tokens.fits("ab ab", tokens.count("ab ab") - 1)


def test_documents_of_a_range_are_scored_in_parts(monkeypatch):
    """A range's documents were scored at once, by all queries: 4,096 by 1,024 in several copies."""
    import numpy as np
    import pyarrow as pa
    from corpusloom.operators import bm25_index as X

    r = np.random.default_rng(1)
    lists = [np.sort(r.choice(5000, n, replace=False)) for n in (4000, 900, 1)]
    rows = pa.RecordBatch.from_arrays([pa.array(lists), pa.array([r.integers(1, 5, len(x)).astype(np.int32) for x in lists]), pa.array([(x % 97 + 5).astype(np.int32) for x in lists])], ["ids", "counts", "lengths"])
    seen, add = [], X._Best.add
    monkeypatch.setattr(X._Best, "add", lambda self, values, ids: seen.append(values.shape[1]) or add(self, values, ids))

    def best(docs):
        monkeypatch.setattr(X, "DOCS", docs)
        scorer = X._Scorer(weights, 7, 40.0, np.arange(3))
        scorer.take(np.arange(3), np.full(3, 2.5), rows)
        return [b.to_pydict() for b in scorer.batches(np.arange(100))][0]

    weights = r.random((3, 100))
    whole = best(10_000)
    seen.clear()
    assert best(512) == whole and max(seen) <= 512


def test_an_index_is_built_of_small_batches(spark, tmp_path):
    from corpusloom.operators import bm25_index as X

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    X.build(spark.createDataFrame([(1, "a b")], "id long, content string"), str(tmp_path / "index"))
    assert spark.conf.get(name) == "1000"
