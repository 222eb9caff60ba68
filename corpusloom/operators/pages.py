"""Pages to documents: parsing, links, questions with answers, and walks over the link graph."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusloom.functions import html as H
from corpusloom.functions.text import RENTER_WORDS, citations, contains_any, content_hash, content_type, slug_id

_STRINGS = ArrayType(StringType())
PARSED = StructType([StructField("title", StringType()), StructField("markdown", StringType()), *(StructField(n, _STRINGS) for n in ("headings", "links", "pdf_links"))])
_QUESTION = StructType([StructField(n, StringType()) for n in ("question", "answer", "category")])


def parsed_by(references: tuple[str, ...] | None = None):
    """A UDF of url and html that gives ``PARSED``; ``references`` as in ``html.parse``."""

    @F.pandas_udf(PARSED)
    def parsed(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        """Title, headings and links of the whole page; Markdown of its main part without noise."""
        rows = []
        for u, text in zip(url, html, strict=True):
            root = H.parse(text, references)
            found = (H.title(root), H.headings(root), H.links(root, u or ""), H.pdf_links(root, u or ""))
            rows.append((found[0], H.markdown(H.without_noise(H.main_part(root))), *found[1:]))
        return pd.DataFrame(rows, columns=["title", "markdown", "headings", "links", "pdf_links"])

    return parsed


parsed = parsed_by()


@F.pandas_udf(ArrayType(_QUESTION))
def _questions(html: pd.Series) -> pd.Series:
    return html.map(lambda x: [dict(zip(("question", "answer", "category"), q, strict=True)) for q in H.questions(H.parse(x))])


def documents_of(pages: DataFrame, source: str, least: int = 50) -> DataFrame:
    """pages: url, html. The document columns of pages with at least ``least`` characters of Markdown."""
    p = pages.withColumn("p", parsed("url", "html")).where(F.length("p.markdown") >= least)
    c = F.col("p.markdown")
    return p.select(slug_id(F.lit(source), F.substring_index("url", "//", -1)).alias("doc_id"), F.col("url").alias("source_url"), F.lit(source).alias("source_name"), F.col("p.title").alias("title"), F.col("p.headings").alias("section_headers"), c.alias("content"), content_type(F.col("url")).alias("content_type"), citations(c).alias("legal_citations"), content_hash(c).alias("content_hash"))


#: Parts, for each core, that pages are dealt out to before they are parsed.
DEALT = 4


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages spread over all cores: they compress well, so a file of a few megabytes, which is read as one part, may hold a million."""
    return pages.repartition(DEALT * pages.sparkSession.sparkContext.defaultParallelism)


def question_rows(pages: DataFrame, key: str = "url") -> DataFrame:
    """A row for each question with its answer, numbered within its page."""
    rows = _dealt(pages.select(key, "html")).select(key, F.posexplode(_questions("html")).alias("pos", "q")).select(key, "pos", "q.*")
    return rows.withColumn("content", F.concat(F.lit("**Q: "), F.col("question"), F.lit("**\n\n"), F.col("answer")))


def faq_documents(pages: DataFrame, source: str, name: str, least: int = 200) -> DataFrame:
    """doc_id, source_url, source_name, title, content, content_type, section_headers: a document for each question, and one of each page's full text.

    Ids hold the question's place in its page and the start of its slug; the category stands before the title and as the section.
    A page of no more than ``least`` characters has no document of its own. pages: url, html; name: the title of full pages.
    """
    q = question_rows(pages).withColumn("category", F.coalesce("category", F.lit("")))
    slug = F.substring(F.regexp_replace(F.lower("question"), "[^a-z0-9]+", "_"), 1, 60)
    none = F.expr("CAST(array() AS array<string>)")
    known = F.col("category") != ""
    items = q.select(slug_id(F.lit(source), F.concat(F.format_string("faq_%03d_", "pos"), slug)).alias("doc_id"), F.col("url").alias("source_url"), F.lit(source).alias("source_name"), F.when(known, F.concat(F.lit("["), "category", F.lit("] "), "question")).otherwise(F.col("question")).alias("title"), "content", F.lit("faq").alias("content_type"), F.when(known, F.array("category")).otherwise(none).alias("section_headers"))
    whole = _dealt(pages.select("url", "html")).select(slug_id(F.lit(source), F.lit("faq_full_page")).alias("doc_id"), F.col("url").alias("source_url"), F.lit(source).alias("source_name"), F.lit(name).alias("title"), _full_text("html").alias("content"), F.lit("faq").alias("content_type"), none.alias("section_headers"))
    return items.unionByName(whole.where(F.length("content") > least))


@F.pandas_udf(StringType())
def _full_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: H.full_text(H.without_noise(H.parse(x))))


# Words of addresses that a legal aid site's tenant pages have.
LEGAL_AID_WORDS = [
    "tenant", "renter", "landlord", "evict", "lease", "rent", "deposit", "housing", "utility", "heat", "repair", "habitability",
    "sublet", "discrimination", "section-8", "voucher", "mold", "bed-bug", "notice", "rights", "court", "small-claims",
]


def is_renter_url(url: Column) -> Column:
    return contains_any(F.lower(url), RENTER_WORDS)


def is_legal_aid_url(url: Column) -> Column:
    return contains_any(F.lower(url), LEGAL_AID_WORDS)


def pdf_sweep(links: DataFrame, texts: DataFrame, words: list[str], least: int = 100) -> DataFrame:
    """url, parent_url, title, content of the PDFs that any page links to whose address has one of the words and whose text is long enough.

    links: src, dst (absolute); texts: url, content, as extracted from landed files. A PDF that several pages link to comes once, under the least of them.
    """
    wanted = links.where(contains_any(F.lower("dst"), words)).groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent_url"))
    name = F.regexp_replace(F.lower(F.parse_url("url", F.lit("PATH"))), r"^/+|/+$", "")
    title = F.initcap(F.translate(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("/"), F.lit("_")), "[^a-z0-9_.]", "_"), r"\.pdf$", ""), "_", " "))
    return wanted.join(texts.where(F.length("content") >= least), "url").select("url", "parent_url", title.alias("title"), "content")


def text_headings(c: Column, most: int = 20) -> Column:
    """Headings of a text page by marks, else bold passages."""
    marked = F.regexp_extract_all(c, F.lit(r"(?m)^#+[ \t]+([^\n]+)$"), F.lit(1))
    bold = F.regexp_extract_all(c, F.lit(r"\*\*([^\n]+?)\*\*"), F.lit(1))
    return F.slice(F.when(F.size(marked) > 0, marked).otherwise(bold), 1, most)


def browser_document(pages: DataFrame, source: str) -> DataFrame:
    """doc_id, source_url, source_name, title, section_headers, content, content_type, legal_citations, content_hash of pages whose text a browser gave. pages: url, title, content."""
    c = F.col("content")
    return pages.select(slug_id(F.lit(source), F.substring_index("url", "//", -1)).alias("doc_id"), F.col("url").alias("source_url"), F.lit(source).alias("source_name"), "title", text_headings(c).alias("section_headers"), "content", content_type(F.col("url")).alias("content_type"), citations(c).alias("legal_citations"), content_hash(c).alias("content_hash"))


def _settled(df: DataFrame) -> DataFrame:
    """A level as it is, so that the next ones do not compute it again: in the checkpoint folder where there is one, else kept."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def crawl(edges: DataFrame, roots: DataFrame, depth: int = 2, follow: Callable[[Column], Column] | None = None) -> DataFrame:
    """url, depth, parent_url of pages reached from the roots, by least depth then least parent. edges: src, dst; roots: url.

    Only links that ``follow`` (a predicate on the address) lets through are gone along. A bounded number of anti-joins: each level
    keeps only pages not met before, and is stored before the next where more than two follow.
    """
    if follow is not None:
        edges = edges.where(follow(F.col("dst")))
    level = roots.select("url", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent_url")).distinct()
    seen = level
    for d in range(1, depth + 1):
        step = level.select(F.col("url").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent_url"))
        level = step.join(seen.select("url"), "url", "left_anti").select("url", F.lit(d).alias("depth"), "parent_url")
        level = _settled(level) if depth > 2 and d < depth else level
        seen = seen.unionByName(level)
    return seen


#: Titles that addresses are matched with.
TITLES = 1000


def match_titles(urls: DataFrame, titles: DataFrame) -> DataFrame:
    """url, chapter: by a chapter number in the url, else the first title of which two words (or its only one) are in it.

    titles: chapter, title; at most TITLES of them (more raise), which go along with each address, so nothing is joined.
    """
    listed = titles.select("chapter", "title").limit(TITLES + 1).collect()
    if len(listed) > TITLES:
        raise ValueError(f"at most {TITLES} titles")
    n = F.regexp_extract(F.lower("url"), r"chapter[_-]?(\d{1,2})", 1)
    number, url = F.when(n != "", n.try_cast("int")), F.lower("url")
    choices = []
    for r in sorted(listed, key=lambda r: r["chapter"]):
        words = [w for w in re.split("[^a-z0-9]+", (r["title"] or "").lower()) if w]
        shared = sum((F.contains(url, F.lit(w)).cast("int") for w in words), F.lit(0))
        choices.append((F.lit(r["chapter"]), shared >= min(2, len(words))))
    by_number = F.coalesce(*[F.when(number == c, c) for c, _ in choices]) if choices else F.lit(None).cast("int")
    by_words = F.coalesce(*[F.when(fits, c) for c, fits in choices]) if choices else F.lit(None).cast("int")
    return urls.select("url", F.coalesce(by_number, by_words).alias("chapter")).where("chapter is not null").distinct()


def missing_keys(known: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The numbers from first to last that known has not: what a fallback has to fetch."""
    return known.sparkSession.range(first, last + 1).select(F.col("id").alias(key)).join(known.select(F.col(key).cast("long").alias(key)).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, newest: str) -> DataFrame:
    """One row for each key, the one of greatest ``newest``; of equals a new one, then the one of least hash, so that a second run gives the same."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(newest).desc(), F.col("_new").desc(), F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in old.columns]))]))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
