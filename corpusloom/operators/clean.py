"""The corpus cleaner: document and chunk predicates in their fixed order, heading merge, dedup, reindex.

Every predicate is a Column that is true where a row goes. Document predicates need only doc_id and
can move before chunking; chunk predicates come after headings are merged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_any, dedup_key, hits, lines, non_ascii_share, strip

# Marks of translations and of phrases that only navigation has.
LANGUAGES = "arabic cape_verdean chinese haitian spanish vietnamese french portuguese russian somali".split()
BOILERPLATE = ["upcoming events", "latest updates", "toggle", "page sections", "skip to main content", "back to top", "cookie", "subscribe to"]
# Signals of home buying and of renting.
BUYER = "homebuyer|home buyer|buying a home|homeownership|homebuying|HomeBuyer"
RENTER = "tenant|renter|landlord|evict|lease|rent(?:al|er|ing)|deposit"
MIN_LENGTH = 100


def is_translation(doc_id: Column) -> Column:
    return contains_any(F.lower(doc_id), LANGUAGES)


def is_oversized(doc_id: Column, markers: list[str]) -> Column:
    return contains_any(F.lower(doc_id), markers)


def without_documents(chunks: DataFrame, blocked: DataFrame) -> DataFrame:
    """Chunks whose doc_id is not in blocked (doc_id)."""
    return chunks.join(blocked.select("doc_id").distinct(), "doc_id", "left_anti")


def is_non_english(c: Column) -> Column:
    return (F.length(c) > 50) & (non_ascii_share(c) > 0.15)


def is_home_buying(c: Column) -> Column:
    return (hits(c, BUYER) >= 2) & (hits(c, RENTER) == 0)


def is_endnote(c: Column) -> Column:
    words = F.filter(F.split(strip(c), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    rest = F.regexp_replace(strip(c), r"[0-9 \t\n\r\f\x0B.,;:()\-–—/]", "")
    return (F.size(words) < 5) & (F.length(F.regexp_replace(rest, r"https?://[^ \t\n\r\f\x0B]+", "")) < 10)


def is_link_list(c: Column, doc_id: Column) -> Column:
    text = strip(c)
    rows = lines(c)
    body = F.filter(rows, lambda x: ~F.startswith(x, F.lit("#")))
    n = F.size(body)
    open_ends = F.size(F.filter(body, lambda x: ~F.endswith(x, F.lit("."))))
    menu = (n >= 3) & F.forall(body, lambda x: F.length(x) < 60) & (F.length(text) < 600) & (open_ends > 0.7 * n)
    linked = F.size(F.filter(body, lambda x: (F.length(x) < 80) & ~F.substring(x, -1, 1).isin(".", "!", "?", ":", ";")))
    total = F.aggregate(body, F.lit(0), lambda a, x: a + F.length(x))
    sitemap = (n >= 8) & ~F.startswith(doc_id, F.lit("masslegalhelp_")) & (linked > 0.65 * n) & (total < 45 * n)
    lower = F.lower(text)
    letter = F.contains(lower, F.lit("sign up")) & F.contains(lower, F.lit("newsletter")) & (F.length(text) < 300)
    contents = (F.length(text) < 600) & F.contains(text, F.lit("..."))
    return (F.size(rows) == 0) | menu | sitemap | F.contains(text, F.lit("<time datetime=")) | letter | contents


def is_header_only(c: Column) -> Column:
    rows = lines(c)
    body = F.filter(rows, lambda x: ~F.startswith(x, F.lit("#")))
    headings = F.size(rows) - F.size(body)
    return (F.size(rows) == 0) | ((F.size(rows) >= 2) & (headings > 0.75 * F.size(rows)) & (F.length(F.array_join(body, " ")) < 50))


def is_short(c: Column, least: int = MIN_LENGTH) -> Column:
    return F.length(strip(c)) < least


def is_boilerplate(c: Column) -> Column:
    rows, size = lines(c), F.length(strip(c))
    return (F.size(rows) == 0) | (F.forall(rows, lambda x: F.length(x) < 40) & (size < 150)) | (contains_any(F.lower(c), BOILERPLATE) & (size < 200))


def merge_headings(chunks: DataFrame) -> DataFrame:
    """Heading chunks join the next body chunk of their document, trailing ones the last body, lone ones the last chunk.

    chunks: doc_id, chunk_index, content. One window and one aggregation on doc_id share a shuffle.
    """
    text = strip(F.col("content"))
    heading = (F.length(text) < 100) & (F.startswith(text, F.lit("#")) | F.regexp_like(text, F.lit(r"^[A-Z \t\n\r\f\x0B0-9.:§()]+\z")))
    w = Window.partitionBy("doc_id")
    marked = chunks.withColumn("heading", heading)
    body = F.when(~F.col("heading"), F.col("chunk_index"))
    following = F.min(body).over(w.orderBy("chunk_index").rowsBetween(0, Window.unboundedFollowing))
    target = F.coalesce(following, F.max(body).over(w), F.max("chunk_index").over(w))
    part = F.struct("chunk_index", F.when(F.col("heading"), strip(F.col("content"))).otherwise(F.col("content")).alias("part"))
    grouped = marked.withColumn("target", target).groupBy("doc_id", "target").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("doc_id", F.col("target").alias("chunk_index"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("content"))


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by the order columns: one scan and one shuffle, in which a hot key is reduced within each task before it."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")


def dedup_by_content(chunks: DataFrame, *order: str) -> DataFrame:
    return keep_first(chunks, dedup_key(F.col("content")), *order)


def reindex(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id")
    index = F.row_number().over(w.orderBy("chunk_index")) - 1
    again = chunks.withColumns({"chunk_index": index, "total_chunks": F.count("*").over(w).cast("int")})
    return again.withColumn("chunk_id", F.format_string("%s_chunk_%03d", F.col("doc_id").cast("string"), F.col("chunk_index")))


#: Fixed value: the document that holds a whole page of questions.
FULL_PAGE = "bostonhousing_faq_full_page"


def chunk_steps(c: Column, d: Column) -> dict[str, Column]:
    """The chunk predicates by name, in their order."""
    return {"non_english": is_non_english(c), "home_buying": is_home_buying(c), "endnote": is_endnote(c), "link_list": is_link_list(c, d), "header_only": is_header_only(c), "short": is_short(c), "boilerplate": is_boilerplate(c)}


def document_steps(d: Column, oversized: list[str] | None) -> dict[str, Column]:
    return {"full_page": d == FULL_PAGE, "translation": is_translation(d)} | ({"oversized": is_oversized(d, oversized)} if oversized else {})


def clean(chunks: DataFrame, blocked: DataFrame | None = None, oversized: list[str] | None = None) -> DataFrame:
    """chunks: doc_id (string), chunk_index, content. All steps in their order."""
    kept = chunks
    for predicate in document_steps(F.col("doc_id"), oversized).values():
        kept = kept.where(~predicate)
    if blocked is not None:
        kept = without_documents(kept, blocked)
    merged = merge_headings(kept)
    for predicate in chunk_steps(F.col("content"), F.col("doc_id")).values():
        merged = merged.where(~predicate)
    return reindex(dedup_by_content(merged, "doc_id", "chunk_index"))


def removed_counts(chunks: DataFrame, blocked: DataFrame | None = None, oversized: list[str] | None = None) -> DataFrame:
    """step, removed: chunks that each step of ``clean`` takes away after the steps before it; merged headings count under "merge"."""
    named = lambda steps: reduce(lambda w, s: w.when(s[1], s[0]), list(steps.items())[1:], F.when(*reversed(next(iter(steps.items())))))
    before = chunks.withColumn("_step", named(document_steps(F.col("doc_id"), oversized)))
    if blocked is not None:
        listed = blocked.select("doc_id", F.lit("blocked").alias("_blocked")).distinct()
        before = before.join(listed, "doc_id", "left").withColumn("_step", F.coalesce("_step", "_blocked")).drop("_blocked")
    merged = merge_headings(before.where("_step is null").drop("_step")).withColumn("_step", named(chunk_steps(F.col("content"), F.col("doc_id"))))
    lines_ = before.groupBy("_step").agg(F.count("*").alias("n"))
    keyed = merged.groupBy("_step", F.when(F.col("_step").isNull(), dedup_key(F.col("content"))).alias("_k")).agg(F.count("*").alias("n"))
    chunks_ = keyed.groupBy("_step").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("again"))
    # each side is computed once: its rows (a few steps) tell what went, and what was merged from the one side to the other
    row = lambda step, n: F.struct(step.alias("step"), n.alias("removed"))
    step, n = F.col("_step"), F.col("n")
    first = lines_.select(row(F.coalesce(step, F.lit("merge")), n).alias("r"))
    second = chunks_.select(F.explode(F.array(row(F.lit("merge"), -n), row(F.coalesce(step, F.lit("duplicate")), F.when(step.isNull(), F.col("again")).otherwise(n)))).alias("r"))
    return first.unionByName(second).select("r.*").groupBy("step").agg(F.sum("removed").alias("removed")).where("removed > 0")


def clean_counted(chunks: DataFrame, blocked: DataFrame | None = None, oversized: list[str] | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``clean`` with counters along the way, and what reads them once an action has run: what each step took away, as ``removed_counts`` says.

    The lines are read and cleaned once. Counters are Spark's observations: tasks that run again after the loss of an executor count again,
    so ``removed_counts`` is the one for exact figures on a cluster that loses some.
    """
    tell = lambda steps: [F.count_if(F.col("_step") == n).alias(n) for n in steps]
    first, second, third = (Observation() for _ in range(3))
    named = lambda steps: reduce(lambda w, s: w.when(s[1], s[0]), list(steps.items())[1:], F.when(*reversed(next(iter(steps.items())))))
    documents, parts = document_steps(F.col("doc_id"), oversized), chunk_steps(F.col("content"), F.col("doc_id"))
    marked = chunks.withColumn("_step", named(documents))
    if blocked is not None:
        listed = blocked.select("doc_id", F.lit("blocked").alias("_blocked")).distinct()
        marked = marked.join(listed, "doc_id", "left").withColumn("_step", F.coalesce("_step", "_blocked")).drop("_blocked")
    seen = marked.observe(first, *tell([*documents, "blocked"]), F.count_if(F.col("_step").isNull()).alias("kept"))
    merged = merge_headings(seen.where("_step is null").drop("_step")).withColumn("_step", named(parts))
    merged = merged.observe(second, *tell(parts), F.count("*").alias("all"), F.count_if(F.col("_step").isNull()).alias("kept"))
    last = dedup_by_content(merged.where("_step is null").drop("_step"), "doc_id", "chunk_index").observe(third, F.count("*").alias("kept"))

    def counts() -> dict[str, int]:
        a, b, c = first.get, second.get, third.get
        found = {n: a[n] for n in [*documents, "blocked"]} | {"merge": a["kept"] - b["all"]} | {n: b[n] for n in parts} | {"duplicate": b["kept"] - c["kept"]}
        return {n: v for n, v in found.items() if v}

    return reindex(last), counts


def step_counts(chunks: DataFrame) -> DataFrame:
    """Rows that each chunk predicate would remove, in one pass."""
    c, d = F.col("content"), F.col("doc_id")
    steps = chunk_steps(c, d)
    counted = chunks.agg(*[F.count_if(p).alias(k) for k, p in steps.items()])
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, steps)), F.array(*steps))).alias("step", "removed"))
