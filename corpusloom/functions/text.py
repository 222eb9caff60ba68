"""Scalar functions on text as Columns: they stay in the JVM and within generated code.

White space means the ASCII characters \\x09-\\x0D and space, as in the SQL that checks the queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]"

# Citation patterns, matched without regard to case.
CITATIONS = [
    r"MGL\s+c\.?\s*\d+[A-Z]?\s*,?\s*(?:s\.|§|sec(?:tion)?\.?)\s*\d+[A-Z]?",
    r"M\.?G\.?L\.?\s+c(?:h(?:apter)?)?\.?\s*\d+[A-Z]?\s*,?\s*(?:s\.|§|sec(?:tion)?\.?)\s*\d+[A-Z]?",
    r"G\.?L\.?\s+c\.?\s*\d+[A-Z]?\s*,?\s*§?\s*\d+[A-Z]?",
    r"Chapter\s+\d+[A-Z]?\s*,?\s*Section\s+\d+[A-Z]?",
    r"\d{3}\s+CMR\s+\d+\.\d+",
    r"\d{3}\s+C\.?M\.?R\.?\s+\d+\.\d+",
]
# Words that token sets leave out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by "
    "from as into through during before after above below between out off over under again further then once here there when where why how all "
    "both each few more most other some such no nor not only own same so than too very just or and but if it its i me my we our you your he him "
    "his she her they them their what which who whom this that these those am about up"
).split()
# Marks of pages about renting.
RENTER_WORDS = "rent tenant evict lease landlord housing deposit voucher section-8 habitability repair mold bed-bug discrimination fair-housing".split()


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\x0B"))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"{WS}+", " ")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def slug_id(source: Column, slug: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(source, F.lit("_"), body), 1, 120)


def dedup_key(c: Column) -> Column:
    return F.md5(collapse(F.lower(c)))


def citations(c: Column) -> Column:
    """Distinct matches of all patterns, sorted; patterns overlap, so parts of a match can come too."""
    found = [F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(0)) for p in CITATIONS]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), strip)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), F.array(*map(F.lit, STOP_WORDS)))


def containment(query: Column, reference: Column) -> Column:
    """Share of the query's token set that the reference has; 0 without tokens."""
    q = token_set(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, token_set(reference))) / F.size(q))


def token_estimate(c: Column) -> Column:
    """Tokens at four characters each, rounded up; the default where no tokenizer is given."""
    return F.ceil(F.length(c) / 4).cast("int")


def keep_separator_split(c: Column, separator: str) -> Column:
    """Parts of the text, each but the first led by the separator; blank parts go, unless there is no separator at all."""
    parts = F.split(c, f"(?=\\Q{separator}\\E)", -1)
    return F.when(~F.contains(c, F.lit(separator)), F.array(c)).otherwise(F.filter(parts, lambda x: strip(x) != ""))


def non_ascii_share(c: Column) -> Column:
    """Not a number for an empty text, as in SQL."""
    return F.when(F.length(c) == 0, float("nan")).otherwise(F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / F.length(c))


def hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(f"(?i){pattern}"))


def lines(c: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def normalise_blank_lines(c: Column) -> Column:
    spaces = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    joined = F.array_join(F.transform(F.split(spaces, "\n"), strip), "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def regulation_text(c: Column) -> Column:
    """Running heads and register footers out, hyphens at line ends closed, white space normalised."""
    # The two running heads and the footer's form.
    for pattern, by in ((r"940 CMR: OFFICE OF THE ATTORNEY GENERAL\n?", ""), (r"105 CMR: DEPARTMENT OF PUBLIC HEALTH\n?", ""), (r"\(Mass\. Register #[0-9]+.*?\)\n?", ""), (r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")):
        c = F.regexp_replace(c, pattern, by)
    return normalise_blank_lines(c)


def section_headings(c: Column, title: Column) -> Column:
    """The title as first heading, numbered sections as second ones."""
    whole = F.concat(F.lit("# "), title, F.lit("\n\n"), c)
    whole = F.regexp_replace(whole, r"(?m)^(\d+\.\d+(?:\.\d+)?):?[ \t\n]+([A-Z][^\n]*?)$", "## $1: $2")
    return F.regexp_replace(whole, r"(?m)^(\d+\.\d+(?:\.\d+)?):?[ \t\n]+continued$", "## $1 (continued)")


def _last(c: Column, what: str) -> Column:
    """Zero-based place of the last occurrence, -1 without one."""
    place = F.locate(what[::-1], F.reverse(c))
    return F.when(place == 0, -1).otherwise(F.length(c) - place - (len(what) - 1))


def truncate_answer(c: Column, most: int = 800) -> Column:
    """At the last blank line or sentence end in the window's second half, else at ``most`` characters."""
    window = F.substring(c, 1, most)
    paragraph = _last(window, "\n\n")
    sentence = F.greatest(*[_last(window, x) for x in (". ", ".\n", "! ", "? ")])
    cut = F.when(paragraph > most // 2, strip(F.substring(c, F.lit(1), paragraph))).when(sentence > most // 2, strip(F.substring(c, F.lit(1), sentence + 1))).otherwise(strip(window))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def yes_verdict(c: Column) -> Column:
    return F.startswith(F.upper(strip(c)), F.lit("YES"))


def fact_verdict(judgement: Column, index: Column) -> Column:
    """Whether the first line for FACT ``index`` says YES before a dash; absent without such a line."""
    upper = F.transform(F.split(judgement, "\n"), lambda x: F.upper(strip(x)))
    own = F.filter(upper, lambda x: F.startswith(x, F.concat(F.lit("FACT "), index.cast("string"), F.lit(":"))) | F.startswith(x, F.concat(F.lit("FACT "), index.cast("string"), F.lit(" :"))))
    first = F.get(own, F.lit(0))
    after = F.substring(first, F.locate(":", first) + 1, F.length(first))
    said = F.substring_index(F.substring_index(after, "—", 1), "-", 1)
    return F.coalesce(F.contains(said, F.lit("YES")), F.lit(False))


def unfenced(c: Column) -> Column:
    """Text within a fence of three backticks, or the text itself."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-z]*\n?", ""), r"\n?```\z", ""))


def variants(c: Column, n: int) -> Column:
    return F.slice(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), 1, n)


def without_source_note(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\(Source\s*\d+[^)]*\)", ""))


def score_label(score: Column, kind: Column) -> Column:
    fixed = lambda x, n: F.format_string(f"%.{n}f", x)
    return (
        F.when(kind == "cosine_distance", F.concat(fixed(F.greatest(F.lit(0.0), 1 - score), 2), F.lit(" sim")))
        .when(kind == "bm25", F.concat(fixed(score, 1), F.lit(" BM25")))
        .when(kind == "fusion", F.concat(fixed(score * 100, 0), F.lit("% relevance")))
        .when(kind == "cross_encoder", F.concat(fixed(score, 2), F.lit(" relevance")))
        .when(kind == "rrf", F.concat(fixed(score, 3), F.lit(" RRF")))
        .when(score < 1, F.concat(fixed(1 - score, 2), F.lit(" sim")))
        .otherwise(F.concat(fixed(score, 1), F.lit(" score")))
    )


def confidence(c: Column) -> Column:
    """The stated confidence if from 1 to 10."""
    n = F.regexp_extract(c, r"\*\*Confidence:\*?\*?\s*(\d+)", 1)
    value = F.when(n != "", n.try_cast("int"))
    return F.when(value.between(1, 10), value)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 8, "High").when(score >= 5, "Medium").when(score.isNotNull(), "Low")


def without_confidence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\n*\*\*Confidence:\*?\*?\s*\d+[^\n]*", ""), rf"{WS}+\z", "")


def closed_citations(c: Column) -> Column:
    """[Source n: ...] with a missing bracket closed, and its brackets escaped."""
    closed = F.regexp_replace(c, r"(?m)(\[Source\s*\d*\s*:[^\]\n]*?)(?=\n|$|\[Source)", "$1]")
    return F.regexp_replace(closed, r"\[(Source\s*\d*\s*:[^\]]*?)\]", r"\\[$1\\]")


def spaced_sections(c: Column, sections: list[str]) -> Column:
    for s in sections:
        c = F.regexp_replace(c, rf"\*\*{s}:?\*\*:?|\*\*{s}:?", f"\n\n**{s}:**")
    return F.regexp_replace(F.regexp_replace(closed_citations(c), r"^\n+", ""), r"\n{3,}", "\n\n")


def content_type(url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when(contains_any(u, ["malegislature.gov", "general-laws"]), "statute")
        .when(contains_any(u, ["regulation", "cmr"]), "regulation")
        .when(F.contains(u, F.lit("faq")), "faq")
        .when(contains_any(u, ["policy", "executive-order"]), "policy")
        .otherwise("guide")
    )


def chatml(question: Column, answer: Column, system: Column | None = None) -> Column:
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>"))
    turns = [turn("user", strip(question)), turn("assistant", strip(answer))]
    return F.concat_ws("\n", *([turn("system", system)] if system is not None else []), *turns)


def rag_system(system: str, context: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{system}\n\nRETRIEVED CONTEXT:\n"), strip(context), F.lit("\n\nQUESTION: "), strip(question))


def question_for(kind: Column, source: Column, title: Column, content: Column) -> Column:
    """A question that a chunk answers, by its content type."""
    first = F.trim(F.get(F.split(content, "\n"), F.lit(0)))
    cited = F.regexp_extract(content, r"(MGL\s+c\.\s*\d+[A-Z]?|CMR\s+\d+)", 1)
    return (
        F.when((kind == "faq") & F.endswith(first, F.lit("?")), first)
        .when(kind == "faq", F.concat(F.lit("What does "), source, F.lit(" say about "), F.lower(title), F.lit("?")))
        .when(kind.isin("statute", "regulation") & (cited != ""), F.concat(F.lit("What does "), cited, F.lit(" say about tenant rights in Massachusetts?")))
        .when(kind.isin("statute", "regulation"), F.concat(F.lit("What are the legal requirements under "), title, F.lit("?")))
        .when(kind == "guide", F.concat(F.lit("What guidance does "), source, F.lit(" provide about "), F.lower(title), F.lit("?")))
        .otherwise(F.concat(F.lit("What does Massachusetts law say about "), F.lower(title), F.lit("?")))
    )
