"""Chunks and sentences as Columns: everything stays in the JVM.

A level of the recursive split replaces each piece that is too long by its parts at one separator, so six levels are six
transforms of an array. Tokens are estimated at four characters each; ``chunking`` does the same in Python with a tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.chunking import ABBREVIATIONS, CHARS_PER_TOKEN, CHUNK_TOKENS, LEAST_CHARS, OVERLAP_TOKENS, SEPARATORS

#: White space of Unicode as a class for Java's and RE2's patterns.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# What may begin a sentence after an end, and the marks of a statute's parts.
CAPITAL = "[A-Z(“\"‘]"
STATUTE_PART = rf"\n[{SPACE}]*\([a-z]\)[{SPACE}]+|\n[{SPACE}]*Section[{SPACE}]+\p{{Nd}}+"
END = rf"[.!?][{SPACE}]+(?={CAPITAL})"
#: The end of what stands before a mark, without its dots, where no sentence ends: an abbreviation, a single letter, a number with a letter or a number of one or two digits.
UNENDED = rf"(?:^|[{SPACE}])(?:(?i:{'|'.join(re.escape(x) for x in sorted(ABBREVIATIONS))})|\p{{L}}|\p{{Nd}}{{1,2}})\z|\p{{Nd}}[A-Za-z]\z"
_TAIL = 12  # characters that tell, as abbreviations are shorter
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LONG_LINE = 200


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def filled(c: Column) -> Column:
    """Whether a text holds anything but white space."""
    return c.rlike(f"[^{SPACE}]")


def tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / CHARS_PER_TOKEN)


def parts_at(piece: Column, separator: str) -> Column:
    """Parts that begin at each separator, without blank ones; the piece itself where it has none."""
    parts = F.split(piece, re.escape(separator), -1)
    led = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(separator), x)))
    return F.when(F.contains(piece, F.lit(separator)), F.filter(led, filled)).otherwise(F.array(piece))


def cut_at(piece: Column, size: int) -> Column:
    """Cuts of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(piece) - 1) / size)))
    return F.transform(starts, lambda i: F.substring(piece, (i * size + 1).cast("int"), F.lit(size)))


def fitting(pieces: Column, limit: int = CHUNK_TOKENS) -> Column:
    """Pieces of at most ``limit`` tokens: each longer one is cut at the strongest separator that is left, and small ones are not joined again."""

    def level(pieces: Column, cut: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(pieces, lambda x: F.when(tokens(x) <= limit, F.array(x)).otherwise(cut(x))))

    pieces = reduce(lambda held, separator: level(held, lambda x: parts_at(x, separator)), SEPARATORS, pieces)
    return level(pieces, lambda x: cut_at(x, limit * CHARS_PER_TOKEN))


def overlap_of(piece: Column, n: int = OVERLAP_TOKENS) -> Column:
    """What the next piece repeats: the last n tokens of a piece of more, from the first blank line in them, else sentence end, on."""
    tail = F.substring(piece, -n * CHARS_PER_TOKEN, n * CHARS_PER_TOKEN)
    blank, end = r"\n\n+", rf"[.!?][{SPACE}]+"
    after = lambda mark: F.regexp_extract(tail, rf"(?s)^.*?{mark}(.*)$", 1)
    return F.when(tokens(piece) <= n, "").when(tail.rlike(blank), after(blank)).when(tail.rlike(end), after(end)).otherwise(tail)


def statute_parts(text: Column) -> Column:
    """A text cut before each mark of a part; marks do not overlap."""
    mark = f"(?i){STATUTE_PART}"
    both = F.arrays_zip(F.split(text, mark, -1).alias("part"), F.array_prepend(F.regexp_extract_all(text, F.lit(mark), F.lit(0)), F.lit("")).alias("mark"))
    return F.filter(F.transform(both, lambda x: F.concat(x["mark"], x["part"])), lambda x: x != "")


def pieces_of(doc_id: Column, kind: Column, text: Column) -> Column:
    """A document's pieces before overlaps, and null where it is one chunk or none: see ``chunks_of``."""
    whole = (kind == "faq") & (tokens(text) <= 2 * CHUNK_TOKENS) | (kind != "statute") & (tokens(text) <= CHUNK_TOKENS)
    return F.when(F.contains(doc_id, F.lit("faq_full_page")) | whole, F.lit(None)).otherwise(fitting(F.when(kind == "statute", statute_parts(text)).otherwise(F.array(text))))


def chunks_of(doc_id: Column, text: Column, pieces: Column) -> Column:
    """A document's chunks: short questions whole, statutes by their parts, the rest by separators, each led by the overlap of the one before as that was without its own."""
    led = F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(overlap_of(F.get(pieces, i - 1)), x)))
    kept = F.filter(F.transform(led, stripped), lambda x: F.length(x) >= LEAST_CHARS)
    return F.when(F.contains(doc_id, F.lit("faq_full_page")), F.array().cast("array<string>")).when(pieces.isNull(), F.array(text)).otherwise(kept)


def plain_spaces(text: Column) -> Column:
    """Runs of spaces and tabs as one space."""
    return F.regexp_replace(text, "[ \t]{2,}|\t", " ")


def unended(piece: Column) -> Column:
    """Whether a mark after this ends no sentence; a line may end between them."""
    line = F.when(F.endswith(piece, F.lit("\n")), F.substring(piece, F.lit(1), F.length(piece) - 1)).otherwise(piece)
    core = F.rtrim(line, F.lit("."))
    return F.right(core, F.lit(_TAIL)).rlike(UNENDED)


def sentence_parts(plain: Column) -> Column:
    """Structs of a text's pieces up to where a sentence could end (``piece``), what ends them (``mark``: the mark and white space; '' at the end) and whether a sentence does (``last``)."""
    both = F.arrays_zip(F.split(plain, END, -1).alias("piece"), F.regexp_extract_all(plain, F.lit(END), F.lit(0)).alias("mark"))
    return F.transform(both, lambda x: F.struct(F.concat(x["piece"], F.coalesce(x["mark"], F.lit(""))).alias("piece"), (x["mark"].isNull() | ~unended(x["piece"])).alias("last")))


def sentence_ends(parts: Column) -> Column:
    """Indices of the parts that end a sentence."""
    return F.filter(F.transform(parts, lambda x, i: F.when(x["last"], i)), lambda i: i.isNotNull())


def sentences_of(plain: Column, parts: Column, ends: Column) -> Column:
    """Sentences from their parts. A long text without an end inside is cut at its lines."""

    def joined(end: Column, i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
        own = F.when(first == end, F.get(parts, end)["piece"]).otherwise(F.array_join(F.transform(F.slice(parts, first + 1, end + 1 - first), lambda x: x["piece"]), ""))
        return stripped(own)

    found = F.filter(F.transform(ends, joined), lambda x: x != "")
    rows = F.filter(F.transform(F.split(plain, "\n"), stripped), lambda x: x != "")
    return F.when((F.size(ends) <= 2) & (F.size(found) <= 1) & (F.length(plain) > LONG_LINE) & (F.size(rows) > 1), rows).otherwise(found)


def with_sentences(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with an array of the sentences of a text: ends at . ! or ? before white space and a capital, bracket or quote, but not after abbreviations, single letters, numbers with a letter or short numbers."""
    steps = {"_split_plain": plain_spaces(F.coalesce(F.col(text), F.lit("")))}, {"_split_parts": sentence_parts(F.col("_split_plain"))}, {"_split_ends": sentence_ends(F.col("_split_parts"))}, {name: sentences_of(F.col("_split_plain"), F.col("_split_parts"), F.col("_split_ends"))}
    return reduce(lambda d, step: d.withColumns(step), steps, rows).drop("_split_plain", "_split_parts", "_split_ends")
