"""Token counts by prefix dynamic programming.

For a pretoken, the encoding of each prefix ends in exactly one token whose pair with the last token
before it would survive encoding together; so counts of all prefixes follow from left to right:
count[i] = count[i - len(t)] + 1 for the token t ending at i that goes with the last token at
i - len(t). Tokens that end at a place come from an automaton of all tokens, the longest first; pairs are tried
once and remembered. Distinct pretokens are solved once per worker (at most CACHE_WORDS are remembered; most of a corpus's distinct
words are rare, so a table of the whole corpus would save little), documents add up
their pretokens' counts. ``prefix_counts`` keeps the count of every prefix of every document, from which
truncation and budgets are read off without encoding anything again.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_columns, map_text, ship_package
from corpusloom.llm.packing import TOKENIZER, _encoding
from corpusloom.llm.pretokens import Pretokens, Seen, classes, keys_of
from corpusloom.llm.textkernel import distinct

LIMIT = 1024
CACHE_WORDS, CACHE_PAIRS = 500_000, 500_000
SPECIAL = "<|endoftext|>"
_SPACE = 3


class PrefixCounter:
    """Token counts of the prefixes of pretokens."""

    def __init__(self, name: str = TOKENIZER):
        self.encode = _encoding(name)._encode_single_piece
        self.tokens = {r: t for t, r in _encoding(name)._mergeable_ranks.items()}
        self.ends = ahocorasick.Automaton()
        for r, t in self.tokens.items():
            self.ends.add_word(t.decode("latin-1"), (r, len(t)))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Leave the tokens alone, each of which is a pretoken of one token."""
        self.seen, self.longer = Seen(), {}
        self.seen.add(*keys_of(list(self.tokens.values()), self.longer))
        self.totals = np.ones(len(self.tokens), np.int64)
        self.least = len(self.totals)

    def _together(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.encode(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def counts(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for i from 0 to len(word)."""
        together = self._together
        last, counts = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end, (t, n) in self.ends.iter(word.decode("latin-1")):  # by end, of equals the longest first
            if last[end + 1] >= 0:
                continue
            j = end + 1 - n
            if j == 0 or together(last[j], t):
                last[end + 1] = t
                counts[end + 1] = counts[j] + 1
        return counts

    def text_totals(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, without special strings."""
        if len(self.totals) - self.least > CACHE_WORDS:
            self.forget()
        t = Pretokens(texts, "tokenizers")
        lo, hi = t.keys(self.longer)
        first, inverse = distinct(lo, hi)
        lo, hi = lo[first], hi[first]
        rows = self.seen.find(lo, hi)
        new = np.flatnonzero(rows < 0)
        if len(new):
            data = t.data.tobytes()
            totals = [self.counts(data[a:b])[-1] for a, b in zip(t.starts[first[new]].tolist(), t.ends[first[new]].tolist(), strict=True)]
            rows[new] = self.seen.add(lo[new], hi[new])
            self.totals = np.concatenate([self.totals, np.array(totals, np.int64)])
        return np.bincount(t.owner, self.totals[rows[inverse]], minlength=t.n).astype(np.int64)


@cache
def counter(name: str) -> PrefixCounter:
    return PrefixCounter(name)


class TextPrefixes:
    """The exact token count of every prefix of one text, in code points, from its pretokens' tables."""

    def __init__(self, text: str, name: str = TOKENIZER):
        self.text, self.counter = text, counter(name)
        self.parts: list[tuple[int, int, str]] = []  # where a stretch without special strings begins, tokens before it, the stretch
        at = before = 0
        self._tables: list[tuple[np.ndarray, np.ndarray, list[list[int]]]] = []
        self._places: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bytes before each code point, white space, where its run begins
        self._runs: dict[tuple[int, int], list[int]] = {}  # counts of the prefixes of runs of white space
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                at, before = at + len(SPECIAL), before + 1
            p = Pretokens([part], "tokenizers")
            data = p.data.tobytes()
            tables = [self.counter.counts(data[a:b]) for a, b in zip(p.starts.tolist(), p.ends.tolist(), strict=True)]
            sums = np.cumsum([0, *(x[-1] for x in tables)])
            widths = [len(data[a:b].decode()) for a, b in zip(p.starts.tolist(), p.ends.tolist(), strict=True)]
            self.parts.append((at, before, part))
            self._tables.append((np.cumsum([0, *widths]), sums, tables))
            cp = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            space = classes("tokenizers")[cp] == _SPACE
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            self._places.append((np.append(0, np.cumsum(width)), space, np.maximum.accumulate(np.where(space, 0, np.arange(1, len(cp) + 1))) if len(cp) else cp))
            at, before = at + len(part), before + int(sums[-1])
        self.total = before

    def count(self, n: int) -> int:
        """Tokens of text[:n]."""
        k = max(i for i, (a, _, _) in enumerate(self.parts) if a <= n or i == 0)
        at, before, part = self.parts[k]
        n -= at
        if n > len(part):  # within a special string, which is ordinary text while it is not whole
            return before + TextPrefixes(part + self.text[at + len(part) : at + n]).total
        bounds, sums, tables = self._tables[k]
        if n <= 0:
            return before
        place, space, start = self._places[k]
        if space[n - 1]:  # white space at the end is one pretoken, and so is each prefix of its run
            a = int(start[n - 1])
            if (k, a) not in self._runs:
                rest = np.flatnonzero(~space[n - 1 :])
                self._runs[k, a] = self.counter.counts(part[a : n - 1 + int(rest[0]) if len(rest) else len(part)].encode())
            i = int(np.searchsorted(bounds, a))
            return before + int(sums[i]) + self._runs[k, a][int(place[n] - place[a])]
        i = int(np.searchsorted(bounds, n)) - 1
        at = int(bounds[i])
        if n < bounds[i + 1] and n - at == 2 and part[at] == "'" and part[at : bounds[i + 1]] in ("'re", "'ve", "'ll"):
            return before + int(sums[i]) + 2  # half a contraction is a mark and a letter
        return before + int(sums[i]) + tables[i][int(place[n] - place[at])]

    def longest(self, budget: int) -> int:
        """The longest prefix, in code points, of at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        for k in reversed(range(len(self.parts))):
            at, before, _ = self.parts[k]
            if before <= budget or k == 0:
                break
        bounds, sums, _ = self._tables[k]
        i = int(np.searchsorted(sums, budget - before, side="right")) - 1
        low = at + int(bounds[max(0, min(i, len(bounds) - 1))])
        high = min(len(self.text), at + int(bounds[min(i + 2, len(bounds) - 1)]) + len(SPECIAL))
        return max((n for n in range(max(0, low - 1), high + 1) if self.count(n) <= budget), default=0)


def token_totals(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row; null and empty texts have 0 of each, repeated rows come repeated.

    Counts are those of the tokenizers library without added special tokens; the special string
    inside a text is one token, as that library's default is. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        parts, owner = [], []
        for i, x in enumerate(texts):
            own = x.split(SPECIAL) if SPECIAL in x else [x]
            parts += own
            owner += [i] * len(own)
        owners = np.array(owner, np.int64)
        totals = np.bincount(owners, counter(name).text_totals(parts), minlength=len(texts)).astype(np.int64) + np.bincount(owners, minlength=len(texts)) - 1
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"])

    return map_text(doc_columns(docs), run, "doc_id long, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """doc_id, text, counts per row: counts[i] (from 0) is the token count of the text's first i code points.

    A null text is kept null and has the counts of an empty one, [0]. Repeated rows come repeated, an empty table
    gives an empty result.
    """
    ship_package(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column(1).to_pylist():
            p = TextPrefixes(x or "", name)
            rows.append([p.count(n) for n in range(len(p.text) + 1)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "text", "counts"])

    return map_text(doc_columns(docs), run, "doc_id long, text string, counts array<int>")


def truncate(prefixes: DataFrame, budget: int) -> DataFrame:
    """doc_id, text cut to its longest prefix of at most ``budget`` tokens, n_tokens of that prefix, from ``prefix_counts`` rows.

    Nothing is encoded again, so stored prefix counts answer any number of budgets. A null text gives a null and 0.
    """
    fits = F.expr(f"array_max(filter(sequence(0, size(counts) - 1), i -> counts[i] <= {int(budget)}))")
    rows = prefixes.withColumn("_n", F.coalesce(fits, F.lit(0)))
    return rows.select("doc_id", F.col("text").substr(F.lit(1), F.col("_n")).alias("text"), F.col("counts")[F.col("_n")].cast("long").alias("n_tokens"))


def op7_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than LIMIT tokens) per row; see ``token_totals`` for nulls, blanks and repeats."""
    return token_totals(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
