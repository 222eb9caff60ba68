"""Pretokens of whole batches: the matches of public_tokenizers.PATTERN, by numpy over code points.

The pattern's alternatives only ask for classes of characters (letter, number, white space, other),
an optional space before a run, white-space runs that leave their last character to what follows,
and the seven contractions; so starts of matches come from where classes change.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from corpusloom.llm.textkernel import exact_keys, key_hash

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Letters and numbers are asked for below this; what is assigned above is neither.
_ASKED = 0x40000


def _by_tiktoken(pattern: str, text: str) -> str:
    """The characters of text that match, by an encoding that has bytes alone and skips what its pattern leaves out."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(text)).decode()


def _by_tokenizers(pattern: str, text: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
    return "".join(x for x, _ in split.pre_tokenize_str(text))


@cache
def classes(library: str = "tiktoken") -> np.ndarray:
    """Classes by code point, as the library's own Unicode tables have them (they differ in version)."""
    matching = {"tiktoken": _by_tiktoken, "tokenizers": _by_tokenizers}[library]
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, _ASKED)]))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        out[np.frombuffer(matching(pattern, text).encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = _SPACE
    return out


class Pretokens:
    """Of texts end to end: byte starts and ends, and the text of each."""

    def __init__(self, texts: list[str], library: str = "tiktoken"):
        whole = "".join(texts)
        self.data = np.frombuffer(whole.encode(), np.uint8)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(cp)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        first = np.zeros(n + 1, bool)  # of a text; one past the last code point counts too
        first[ends - lengths] = True
        first[n] = True
        c = classes(library)[cp]
        start = first.copy()
        start[1:n] |= c[1:] != c[:-1]
        space = c == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n else np.zeros(0, np.int64)
        start[last] = True
        start[last + 1] = cp[last] != 0x20
        self._contractions(cp, first, start)
        at = np.flatnonzero(start[:n])
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        place = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=place[1:])
        self.starts = place[at]
        self.ends = np.append(self.starts[1:], len(self.data)) if len(at) else self.starts
        self.owner = np.searchsorted(ends, at, side="right")
        self.n = len(texts)

    @staticmethod
    def _contractions(cp: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
        n = len(cp)
        at = np.flatnonzero((cp == ord("'")) & start[:n])
        at = at[at + 1 < n]
        at = at[~first[at + 1]]
        follow = cp[at + 1]
        one = np.isin(follow, [ord(x) for x in "stmd"])
        room = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        after = cp[np.minimum(at + 2, n - 1)] if n else cp[:0]
        two = room & np.isin(follow * np.uint32(256) + np.minimum(after, np.uint32(255)), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        for p, size in ((at[one], 2), (at[two & ~one], 3)):
            start[p + 1] = False
            start[np.minimum(p + size, n)] = True

    def keys(self, longer: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        return exact_keys(self.data, self.starts, self.ends, longer)


def keys_of(words: list[bytes], longer: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The exact keys of byte strings, as Pretokens gives them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    return exact_keys(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends, longer)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of start, start + 1, ... for each of the runs, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Seen:
    """Rows of an append-only table by exact key: found by hash, then held against the key."""

    def __init__(self) -> None:
        none = np.zeros(0, np.uint64)
        self.hashes, self.lo, self.hi, self.rows = none, none, none, np.zeros(0, np.int64)
        self.odd: dict[tuple[int, int], int] = {}  # keys whose hash another key has
        self.size = 0

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 for new ones."""
        out = np.full(len(lo), -1, np.int64)
        if len(self.hashes):
            h = key_hash(lo, hi)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = (self.lo[at] == lo) & (self.hi[at] == hi)
            out[hit] = self.rows[at[hit]]
            if self.odd:
                other = np.flatnonzero(~hit & (self.hashes[at] == h))
                out[other] = [self.odd.get(k, -1) for k in zip(lo[other].tolist(), hi[other].tolist(), strict=True)]
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows for new distinct keys, in their order."""
        rows = self.size + np.arange(len(lo))
        self.size += len(lo)
        merged = [np.concatenate(x) for x in ((self.hashes, key_hash(lo, hi)), (self.lo, lo), (self.hi, hi), (self.rows, rows))]
        order = np.argsort(merged[0], kind="stable")
        h, l, u, r = (x[order] for x in merged)
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        self.odd.update(zip(zip(l[again].tolist(), u[again].tolist(), strict=True), r[again].tolist(), strict=True))
        self.hashes, self.lo, self.hi, self.rows = h[~again], l[~again], u[~again], r[~again]
        return rows
