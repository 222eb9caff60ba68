"""Whole batches of texts as numpy arrays: words, exact keys of words, hashes of words and of runs of words.

Hashes are polynomials modulo 2**64 over bytes, so that the hash of any span comes from two entries
of a running sum, finished by a 64-bit mixer. Different texts can have equal hashes (Thue-Morse words do
for every base), so hashes choose places of features and minimisers and order candidates; whether two byte
strings are equal is told by ``exact_keys``, by 128-bit digests or by comparing the words.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part the words of a classifier: ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers, and those of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverses", _BASE_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Running polynomial sum of uint64 values, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], from running(values)."""
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """Texts end to end with a space after each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(self.lengths + 1, out=self.starts[1:])
        self.n = len(texts)

    def words(self, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts (as positions) of the words between parting bytes."""
        gap = np.ones(len(self.data) + 2, bool)
        gap[1:-1] = parting[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(self.starts, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans(running(self.data.astype(np.uint64) + np.uint64(1)), starts, ends)


#: The bytes of a key's first half that k bytes fill.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_KEPT = 15


def exact_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longer: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Two uint64 for each of the byte strings data[start:end], equal exactly if the strings are.

    Up to 15 bytes they are the bytes and their number; longer strings get numbers from ``longer``, which grows.
    """
    n = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    lo = eight[starts] & _FILLED[np.minimum(n, 8)]
    hi = eight[np.minimum(starts + 8, len(data) + 8)] & _FILLED[np.clip(n - 8, 0, 7)]
    hi |= np.minimum(n, 255).astype(np.uint64) << np.uint64(56)
    big = np.flatnonzero(n > _KEPT)
    if len(big):
        raw = data.tobytes()
        lo[big] = [longer.setdefault(raw[a:b], len(longer)) for a, b in zip(starts[big].tolist(), ends[big].tolist(), strict=True)]
        hi[big] = np.uint64(255 << 56)
    return lo, hi


def key_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix(lo ^ mix(hi + np.uint64(0xD6E8FEB86659FD93)))


def distinct(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of exact keys: where each distinct one is first found, and which of these each one is."""
    _, first, inverse = np.unique(key_hash(lo, hi), return_index=True, return_inverse=True)
    if ((lo[first][inverse] != lo) | (hi[first][inverse] != hi)).any():  # two keys of one hash
        _, first, inverse = np.unique(np.stack([lo, hi], 1), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()
