import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_helpers import prose, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing, tokencounts

ALPHABET = st.text(st.sampled_from("ab '\"sdmtlreRLV!?.\n\t  0129é日 　²\x85<|_"), max_size=60) | st.text(max_size=40)
library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoding():
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=8))
def test_replay_equals_the_library(texts):
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    ((ids, counts),) = bpe.Encoder(v)([texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoding().encode_ordinary(t) for t in texts]
    assert bpe.decode_ids(v, ids).tobytes() == "".join(texts).encode()


def test_replay_where_a_merge_opens_a_lower_rank():
    # ab is made late, yet ab with a following a makes an earlier token: the order of merges within a word matters
    class Toy(bpe.Vocabulary):
        def __init__(self):
            self.ranks = {b"a": 0, b"b": 1, b"aba": 2, b"ab": 3, b"bb": 4}
            self.tokens = [b"a", b"b", b"aba", b"ab", b"bb"]
            self.single = np.zeros(256, np.int64)
            self.single[[97, 98]] = [0, 1]
            pairs = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
            self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    toy = Toy()
    for word in (b"abababab", b"abbaabab", b"babababb", b"aabbabab"):
        ids, _ = bpe.replay(toy, np.frombuffer(word, np.uint8), np.array([len(word)]))
        assert ids.tolist() == toy.encode_alone(word)


def test_bpe_round_trip_of_odd_rows(odd, odd_rows, empty):
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.op4_bpe_roundtrip(odd).collect()), key=str)
    want = []
    for i, t in odd_rows:
        ids = encoding().encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.bpe_decode(bpe.bpe_encode(odd)).collect()
    assert sorted(bytes(x.data) for x in back) == sorted((t or "").encode() for _, t in odd_rows)
    assert bpe.op4_bpe_roundtrip(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(ALPHABET)
def test_every_prefix_is_counted_as_the_library_does(text):
    p = tokencounts.TextPrefixes(text)
    want = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    assert [p.count(n) for n in range(len(text) + 1)] == want
    for budget in (0, 1, 3, 8):
        assert p.longest(budget) == max(n for n, c in enumerate(want) if c <= budget)


def test_token_counts_of_odd_rows(odd, odd_rows, empty):
    got = sorted(((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in tokencounts.op7_token_counts(odd).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in odd_rows]
    assert got == sorted(want, key=str)
    assert tokencounts.op7_token_counts(empty).count() == 0


def test_truncation_from_stored_prefixes(odd, odd_rows, empty):
    short = odd.where("doc_id is null or doc_id <> 9")
    prefixes = tokencounts.prefix_counts(short)
    texts = sorted((t or "" for i, t in odd_rows if i != 9))
    count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    tables = sorted(((x.text or "", x.counts) for x in prefixes.collect()), key=lambda x: x[0])
    assert [t for t, _ in tables] == texts
    for t, own in tables:
        if len(t) < 300:
            assert own == [count(t[:n]) for n in range(len(t) + 1)]
    for budget in (0, 6, 40):
        found = sorted((x.text or "", x.n_tokens) for x in tokencounts.truncate(prefixes, budget).collect())
        want = sorted((t[:n], own[n]) for t, own in tables for n in [max(k for k, c in enumerate(own) if c <= budget)])
        assert found == want
    assert tokencounts.prefix_counts(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
def test_histogram_packing_places_all_within_capacity(sizes):
    placed = dict.fromkeys(sizes, 0)
    bins = packing.pack_histogram(sizes, 60)
    for b in bins:
        assert b.count > 0 and sum(s * n for s, n in b.items) <= 60
        assert sum(n for s, n in b.items if 3 * s > 60) <= 2
        for s, n in b.items:
            placed[s] += n * b.count
    assert placed == sizes
    lower = max(-(-sum(s * n for s, n in sizes.items()) // 60), sum(n for s, n in sizes.items() if s > 30))
    assert sum(b.count for b in bins) <= lower * 1.5 + 2


def test_packing_of_odd_rows(spark, odd_rows, empty):
    rows = odd_rows + [(500 + i, prose(i, 17 * i)) for i in range(60)]
    found = packing.pack(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        starts = [0, *range(head, len(ids), 2048)] if len(ids) > 2048 else [0]
        ends = [*starts[1:], len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in found), key=str) == sorted(want, key=str)
    by: dict = {}
    for x in found:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.op5_bestfit_packing(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_cut(n):
    parts = packing.cut(n, 2048)
    assert sum(x for _, x in parts) == n and [a for a, _ in parts] == [0, *np.cumsum([x for _, x in parts])[:-1].tolist()]
    assert all(x == 2048 for _, x in parts[1:]) and 0 < parts[0][1] <= 2048


def test_prefix_counts_of_long_runs_grow_in_proportion():
    import time

    from tokenizers import Tokenizer

    from corpusloom.llm.tokencounts import TextPrefixes

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 50 + "a  b\u3000\u3000 \n\n\t\t x  ", "don't we're 'll  <|endoftext|>   z\n", "\xe9  \u65e5\u672c \U0001f600  "):
        p = TextPrefixes(text)
        assert [p.count(n) for n in range(len(text) + 1)] == [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    for text in (" " * 100_000, "\n" * 50_000 + "x", "=" * 100_000):
        began = time.process_time()
        p = TextPrefixes(text)
        counts = [p.count(n) for n in range(0, len(text) + 1)]
        assert counts[0] == 0 and counts[-1] == p.total and time.process_time() - began < 20
