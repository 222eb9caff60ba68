"""Equality is that of texts, not of hashes: Thue-Morse words, whose polynomial hashes modulo 2**64 are equal for any base, and forced collisions."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_helpers import prose, table
from tokenizers import Tokenizer

from corpusloom.llm import bpe, pretokens, quality, suffixes, textkernel, tokencounts

library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def twins(n: int) -> list[str]:
    return [thue_morse(n, *pair) for a, b in ("qu", "in", "th") for pair in ((a, b), (b, a))]


def multi():
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_twins_have_equal_polynomial_hashes():
    data = [x.encode() for x in twins(1024)[:2]]
    t = textkernel.Texts(data)
    assert len(set(t.hashes(*t.words()[:2]).tolist())) == 1


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_twins_are_told_apart(spark, n):
    texts = twins(n)
    rows = list(enumerate(texts))
    for x in bpe.op4_bpe_roundtrip(table(spark, rows)).collect():
        ids = multi().encode_ordinary(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[x.doc_id].encode()).hexdigest())
    counted = {x.doc_id: x.n_tokens for x in tokencounts.op7_token_counts(table(spark, rows)).collect()}
    assert counted == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    lines = quality.base_counts(["\n".join(texts).encode(), "\n".join(texts[:2] + texts[:1]).encode()])
    assert lines["n_dup_lines"].tolist() == [0, 1]
    a, b = prose(1, 24), prose(2, 26)
    windows = quality.base_counts([f"x y {texts[0]} z v x y {texts[1]} z v".encode(), f"x y {texts[0]} z v x y {texts[0]} z v".encode()])
    assert windows["n_repeat_words"].tolist() == [0, 10]
    passages = [(1, f"{a} {texts[0]} {b}"), (2, f"{a} {texts[1]} {b}"), (3, f"own {a} {texts[1]} {b}")]
    assert {x.doc_id: x.n_repeated for x in suffixes.op3_suffix_array_dedup(table(spark, passages)).collect()} == {1: 0, 2: 0, 3: 51}


@pytest.mark.parametrize("places", [1, 3])
def test_forced_collisions_change_nothing(monkeypatch, places):
    poor = lambda lo, hi: (lo ^ hi) % np.uint64(places)
    for module in (textkernel, pretokens, quality):
        monkeypatch.setattr(module, "key_hash", poor)
    texts = [prose(5, 200), "na na na na na na na na", "a b c d e a b c d e", "é日本 \U0001f600 x" * 20, ""]
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    encoder = bpe.Encoder(v)
    for _ in range(2):
        for ids, counts in encoder([texts, texts[::-1]]):
            assert sorted(map(tuple, np.split(ids, np.cumsum(counts)[:-1])), key=len)[-1] == tuple(max((multi().encode_ordinary(t) for t in texts), key=len))
    counter = tokencounts.PrefixCounter()
    assert counter.text_totals(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(quality, "mix", lambda h: h % np.uint64(2))
    assert quality.base_counts([t.encode() for t in texts])["n_repeat_words"].tolist()[1:3] == [8, 10]


def test_caches_that_forget(monkeypatch):
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    encoder, counter = bpe.Encoder(v), tokencounts.PrefixCounter()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokencounts, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokencounts, "CACHE_PAIRS", 7)
    words = [b" harbor12", b"q" * 40, b" lattice7"]
    ids = [multi().encode_ordinary(w.decode()) for w in words]
    sizes = lambda xs: np.array([len(x) for x in xs])
    encoder.hold(("one", (np.frombuffer(b"".join(words), np.uint8), sizes(words), np.concatenate(ids).astype(np.uint32), sizes(ids))))
    for seed in range(4):
        texts = [prose(seed, 80), "q" * 40, prose(seed + 1, 3)]
        ((got, counts),) = encoder([texts])
        assert [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])] == [multi().encode_ordinary(t) for t in texts]
        assert counter.text_totals(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
