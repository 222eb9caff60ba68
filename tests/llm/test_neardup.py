"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import prose, table

from corpusloom.llm import blocks, neardup


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((least[a], least[b]))
            least = {i: low if c == high else c for i, c in least.items()}
    return least


def edited(text, r, edits):
    words = text.split()
    for at in r.sample(range(len(words)), edits):
        words[at] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def planted():
    r, rows = random.Random(5), []
    for i in range(30):
        base = prose(1000 + i, 200 + 10 * i)
        rows += [(len(rows), base), (len(rows) + 1, edited(base, r, 1 + i // 6)), (len(rows) + 2, edited(base, r, 12))]
    base = prose(5000, 60)  # a crowd: close to the base, further from one another
    rows += [(len(rows) + k, edited(base, r, 1)) for k in range(40)] + [(500, base)]
    rows += [(600 + k, f"{prose(6000, 60)} {prose(6001 + k, 200)}") for k in range(30)]  # one passage in common, else clean
    return [*rows, (700, None), (701, ""), (702, "two words"), (703, "Two  words")]


def test_near_components_equal_brute_force(spark, planted):
    found = {x.doc_id: x.component_id for x in neardup.near_components(table(spark, planted)).collect()}
    assert found == brute(planted)


def test_pipeline_stage_keeps_one_of_each_group(spark, planted):
    """With op2's setting, two bits of 64, nearly all planted near copies stayed."""
    docs, stage = table(spark, [*planted, (None, planted[0][1])]), corpus_pipeline.STAGES[2][1]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute(planted).values())) and ids.count(None) == 1


@pytest.mark.parametrize("dense", [0, 10**9])
def test_crowded_buckets_lose_no_link(spark, planted, dense, monkeypatch):
    monkeypatch.setattr(blocks, "CROWD", 8)
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    found = {x.doc_id: x.component_id for x in neardup.near_components(table(spark, planted)).collect()}
    assert found == brute(planted)


def test_pairs_at_the_threshold_share_a_block():
    """The stated chances, and a measurement: sets of similarity 0.8 differ in no more bits than ``apart`` says, also small ones."""
    for docs in (1, 10**5, 10**7, 10**10):
        bits, tables = neardup.plan_for(docs)
        assert (1 - (1 - neardup.apart(0.8)) ** bits) ** tables <= neardup.MISS * 1.001
    for n in (128, 1280, 40_000):
        k, p = blocks.binomial_bound(n, 0.15, 1e-6), 0.15
        mean, deviation = n * p, (n * p * (1 - p)) ** 0.5
        assert mean + 4 * deviation < k < mean + 6 * deviation
    r = np.random.default_rng(5)
    for n in (9, 45, 450):
        share = []
        for _ in range(60):
            h = r.integers(0, 2**64, n + n // 9, dtype=np.uint64)
            a, b = h[: n], h[n // 9 :]
            x, y = (np.frombuffer(neardup.long_fingerprint(s, 20), np.uint8) for s in (a, b))
            share.append(np.unpackbits(x ^ y).mean())
        assert np.mean(share) <= neardup.apart(0.8) + 0.01


def test_empty(empty):
    assert neardup.near_components(empty).count() == 0 and neardup.near_keep(empty).count() == 0
