import re

import numpy as np
import pytest
from llm_helpers import prose, table

from corpusloom.llm import blocks, embeddings, importance, quality, toxicity

BAD = "grumble snarl scoff".split()


@pytest.fixture(scope="module")
def corpus(spark):
    """400 documents; every fifth is toxic by a word, every fourth is shouted."""
    rows, marks = [], []
    for i in range(400):
        words = prose(1000 + i, 60).split()
        toxic, poor = i % 5 == 0, i % 4 == 0
        if toxic:
            words[7] = BAD[i % 3]
        text = " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words)
        rows.append((i, text))
        marks.append((i, int(not poor), int(toxic)))
    return table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(corpus):
    found = toxicity.op6_toxicity(*corpus).collect()
    assert len(found) == 400 and all(0 <= x.score <= 1 for x in found)
    held = [x for x in found if x.held_out]
    import zlib

    assert {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(x.doc_id % 5 == 0) == x.predicted for x in held]) > 0.95
    kept = toxicity.drop_toxic(*corpus)
    assert kept.columns == corpus[0].columns and kept.where("doc_id % 5 <> 0").count() > 310


def test_toxicity_of_odd_rows(odd, odd_rows, empty, labels, no_labels):
    assert toxicity.op6_toxicity(odd, labels).count() == len(odd_rows)
    assert {x.predicted for x in toxicity.op6_toxicity(odd, no_labels).collect()} == {0}
    assert toxicity.op6_toxicity(empty, labels).count() == 0


def test_quality_on_held_out_rows(corpus):
    docs, marks = corpus
    found = {x.doc_id: x for x in quality.op1_quality_rules(docs, marks.where("doc_id < 300")).where("doc_id >= 300").collect()}
    assert np.mean([(i % 4 != 0) == x.kept for i, x in found.items()]) > 0.95
    assert all(0 < x.quality < 1 for x in found.values())


def test_quality_of_odd_rows(odd, odd_rows, empty, labels, no_labels):
    found = quality.op1_quality_rules(odd, labels).collect()
    assert sorted(x.n_words for x in found) == sorted(len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for _, t in odd_rows)
    assert all(x.base_failed for x in found if x.n_words < 10) and not any(x.kept and x.base_failed for x in found)
    assert all(x.kept == (not x.base_failed) for x in quality.op1_quality_rules(odd, no_labels).collect())
    assert quality.op1_quality_rules(empty, labels).count() == 0


def test_platt_is_calibrated():
    r = np.random.default_rng(0)
    raw = r.normal(0, 3, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.7 * raw - 0.4)))).astype(float)
    slope, shift = quality.platt(raw, y)
    assert abs(slope - 0.7) < 0.06 and abs(shift + 0.4) < 0.1


def test_importance_resampling(corpus, odd, odd_rows, empty, labels, no_labels):
    docs, marks = corpus
    found = importance.op9_quality_classifier(docs, marks.where("doc_id < 300")).collect()
    k = round(400 * np.mean([i % 4 != 0 for i in range(300)]))
    assert sum(x.kept for x in found) == k
    assert np.mean([(x.doc_id % 4 != 0) == x.kept for x in found]) > 0.95
    assert importance.op9_quality_classifier(odd, labels).count() == len(odd_rows)
    assert all(x.log_weight == 0 for x in importance.op9_quality_classifier(odd, no_labels).collect())
    assert importance.op9_quality_classifier(empty, labels).count() == 0


@pytest.mark.parametrize("k", [1, 2, 5, 9, 12, 13])
def test_kth_largest(spark, k):
    values = [3, -7, 2**62, -(2**63), 0, 3, 65536, 65537, -1, 2**48, 12, 3]
    want = sorted(values, reverse=True)[k - 1] if k <= len(values) else None
    assert importance.kth_largest(spark.createDataFrame([(v,) for v in values], "key long"), k) == want


def brute(rows):
    n = len(rows)
    good = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2] or []) for r in rows]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if good[a] and good[b] and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((rows[i][0], links[i], rows[find(i)][0]) for i in range(n))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<float>, bucket string, n double")


@pytest.mark.parametrize("block", [256, 8])
def test_embeddings_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(blocks, "CROWD", block * 2)
    monkeypatch.setattr(blocks, "DENSE", block // 32)
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    rows = [(i, int(i % 3), (centres[i % 12] + r.normal(size=16) * r.choice([0.02, 0.25, 0.35])).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300 + i, 1, rows[1][2]) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, rows[0][2]), (401, 1, None), (402, 1, [0.0] * 16), (403, 1, [nan] + [1.0] * 15), (404, 1, [inf] + [1.0] * 15), (405, 1, [None] + [1.0] * 15), (406, 1, []), (407, 1, [1.0, 2.0]), (408, 1, [2.0, 4.0]), (409, 0, [-0.0] * 15 + [1.0]), (410, 0, [0.0] * 15 + [1.0])]
    rows += [(500 + i, 2, (centres[3] + r.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(150)]  # a crowd of near copies
    found = embeddings.op10_embedding_dedup(vectors(spark, rows)).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in found) == brute(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in found)


def test_vectors_without_id(spark):
    x = [1.0, 0.0, 0.0, 0.0]
    near, far = [1.0, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(None, 1, x), (4, 1, near), (6, 1, [1.0, -0.25, 0.0, 0.0]), (None, 1, far), (None, 1, far), (None, 1, None)]
    found = embeddings.op10_embedding_dedup(vectors(spark, rows)).collect()
    key = lambda x: (x.vec_id or 0, x.n_links, x.component_id or 0, x.kept)
    assert sorted(map(key, found), key=str) == sorted([(0, 2, 4, None), (4, 2, 4, True), (6, 2, 4, False), (0, 1, 0, None), (0, 1, 0, None), (0, 0, 0, None)], key=str)


def test_embeddings_empty_and_recall(spark):
    assert embeddings.op10_embedding_dedup(vectors(spark, [])).count() == 0
    for points in (1, 100, 10**4, 10**6, 10**9):
        bits, tables = embeddings.plan_for(points)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= embeddings.MISS * 1.001
