import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from llm_helpers import prose, table
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import linededup, neardup, quality, simhash, suffixes
from corpusloom.llm.common import Scratch
from corpusloom.llm.graph import connected_components

SPACE = r"[\x20\x09-\x0D]"


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = [w for w in re.split(SPACE + "+", (text or "").encode().lower().decode()) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_components_against_union_find(spark):
    r = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(500, i) for i in range(501, 560)]
    pairs = [*{tuple(sorted(map(int, p))) for p in r.integers(0, 150, (90, 2)) if p[0] != p[1]}, *chain, *star]
    found = {x.node: x.component for x in connected_components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(600, pairs)
    assert found == {i: want[i] for p in pairs for i in p}


def test_components_without_edges(spark):
    assert connected_components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_brute_force(spark, odd, odd_rows):
    rows = [(x.doc_id, x.fingerprint, x.component_id) for x in simhash.op2_simhash_dedup(odd).collect()]
    assert len(rows) == len(odd_rows)
    prints = [fingerprint(t) for _, t in odd_rows]
    assert sorted(f for _, f, _ in rows) == sorted(f"{p:016x}" for p in prints)
    n = len(prints)
    root = union(n, [(a, b) for a in range(n) for b in range(n) if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    want = {i: min(odd_rows[k][0] for k in range(n) if root[k] == root[j] and odd_rows[k][0] is not None) for j, (i, _) in enumerate(odd_rows) if i is not None}
    assert {i: c for i, _, c in rows if i is not None} == want


@pytest.mark.parametrize("hot", [2, 64])
def test_simhash_crowded_blocks_lose_no_link(spark, hot):
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 6)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in r.choice(30, k, replace=False)) for c in centre for k in (0, 1, 1, 2, 2, 3) for _ in range(8)})
    points = spark.createDataFrame([(f if f < 2**63 else f - 2**64, i) for i, f in enumerate(fps)], "fp long, rep long")
    scratch = Scratch(spark)
    found = {x.node: x.component for x in connected_components(scratch, simhash.close_pairs(scratch, points, hot=hot)).collect()}
    root = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert [found.get(i, i) for i in range(len(fps))] == root


def test_simhash_keep(odd, empty):
    kept = simhash.simhash_keep(odd)
    assert kept.columns == odd.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)[:1] == [1]
    assert 2 not in {x.doc_id for x in kept.collect()}
    assert simhash.op2_simhash_dedup(empty).count() == 0 and simhash.simhash_keep(empty).count() == 0


def brute_lines(rows, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    seen = collections.defaultdict(set)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                seen[k].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(seen[key(x)]) >= docs and max(seen[key(x)]) != (-(1 << 63) if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows(odd_rows):
    often = "The Same Licence Line that many documents carry é"
    return odd_rows + [(100 + i, f"own {i}\n  {often.upper() if i % 2 else often}\t\nend" + ("\n" + often) * (i % 3)) for i in range(9)] + [(None, often)]


@pytest.mark.parametrize("most", [linededup.PASS_BYTES, 1])
def test_lines_against_brute_force(spark, odd_rows, most, monkeypatch):
    if most == 1:
        monkeypatch.setattr(linededup, "SHARD_KEYS", 1)  # many shards, each a pass
    rows = line_rows(odd_rows) + [(200 + i, "\n".join(f"{j} repeated line number {j} with enough characters" for j in range(i, 12))) for i in range(8)]
    often = "a line that stands in several rows of one document alone"  # four rows and one: two documents, so it stays
    rows += [(900, often)] * 4 + [(901, f"{often}\nand more")] + [(902, rows[-1][1]), (902, rows[-2][1])]
    found = linededup.drop_lines(table(spark, rows).select("doc_id", "text"), pass_bytes=most)
    got = sorted(((x.row.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.text.encode()).hexdigest()) for x in found.collect()), key=str)
    assert got == brute_lines(rows)


def test_line_dedup_keeps_columns(spark, odd, odd_rows, empty):
    kept = linededup.line_dedup(table(spark, line_rows(odd_rows)))
    assert kept.columns == odd.columns
    assert all(x.n_chars == len(x.text) if x.text is not None else x.n_chars is None for x in kept.collect())
    assert kept.where("text is null").count() == odd.where("text is null").count()
    assert linededup.op8_line_dedup(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_a_bijection(keys):
    k = np.array(sorted(keys), np.uint64)
    assert sorted(linededup.PerfectHash.build(k)(k).tolist()) == list(range(len(k)))


def brute_spans(rows, least):
    words = {i: [w for w in re.split(SPACE + "+", t or "") if w] for i, t in rows if i is not None}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - least + 1):
            first.setdefault(tuple(words[i][s : s + least]), i)
    out = {}
    for i, w in words.items():
        marks = np.zeros(len(w), bool)
        for s in range(len(w) - least + 1):
            if first[tuple(w[s : s + least])] < i:
                marks[s : s + least] = True
        out[i] = marks.tolist()
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_suffixes_against_brute_force(spark, odd_rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "AT_ONCE", 8)
    passage = prose(50, 55)
    rows = odd_rows + [(300 + i, f"{prose(60 + i, 5 * i)} {passage} {prose(90 + i, 7)}") for i in range(12)] + [(400 + i, prose(61, 52 + i)) for i in range(4)]
    info, found = suffixes.repeated_spans(table(spark, rows))
    want = brute_spans(rows, 50)
    got = {i: [False] * len(m) for i, m in want.items()}
    for x in found.collect():
        for s in x.spans:
            got[x.doc_id][s.start : s.end] = [True] * (s.end - s.start)
    assert got == want
    assert info.count() == len(rows)
    result = {x.doc_id: x for x in suffixes.op3_suffix_array_dedup(table(spark, rows)).collect()}
    assert all(result[i].repeated == any(m) and result[i].n_repeated == sum(m) for i, m in want.items())
    assert result[311].first_docs == [300] and result[2].first_docs == [1] and result[2].copy_of == 1 and result[300].first_docs == []


def test_passages_of_any_surroundings(spark):
    """Parts of a few long texts in many documents: matches of all lengths, with other documents' words left and right."""
    r = random.Random(11)
    long = [prose(800 + k, 400).split() for k in range(3)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randint(1, 4)):
            own, a = r.choice(long), r.randint(0, 340)
            words += own[a : a + r.randint(10, 120)] + prose(10_000 + i, r.randint(0, 12)).split()
        rows.append((i // 2, " ".join(words)))  # two rows a doc_id
    found = suffixes.op3_suffix_array_dedup(table(spark, rows)).collect()
    assert len(found) == len(rows)
    first: dict = {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 49):
            first[tuple(w[s : s + 50])] = min(i, first.get(tuple(w[s : s + 50]), i))
    want = []
    for i, t in rows:
        w, marks, firsts = t.split(), set(), set()
        for s in range(len(w) - 49):
            if (k := first[tuple(w[s : s + 50])]) < i:
                marks |= set(range(s, s + 50))
                firsts.add(k)
        want.append((i, len(w), sorted(marks), sorted(firsts)))
    got = [(x.doc_id, x.n_words, sorted({k for s in x.spans for k in range(s.start, s.end)}), sorted(x.first_docs)) for x in found]
    assert sorted(got) == sorted(want)


def test_passages_in_long_texts(spark):
    """More text than one numpy pass takes: lists of places come in parts of a batch."""
    passage = prose(77, 60)
    rows = [(i, f"{prose(2000 + i, 3000)} {passage} {prose(3000 + i, 1000)} {prose(5000 + i // 2, 70)}") for i in range(60)]
    found = {x.doc_id: x.n_repeated for x in suffixes.op3_suffix_array_dedup(table(spark, rows).coalesce(1)).collect()}
    assert found == {i: sum(marks) for i, marks in brute_spans(rows, 50).items()}  # a word before or after a passage may agree by chance
    assert all(n >= 60 * (i > 0) + 70 * (i % 2) for i, n in found.items())


def test_rows_of_one_doc_id_lose_no_text(spark):
    p, u, v = prose(31, 80), prose(32, 80), prose(33, 80)
    rows = [(1, p), (7, p), (7, u), (7, u), (9, v), (9, None)]
    found = sorted((x.doc_id, x.n_repeated) for x in suffixes.op3_suffix_array_dedup(table(spark, rows)).collect())
    assert found == [(1, 0), (7, 0), (7, 0), (7, 80), (9, 0), (9, 0)]
    assert sorted((x.doc_id, x.text or "") for x in suffixes.suffix_dedup(table(spark, rows)).collect()) == sorted((i, t or "") for i, t in [(1, p), (7, u), (7, u), (9, v), (9, None)])
    a, b = prose(41, 60), prose(42, 60)
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (None, a)]
    for keep in (simhash.simhash_keep, neardup.near_keep):
        assert sorted((x.doc_id or 0, x.text) for x in keep(table(spark, rows)).collect()) == sorted([(0, a), (3, a), (5, b)])
    same = sorted((x.doc_id or 0, x.component_id) for x in simhash.op2_simhash_dedup(table(spark, rows)).collect())
    assert same == [(0, 3), (3, 3), (5, 3), (5, 5), (9, 5), (9, 5)]


def test_suffix_dedup_cuts_repeats_alone(spark, odd, empty):
    passage, own = prose(50, 60), prose(70, 10)
    rows = [(1, f"{own}\n{passage}"), (2, f"begin\n{passage}  end of it"), (3, passage), (4, own), (5, None), (6, ""), (None, passage)]
    kept = {x.doc_id: x.text for x in suffixes.suffix_dedup(table(spark, rows)).collect() if x.doc_id is not None}
    assert kept == {1: f"{own}\n{passage}", 2: "begin\nend of it", 4: own, 5: None, 6: ""}
    assert suffixes.suffix_dedup(odd).columns == odd.columns
    assert suffixes.op3_suffix_array_dedup(empty).count() == 0 and suffixes.suffix_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t#|é x"), max_size=80), max_size=6))
def test_base_counts_against_brute_force(texts):
    found = quality.base_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        w = [x for x in re.split(SPACE + "+", t) if x]
        windows = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeat = {k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if re.sub(SPACE, "", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
