"""Collocations, nearest neighbours and token alignment against plain Python and, for queries, against their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from llm_helpers import SCHEMA, prose, table

from corpusloom.llm import alignment, collocations, nearest, registry


@pytest.mark.parametrize("name", ["op11_collocations", "op12_nearest_neighbours"])
def test_query_equals_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = registry.QUERIES[name](spark, data)
    want = c.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want.fetchall())


# --- collocations


def plain_collocations(rows, least, longest=4, share=80, first=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    covered = defaultdict(int)
    for (lang, w), v in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                covered[lang, w[i : i + size]] = max(covered[lang, w[i : i + size]], v)
    scored = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * covered[lang, w] >= share * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        scored[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, w.decode(), -a, left, right, n[lang], -score) for lang, own in scored.items() for i, (score, a, w, left, right) in enumerate(sorted(own)[:first], 1))


def collocated(df, **parameters):
    return sorted(map(tuple, collocations.collocations(df, **parameters).collect()))


def phrases(seed, n):
    r = random.Random(seed)
    words = "red Green blue, stone river. tree sky house! night day cloud\t wind sea\n moon sun".split(" ")
    return [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.randint(0, 400)))) for _ in range(n)]


def by_lang(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, "x", 8, "y", 0.5) for i, (lang, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("positions", [collocations.POSITIONS, 300])
def test_collocations_equal_plain_counting(spark, monkeypatch, positions):
    monkeypatch.setattr(collocations, "_TEXT", positions * 6)  # the small one makes many shards
    monkeypatch.setattr(collocations, "JOINED", 1 << 12)
    rows = phrases(3, 120)
    assert collocated(by_lang(spark, rows), least=5) == plain_collocations(rows, 5)
    assert collocated(by_lang(spark, rows), least=30, first=7) == plain_collocations(rows, 30, first=7)


def test_a_full_filter_changes_nothing(spark):
    rows = phrases(4, 60)
    assert collocated(by_lang(spark, rows), least=5, bits=1 << 15) == plain_collocations(rows, 5)


def test_collocations_of_odd_rows(odd, odd_rows, empty, spark):
    assert collocated(odd, least=2) == plain_collocations([("en", t) for _, t in odd_rows], 2)
    assert collocated(empty) == []
    assert collocated(table(spark, [(1, None), (2, "")])) == []
    edges = [("en", x) for x in ("a b\x0bc d", "a b\x0cc d", "a b\rc d", "a b\x1cc d", "É b É b", "a  b a\tb", "." * 50, "aa aa aa aa aa aa aa")] * 3
    assert collocated(by_lang(spark, edges), least=2) == plain_collocations(edges, 2)
    long = [("en", "na " * 40_000 + prose(5, 20_000)), ("en", "x " * 63 + "y z " * 70)]
    assert collocated(by_lang(spark, long), least=30) == plain_collocations(long, 30)


def test_shifted_bitmaps_cross_blocks():
    position = np.array([0, 62, 63, 64, 127, 128])
    bitmaps = collocations.Bitmaps.of(np.zeros(6, np.int64), position)
    moved = bitmaps.shifted()
    found = [int(b) * 8 + i for b, bits in zip(moved.block, moved.bits.tolist(), strict=True) for i in range(8) if bits >> i & 1]
    assert sorted(found) == [1, 63, 64, 65, 128, 129]


def test_pairs_are_frequent_by_their_cells(monkeypatch):
    cells = np.array([5, 5, 1 << 20, (1 << 32) - 1, 70_000, 5], np.int64)
    rows = collocations._packed(cells, np.array([1, 2, 300, 7, 1, 4]))
    got = {}
    for part, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        planes = np.frombuffer(raw, np.uint8).reshape(4, -1).astype(int)
        got |= dict(zip(((part << 20) + np.cumsum(planes[0] + 256 * planes[1] + 65536 * planes[2])).tolist(), planes[3].tolist(), strict=True))
    assert got == {5: 7, 70_000: 1, 1 << 20: 255, (1 << 32) - 1: 7}


def test_scores_beyond_64_bits(spark):
    a, lr = 9_000_000_000_000_000, 2 * 9_000_000_000_000_001
    got = spark.sql(f"SELECT CAST({a}L AS DECIMAL(20, 0)) * 2000000 div (CAST({lr // 2}L AS DECIMAL(20, 0)) + {lr // 2}L)").first()[0]
    assert got == 2_000_000 * a // lr


# --- nearest neighbours

VECTORS = "vec_id long, embedding array<{}>, label int, id long, node long, score double, rank int"


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 5, 6, 0.5, 7) for i, v in rows], VECTORS.format(kind))


def plain_nearest(rows, k=10, asked=100, kind=np.float32):
    ok = {(i, np.array(v, kind).tobytes()) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    held = [(i, (np.frombuffer(v, kind) + kind(0)).astype(float)) for i, v in ok]
    out = set()
    for q, x in held:
        if q % asked:
            continue
        near = sorted({(float(np.sqrt(np.cumsum((x - y) ** 2)[-1])), i) for i, y in held if i != q and len(y) == len(x)})
        out |= {(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)}
    return out


def found_nearest(df, **parameters):
    return {tuple(r) for r in nearest.nearest(df, **parameters).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "TILE", 64)
    monkeypatch.setattr(nearest, "PAIRS", 500)
    r = np.random.default_rng(5)
    x = r.standard_normal((1200, 24)) * r.choice([0.01, 1, 50], 1200)[:, None]
    x[300:700] = x[200]  # a third are copies
    x[700:720] = x[5] + 1e-9
    rows = [(i, v.astype(np.float32 if kind == "float" else float).tolist()) for i, v in enumerate(x)]
    r.shuffle(rows)
    df = vectors_of(spark, [(int(i), v) for i, v in rows], kind).repartition(5)
    want = plain_nearest([(int(i), v) for i, v in rows], kind=np.float32 if kind == "float" else np.float64)
    assert found_nearest(df) == want
    assert found_nearest(df, queries=3, candidates=100) == want


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [1.0, float("nan")]), (600, [1.0, float("inf")]), (1, [0.5, -0.0]), (2, [0.5, 0.0]),
            (3, [1.0, 2.0, 3.0]), (700, [1.0, 2.0, 4.0]), (None, [1.0, 0.0]), (800, []), (4, [1e38, 1e38]), (5, [1e-44, 0.0]), (6, [0.0, 7.0])]
    got = found_nearest(vectors_of(spark, rows))
    assert got == plain_nearest(rows)
    assert {(q, v) for q, r, v, _ in got if r == 1} == {(0, 100), (100, 0), (700, 3)}
    assert found_nearest(vectors_of(spark, [])) == set()
    assert found_nearest(vectors_of(spark, [(100, [1.0])])) == set()
    wide = [(1e200, 1e-200), (-1e200, 1e-200), (1e-310, 1e-310)]
    assert {x[:3] for x in found_nearest(vectors_of(spark, [(i * 100, list(v)) for i, v in enumerate(wide)], "double"))} == {(0, 1, 100), (0, 2, 200), (100, 1, 0), (100, 2, 200), (200, 1, 0), (200, 2, 100)}  # all infinite


def test_most_pairs_are_settled_by_their_rounded_forms():
    r = np.random.default_rng(6)
    x = r.standard_normal((3000, 64))
    heaps = nearest.Heaps(x[:50], 11)
    for i in range(0, 3000, 500):
        heaps.take(x[i : i + 500], np.arange(i, i + 500), np.arange(i, i + 500))
    assert heaps.recomputed < 50 * 3000 / 20
    want = np.sort(np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, :11]
    assert np.allclose(heaps.d, want)


def test_products_are_exact_beyond_one_width():
    r = np.random.default_rng(7)
    a, b = (r.choice(np.array([-127, 127], np.int8), (4, 5000)) for _ in range(2))
    assert (nearest.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


# --- alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def _byte_level():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(libraries, rows):
    """rows: (doc_id, text), by the two libraries, one token at a time."""
    a, b = libraries
    table_ = _byte_level()
    each = []
    for i, text in rows:
        groups, whole = [], (" " + (text or "")).encode()
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xa = [bytes(table_[c] for c in a.id_to_token(t)) for t in ia]
            xb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ib]
            if b"".join(xa) == whole == b"".join(xb):
                ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
                p = q = 0
                for end in sorted(set(ea) & set(eb)):
                    u, v = ea.index(end) + 1, eb.index(end) + 1
                    groups.append((ia[p:u], ib[q:v]))
                    p, q = u, v
        each.append((i, groups))
    docs = Counter()
    for _, groups in each:
        docs.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in each:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = ["", " ", "  ", "a ", "a  \n b\n", " \t x\x0b\x0cy \r\n", "a\r\nb {\r\n c", "x\xa0 y　z", "▁a b", "<s> </s><|endoftext|> é日本語 テスト", "\x1c\x1d a\x1e b", "\n\n\nfoo", "don't  we'll 'S", "\U0001f937‍ ok", "\x00a b", "12345 678,90", "<0x41> <unk>", "A" * 300, "́́ ﬁ"]


def aligned_rows(df, **parameters):
    return sorted(map(tuple, alignment.align(df, **parameters).collect()), key=str)


@pytest.mark.parametrize("held", [alignment.HELD, 50, 0])
def test_alignment_equals_the_libraries(spark, libraries, odd_rows, held):
    rows = [(i, t if t is None else t[:4000]) for i, t in odd_rows] + [(100 + i, x) for i, x in enumerate(ODD)]
    assert aligned_rows(table(spark, rows), held=held) == plain_alignment(libraries, rows)


def test_alignment_of_tables(spark, data, libraries):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000")
    assert aligned_rows(docs) == plain_alignment(libraries, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_alignment_of_empty_tables(empty, spark):
    assert aligned_rows(empty) == []
    assert aligned_rows(table(spark, [(1, None), (None, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_large_groups_are_paired_by_distinct_ids(monkeypatch):
    r = np.random.default_rng(8)
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 50)
    na, nb, owner = np.array([20, 30, 10]), np.array([30, 15, 5]), np.array([0, 0, 1])
    want = alignment.linked_pairs(a, b, na, nb, owner, 100)
    monkeypatch.setattr(alignment, "LARGE", 100)
    for x, y in zip(want, alignment.linked_pairs(a, b, na, nb, owner, 100), strict=True):
        assert (x == y).all()


def test_very_long_texts(spark, libraries):
    a = alignment.aligner(alignment.TOKENIZER, alignment.PIECES)
    text = prose(11, 150_000) + "\n\n" + " " * 300
    ids_a, ids_b, n_a, n_b = a.encode([text])
    assert ids_a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert ids_b.tolist() == libraries[1].encode(text)
    assert (n_a[0], n_b[0]) == (len(ids_a), len(ids_b))
