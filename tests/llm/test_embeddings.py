import math
import random

import numpy as np
import pytest

from cohortlens.llm import embedding_dedup, pivot_search

VECS = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)], VECS)


def planted(seed, n, width=16):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=width) for _ in range(n)]
    for base in out[: n // 4]:
        out += [base + rng.normal(size=width) * s for s in (0.0, 0.05, 0.2, 0.35)]
    return [v.tolist() for v in out] + [None, [], [0.0] * width, [NAN] + [1.0] * (width - 1), [1.0] * (width - 1) + [None], [INF] * width, [1.0, 2.0], [2.0, 4.0]]


def usable(v):
    return v and None not in v and all(map(math.isfinite, v))


def brute_links(vectors, cosine=0.9):
    root, links = list(range(len(vectors))), [0] * len(vectors)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    units = [np.array(np.float32(v), dtype=float) / np.linalg.norm(np.float32(v).astype(float)) if usable(v) and any(v) else None for v in vectors]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, links[i], find(i), find(i) == i) for i in range(len(vectors))]


@pytest.mark.parametrize("rows,block", [(512, 1024), (8, 6)])
def test_links_against_all_pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-6)
    tables = embedding_dedup.tables_for
    monkeypatch.setattr(embedding_dedup, "tables_for", lambda n, cosine: tables(n, cosine, 1e-6, rows))
    vectors = planted(1, 60)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors_of(spark, vectors)).collect())
    assert got == brute_links(vectors)


def test_estimates_leave_nothing_out():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    near = base + rng.normal(size=(300, 64)) * 0.45
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (base, near))
    code, factor = embedding_dedup.codes(a)
    i, j = embedding_dedup.linked_pairs(a, b, code, factor, False, 0.9)
    want = np.argwhere(a @ b.T >= 0.9)
    assert len(i) >= 0.99 * len(want) and set(zip(i.tolist(), j.tolist())) <= set(map(tuple, want.tolist()))


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(vectors_of(spark, [])).count() == 0
    assert pivot_search.top_k(vectors_of(spark, []), "vec_id % 2 = 0", 3).count() == 0


def brute_top(vectors, every, k):
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in enumerate(vectors) if usable(v)}
    out = []
    for q in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_search_against_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "ROW_BLOCK", block)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(pivot_search, "FIRST_CHUNK", 3)
    vectors = planted(2, 40)
    vectors += vectors[3:9] + [[0.0] * 16] * 3
    df = vectors_of(spark, vectors).withColumnRenamed("label", "score")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(df, "vec_id % 5 = 0", 5).collect())
    assert got == brute_top(vectors, 5, 5)


def test_fewer_rows_than_asked(spark):
    vectors = [[random.Random(i).random() for _ in range(4)] for i in range(3)]
    got = sorted(tuple(r) for r in pivot_search.top_k(vectors_of(spark, vectors), "vec_id = 0", 5).collect())
    assert got == [x for x in brute_top(vectors, 3, 5)]


def test_a_repeated_query_row_is_asked_once(spark):
    vectors = [[1.0, 0.0], *([1.0 - i / 10, 0.5] for i in range(6))]
    frame = vectors_of(spark, vectors)
    rows = pivot_search.top_k(frame.unionByName(frame.where("vec_id = 0")), "vec_id = 0", 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in rows) == [(i, i) for i in range(1, 6)]


@pytest.mark.parametrize("size", [1e5, 1e7, 1e12])
def test_ranks_follow_products_that_no_long_holds(spark, size):
    rng = np.random.default_rng(5)
    vectors = [(rng.normal(size=16) * size * 10.0 ** (i % 3)).tolist() for i in range(60)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(vectors_of(spark, vectors), "vec_id % 5 = 0", 5).collect())
    assert got == [(q, r, c, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, c, s in brute_top(vectors, 5, 5)]


def test_rows_without_an_id_take_no_part(spark):
    vectors = [[float(i % 7), float(i % 5), 1.0] for i in range(30)]
    frame = vectors_of(spark, vectors)
    nameless = frame.selectExpr("cast(null as bigint) as vec_id", "embedding", "label")
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in pivot_search.top_k(frame.union(nameless), "vec_id % 5 = 0", 5).collect())
    assert got == brute_top(vectors, 5, 5)
