import math

import numpy as np
import pytest

from tidemark.llm import search

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, shard string, block string, query_id int"


def vectors(spark, lists):
    return spark.createDataFrame([(i, v, 1, "s", None, 7) for i, v in lists], SCHEMA).repartition(3)


def odd(spark):
    """Nulls, non-finite components, zero vectors, ties, shorter vectors, a repeated row."""
    rng = np.random.default_rng(5)
    lists = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(1, 200)]
    lists += [(200, [0.5] * 8), (201, [0.5] * 8), (202, [0.5] * 8), (202, [0.5] * 8), (240, [0.0] * 8), (300, [1.0, 2.0])]
    lists += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, [])]
    return vectors(spark, lists), lists


def brute_force(lists, every, k, key):
    own = {i: v for i, v in lists if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in own.items():
        if q % every == 0:
            scored = sorted(((-key(v, w), i) for i, w in own.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def whole(v, w):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(np.float32(v).astype(float), np.float32(w).astype(float)))  # noqa: B905


def test_exact_odd_rows(spark):
    df, lists = odd(spark)
    got = sorted(map(tuple, search.exact_top_k(df, every=20, k=5).collect()))
    assert got == brute_force(lists, 20, 5, whole)


def test_exact_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 40)
    df, lists = odd(spark)
    assert sorted(map(tuple, search.exact_top_k(df, every=10, k=7).collect())) == brute_force(lists, 10, 7, whole)


def test_max_score_against_all_products():
    rng = np.random.default_rng(1)
    for n, width, k in ((3, 4, 5), (500, 64, 5), (500, 64, 20), (50, 7, 1)):
        x = np.floor(rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.5) * 100)
        ids = np.arange(n) * 3
        for q in range(0, n, 7):
            at, score = search.max_score(np.ascontiguousarray(x.T), ids, x[q], int(ids[q]), k, x.max(axis=0), x.min(axis=0))
            full = x @ x[q]
            want = sorted((-full[i], ids[i], i) for i in range(n) if i != q)[:k]
            assert at.tolist() == [i for _, _, i in want]
            assert score.tolist() == [-s for s, _, _ in want]


def test_exact_sql(spark, duck):
    from tidemark.llm import queries

    got = sorted((r.asDict() for r in queries.queries()["op3_exact_top_k"](spark, SF).collect()), key=repr)
    assert got == duck(queries.oracle_sql()["op3_exact_top_k"], SF)


@pytest.mark.parametrize("shard", [8192, 300])
def test_nearest_recall(spark, monkeypatch, shard):
    """2,000 vectors in one shard, and in seven."""
    monkeypatch.setattr(search, "SHARD_ROWS", shard)
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").collect()}
    x, ids = np.stack(list(rows.values())), np.array(list(rows))
    got = {}
    for r in search.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect():
        assert math.isclose(r.score, float(rows[r.query_id] @ rows[r.vec_id]), rel_tol=1e-12, abs_tol=1e-12)
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = x @ rows[q]
        order = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = sorted(got[q])
        assert [n for n, _ in mine] == list(range(1, len(order) + 1))
        hits += len({i for _, i in mine} & set(order))
        total += len(order)
    assert len(x) > 6 * 300
    assert hits / total >= 0.9


def test_graph_recall():
    """Searches alone find the neighbours in a graph of 5,000 nodes without structure."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = search.graph(np.arange(5000), x)
    found = search.walk(g | {"nodes": g["nodes"] / np.abs(g["nodes"]).max()}, x[:200] / np.abs(x[:200]).max(axis=1, keepdims=True), search.BEAM)
    hits = sum(len(set(g["ids"][g["start"][at[at >= 0]]].tolist()) & set(np.argsort(-(x @ q))[:20].tolist())) for at, q in zip(found, x[:200], strict=True))
    assert hits / 4000 >= 0.9


def test_nearest_odd_rows(spark):
    """With so few rows all are found."""
    df, lists = odd(spark)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in search.nearest(df, every=20, k=5).collect())
    own = [(i, v) for i, v in lists if v and any(x for x in v)]
    want = brute_force(own, 20, 5, lambda v, w: sum(x * y for x, y in zip(np.float32(v).astype(float), np.float32(w).astype(float))))  # noqa: B905
    assert got == [x[:3] for x in want]


def test_many_equal_vectors(spark):
    df = vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(1000)] + [(i, [float(i % 7), 1.0, 0.0]) for i in range(1000, 1100)])
    got = search.nearest(df, every=500, k=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got if r.query_id < 1000) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (500, 1, 0), (500, 2, 1), (500, 3, 2), (500, 4, 3)]


def test_no_rows(spark):
    df = vectors(spark, [])
    assert search.exact_top_k(df).count() == 0
    assert search.nearest(df).count() == 0
    alone = vectors(spark, [(0, [1.0])])
    assert search.exact_top_k(alone).count() == 0
    assert search.nearest(alone).count() == 0


def test_large_components_are_exact(spark):
    """Rows whose products leave 2 ** 53 or 64 bits, among others."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    vectors += [(100 + i, [float(x) for x in rng.integers(-(2**30), 2**30, 8)]) for i in range(10)] + [(200, [1e17] * 8), (201, [-1e17] * 8), (202, [1e30] + [0.0] * 7)]
    got = search.exact_top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), every=10, k=5).collect()
    ends = -(2**63), 2**63 - 1
    clip = lambda s: min(max(s, ends[0]), ends[1])
    whole = {i: [clip(math.floor(x * 256)) for x in v] for i, v in vectors}
    for q in [i for i in whole if i % 10 == 0]:
        want = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
