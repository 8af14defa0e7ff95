import inspect
import re
from fractions import Fraction

import pytest
from conftest_rows import rows

from tidemark.llm import mixing

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, cut at the cap, share the excess among the rest, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, todo = sum(sizes.values()), {}, set(names)
    while todo:
        level = Fraction(total - sum(out.values()), sum(weight[s] for s in todo))
        above = {s for s in todo if weight[s] * level > cap * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in todo}
        out |= {s: Fraction(cap * sizes[s]) for s in above}
        todo -= above
    return out


def check(got, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken = brute_targets(sizes), {}
    assert sorted((repr(r.doc_id), r["size"]) for r in got) == sorted((repr(d), words(t)) for d, t, _ in docs)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - float(want[r.source])) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert want[s] - 1 <= n <= want[s] + Fraction(1, 1000)


def test_awkward_rows(awkward, clashing):
    docs = [(r[0], r[1], r[3]) for r in rows()]
    for df in (awkward, clashing):
        check(mixing.mix(df).collect(), docs)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_many_sources(spark, n):
    docs = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{min(i % (3 * n), n - 1):02}") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    first = mixing.mix(df, bucket_rows=16).collect()
    check(first, docs)
    again = mixing.mix(df.repartition(5), bucket_rows=64).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_rows_without_doc_id_are_dealt_over_all_ranges(spark):
    docs = [(None, f"own words {i} of a row" + " w" * (i % 5), "web" if i % 3 else "books") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    ranges = df.groupBy(mixing.random_key("mix").substr(1, 1).alias("range")).count().collect()
    assert len(ranges) == 16
    assert max(r["count"] for r in ranges) < 100
    first = mixing.mix(df, bucket_rows=16).collect()
    check(first, docs)
    again = mixing.mix(df.repartition(7), bucket_rows=64).collect()
    assert sorted((r.text_hash, r.taken) for r in first) == sorted((r.text_hash, r.taken) for r in again)


def test_mixed_documents(spark, clashing):
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    taken = {}
    for r in mixing.mix(clashing).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    n = {}
    for r in out.collect():
        n[r.source] = n.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert n == {s: k for s, k in taken.items() if k}


def test_no_rows(none):
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_sql(spark, duck):
    from tidemark.llm import queries

    got = sorted((r.asDict() for r in queries.queries()["op8_mix_sources"](spark, SF).collect()), key=lambda r: r["doc_id"])
    want = sorted(duck(queries.oracle_sql()["op8_mix_sources"], SF), key=lambda r: r["doc_id"])
    assert [r | {"target": 0} for r in got] == [r | {"target": 0} for r in want]
    assert all(abs(a["target"] - b["target"]) <= 1e-9 * b["target"] for a, b in zip(got, want, strict=True))


def test_no_python_workers():
    assert not any(x in inspect.getsource(mixing) for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "collect("))
