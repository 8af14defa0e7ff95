import hashlib
import random
import re

import numpy as np
import pytest
from conftest_rows import rows
from pyspark.sql import functions as F

from tidemark.llm import middle

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(doc_id, text, rate=90, spm_rate=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, key = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def digests(docs):
    return sorted(((*brute(d, t)[:5], sha(brute(d, t)[5]), sha(t or "")) for d, t in docs), key=repr)


def odd_texts(many=400):
    random.seed(5)
    alphabet = ["a", "B", "zz", "word", " ", "\n", ".", "1", "é", "ß", "あ", "\U0001f600", "\x00", "<P>", "<", "P>", "<S", "_", "́"]
    return [(i, "".join(random.choices(alphabet, k=random.randint(0, 25)))) for i in range(many)] + [(1000, "x" * 50_000), (1001, "-" * 50_000), (1002, "ab é" * 30_000), (1003, "<<P"), (1004, "<M>")]


def test_runs_find_every_cut():
    texts = [t.encode() for _, t in odd_texts(60)[:60]]
    starts = np.cumsum([0, *map(len, texts)])
    runs = middle.Runs.of(np.frombuffer(b"".join(texts), np.uint8), starts)
    first = runs.units_before(starts)
    for t, s, u, v in zip(texts, starts, first, first[1:], strict=False):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t.decode())
        assert v - u == len(units)
        at = runs.at(np.arange(u, v + 1))[0] - s
        assert at.tolist() == [len("".join(units[:i]).encode()) for i in range(len(units) + 1)]
    assert middle.Runs.of(np.zeros(0, np.uint8), np.zeros(1, int)).units_before(np.zeros(1, int)).tolist() == [0]


@pytest.mark.parametrize("slice_bytes", [1, middle.SLICE])
def test_odd_texts(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(middle, "SLICE", slice_bytes)
    docs = odd_texts()
    got = middle.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == digests(docs)


def test_awkward_rows(awkward, clashing, none):
    want = digests([r[:2] for r in rows()])
    for df in (awkward, clashing):
        assert sorted((tuple(r) for r in middle.digest(df).collect()), key=repr) == want
    got = middle.fill_in_middle(clashing)
    assert set(got.select("rest.*").columns) == set(clashing.columns) - {"doc_id", "text"}
    assert got.where("rest.lang = 'de'").count() == 2
    assert middle.digest(none).count() == 0


def test_other_rates(spark):
    docs = [(d, t) for d, t in odd_texts(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = middle.fill_in_middle(df, rate=50, spm_rate=100).drop("rest").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((brute(d, t, 50, 100) for d, t in docs), key=repr)
    assert middle.fill_in_middle(df, seed=2).select(F.sum("prefix_chars")).first() != middle.fill_in_middle(df).select(F.sum("prefix_chars")).first()


def test_query_and_sql(spark, duck):
    from tidemark.llm import queries

    got = queries.queries()["op11_fill_in_middle"](spark, SF)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == digests(docs)
    assert sorted((r.asDict() for r in got.collect()), key=repr) == duck(queries.oracle_sql()["op11_fill_in_middle"], SF)
