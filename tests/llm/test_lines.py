import hashlib

import pytest
from conftest_rows import rows

from tidemark.llm import lines

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute_force(docs):
    """doc_id, n_lines, n_dropped, kept_sha256 by plain loops; a null doc_id comes last."""
    order = lambda d: 2**63 - 1 if d is None else d
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(order(d))
    out = []
    for d, text in docs:
        parts = (text or "").split("\n")
        kept = [x for x in parts if key(x) not in holders or len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(d)]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, lines.digest(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_awkward_rows_match_brute_force(awkward, clashing):
    want = brute_force([r[:2] for r in rows()])
    assert found(awkward) == want
    assert found(clashing) == want


def test_other_columns_pass_through(clashing):
    out = lines.dedup_lines(clashing)
    assert out.columns == [*clashing.columns, "_n_lines", "_n_dropped"]
    assert {r["set"] for r in out.select("set").collect()} == {15}


def test_no_rows(none):
    assert lines.digest(none).count() == 0


def test_full_filters_lose_nothing(spark, awkward, monkeypatch):
    """With 64 bits nearly all lines are suspects, and all texts go through the join; the result is the same."""
    keyed = lines.with_keys(awkward, lines.MIN_CHARS)
    many, want = lines.suspects(keyed, 100), found(awkward)
    monkeypatch.setattr(lines, "bits_for", lambda n: 64)
    few = lines.suspects(keyed, 100)
    assert few.where("key LIKE 'a line that%'").count() == many.where("key LIKE 'a line that%'").count() == 4
    assert few.count() >= many.count()
    assert found(awkward) == want


def test_hashes_seen_twice_are_found_once(spark):
    """Whatever task or batch they come from; few others are."""
    df = spark.range(40_000).selectExpr("array(id, id + 1000000, (id % 7000) * 3 + 5000000) AS h").repartition(6)
    got = [r.h for r in lines.twice_seen(df, 120_000).collect()]
    want = {i * 3 + 5_000_000 for i in range(7000)}
    assert want <= set(got)
    assert len(got) < 7000 + 100


def test_hot_line(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('the very same line here\n', id, ' is a line of its own') AS text")
    got = lines.dedup_lines(df).groupBy("_n_dropped").count().collect()
    assert {tuple(r) for r in got} == {(0, 1), (1, 2999)}


@pytest.mark.parametrize("name", ["op1_line_dedup"])
def test_sql(spark, duck, name):
    from tidemark.llm import queries

    got = sorted((r.asDict() for r in queries.queries()[name](spark, SF).collect()), key=lambda r: r["doc_id"])
    assert got == sorted(duck(queries.oracle_sql()[name], SF), key=lambda r: r["doc_id"])
