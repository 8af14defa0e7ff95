import hashlib
import zlib

import pytest
from conftest_rows import rows
from pyspark.sql import functions as F

from tidemark.llm import merkle

SF = "/root/testdata/sf0.001"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    d, text, lang, source, n = row[:5]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def climbed(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(up, i):
    out = []
    for own in up[:-1]:
        run, place = own[i - i % 3 : i - i % 3 + 3], i % 3
        out.append(("".join(run[:place]), "".join(run[place + 1 :])))
        i //= 3
    return out


def brute(docs):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified by the contract's words. Rows are (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for r in docs:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climbed([leaf(r) for r in by_source[s]])
    top = climbed([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            own = path(trees[s], i) + path(top, at)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((r[0], r[1].replace("\n", "") if even and r[1] is not None else r[1], *r[2:]))
            for b, a in own:
                node = H(b + node + a)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, H("".join(b + a for b, a in own)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 100, 243, 729])
def test_traversal(leaves):
    """Paths equal those of the whole tree; updates come in time, and few nodes are held."""
    nodes = [H(str(i)) for i in range(leaves)]
    up = climbed(nodes)
    walk = merkle.Traversal(leaves, merkle.levels(leaves, 99), nodes.__getitem__)
    assert walk.root() == up[-1][0]
    assert [list(p) for p in walk] == [path(up, i) for i in range(leaves)]
    assert walk.late == 0
    assert walk.most <= 8 * (len(up) - 1) + 1


def test_last_block_is_closed_at_each_level():
    """A block with few leaves in a larger tree has as many levels as the others."""
    nodes = [H(str(i)) for i in range(4)]
    walk = merkle.Traversal(4, 4, nodes.__getitem__)
    a, b = H("".join(nodes[:3])), H(nodes[3])
    assert walk.root() == H(H(H(a + b)))
    assert list(walk)[3] == [("", ""), (a, ""), ("", ""), ("", "")]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_awkward_rows(awkward, clashing, none, height):
    want = brute(rows())
    for df in (awkward, clashing)[: 2 if height == 2 else 1]:
        assert sorted((tuple(r) for r in merkle.digest(df, height).collect()), key=repr) == want
    if height == 2:
        assert merkle.digest(none, height).count() == 0


def test_one_hot_source(spark):
    """A third of the rows in one source, equal ids and repeated rows; blocks of 27 leaves, three levels of blocks."""
    docs = [(None if i % 50 == 7 else i % 1500, f"text {i % 1700}\n" * (i % 3), "en", "hot" if i % 3 else f"s{i % 31}", i % 1700) for i in range(3000)]
    got = merkle.digest(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)


def test_one_source_and_general_interface(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'a' AS source", "2L AS n_chars")
    own = merkle.manifest(docs, 1, {"parity": F.col("doc_id") % 2})
    got = own.select("*", merkle.folded(F.col("leaf"), F.col("path")).alias("again")).collect()
    assert len({r.root for r in got}) == 1 and all(r.again == r.root == r.subroot and r.parity == r.doc_id % 2 for r in got)
    assert not own.where(merkle.folded(F.lit("0" * 64), F.col("path")) == F.col("root")).count()


def test_query_and_sql(spark, duck):
    from tidemark.llm import queries

    got = queries.queries()["op13_merkle_manifest"](spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)
    assert {r.verified for r in got} == {True, False}
    assert sorted((r.asDict() for r in got), key=repr) == duck(queries.oracle_sql()["op13_merkle_manifest"], SF)
