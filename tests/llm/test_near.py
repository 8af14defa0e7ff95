from collections import Counter

import numpy as np
from conftest_rows import rows

from tidemark.llm import near

SF = "/root/testdata/sf0.001"


def shingles(text):
    """Each shingle as often as the text has it, told apart by numbers."""
    w = (text or "").encode().lower().split()
    counts = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {(s, k) for s, n in counts.items() for k in range(n)}


def brute_force(docs, least=0.8):
    """doc_id, class_id, copies, n_links by all pairs of distinct sets."""
    sets = {}
    for d, t in docs:
        if d is not None:
            sets.setdefault(frozenset(shingles(t)), []).append(d)
    keys = list(sets)
    group, links = {k: k for k in keys}, dict.fromkeys(keys, 0)

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if a and b and len(a & b) / len(a | b) >= least:
                links[a] += 1
                links[b] += 1
                group[root(a)] = root(b)
    label = {}
    for k in keys:
        label[root(k)] = min(label.get(root(k), 1 << 62), *sets[k])
    return {d: label[root(k)] for k, ds in sets.items() for d in ds}, {d: (len(ds), links[k]) for k, ds in sets.items() for d in ds}


def test_query_has_all_classes(spark):
    from tidemark.llm import queries

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op7_near_duplicates"](spark, "/root/testdata/sf0.01").collect()
    classes, counts = brute_force(docs)
    assert {r.doc_id: r.class_id for r in got} == classes
    assert {r.doc_id: r.copies for r in got} == {d: n for d, (n, _) in counts.items()}


def test_awkward_rows(awkward, clashing):
    docs = [r[:2] for r in rows()]
    classes, _ = brute_force(docs)
    for df in (awkward, clashing):
        got = near.near_duplicates(df).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes
        assert {r.class_id for r in got if r.doc_id is None} == {None}
        kept = near.without_near_duplicates(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(classes.values()))
        assert kept.where("doc_id IS NULL").count() == 2


def test_signatures_agree_by_weighted_similarity():
    rng = np.random.default_rng(3)
    for similar in (0.3, 0.6, 0.9):
        agree = []
        for trial in range(20):
            element = rng.integers(0, 1 << 62, 300).astype(np.uint64)
            wa = rng.integers(1, 5, 300).astype(float) * rng.choice([0.5, 1.0], 300)
            wb = np.where(rng.random(300) < similar, wa, wa * 0.4)
            want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
            row = np.repeat([0, 1], 300)
            s = near.dart_signatures(row, np.tile(element, 2), np.concatenate([wa, wb]), 2)
            agree.append((s[0] == s[1]).mean() - want)
        assert abs(np.mean(agree)) < 0.03


def test_weighted_sets(spark):
    text = " ".join(["a b c d e f"] * 30)
    df = spark.createDataFrame([(1, text), (2, text + " a b c d e f"), (3, "a b c d e f a b c d e f")], "doc_id long, text string")
    plain = {r.doc_id: r.class_id for r in near.near_duplicates(df, weighted=False).collect()}
    weighted = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert plain == {1: 1, 2: 1, 3: 1}
    assert weighted == {1: 1, 2: 1, 3: 3}


def test_large_groups_stay_whole(spark, monkeypatch):
    """Near copies of one text, in buckets far beyond one part."""
    monkeypatch.setattr(near, "PART", 16)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*words[: i % 190], f"x{i}", *words[i % 190 :]])) for i in range(300)] + [(1000 + i, words[i] + " lone text of its own " + words[-i]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    assert got == brute_force(docs)[0]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = near.components(edges).collect()
    assert len(got) == 301
    assert {r.label for r in got} == {0}


def test_long_chain_in_any_order(spark):
    ids = np.random.default_rng(4).permutation(1000).tolist()
    edges = spark.createDataFrame([(min(p), max(p)) for p in zip(ids[:-1], ids[1:], strict=True)], "a long, b long")
    got = near.components(edges).collect()
    assert len(got) == 1000
    assert {r.label for r in got} == {0}


def test_no_rows(none):
    assert near.near_duplicates(none).count() == 0
    assert near.without_near_duplicates(none).count() == 0


def family(n, shared, rng):
    """Shingle-disjoint texts of one template (similarity some 0.76 to each other), each second one with a copy of similarity just over 0.8 to it."""
    template = [f"t{i}" for i in range(shared)]
    texts = []
    for i in range(n):
        tail = [f"u{i}_{j}" for j in range(int(shared * 0.155))]
        texts.append((i, " ".join(template + tail)))
        if i % 2:
            keep = int(len(tail) * 0.35)
            texts.append((10_000 + i, " ".join(template + tail[:keep] + [f"v{i}_{j}" for j in range(len(tail) - keep)])))
    rng.shuffle(texts)
    return texts


def test_close_pairs_within_a_template(spark, monkeypatch):
    """Every pair over the limit is found among many just below it, whichever parts its two documents fall into."""
    monkeypatch.setattr(near, "PART", 16)
    docs = family(80, 400, np.random.default_rng(5))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    want = brute_force(docs)[0]
    assert len(set(want.values())) == 80
    assert got == want


def test_all_pairs_of_a_large_bucket_are_compared(spark):
    """400 planted pairs of 90 % agreement in one bucket, some 36 % across pairs: each is a candidate, at the shipped part size."""
    rng = np.random.default_rng(6)
    common = rng.random(near.COORDINATES) < 0.6
    base = rng.integers(0, 256, near.COORDINATES)
    rows = []
    for i in range(400):
        one = np.where(common, base, rng.integers(0, 256, near.COORDINATES))
        other = np.where(rng.random(near.COORDINATES) < 0.9, one, rng.integers(0, 256, near.COORDINATES))
        rows += [(7, int(rng.integers(0, 4)), 2 * i + k, bytes(x.astype(np.uint8)), 800) for k, x in enumerate((one, other))]
    members = spark.createDataFrame(rows, "bucket long, part long, set long, signature binary, count long").repartition(4)
    planted = {(2 * i, 2 * i + 1) for i in range(400)}
    first = {(r.a, r.b) for r in near.candidates(members).collect()} & planted
    label = near.components(spark.createDataFrame(sorted(first), "a long, b long"))
    groups = {}
    for r in near.unconnected(members, label).collect():
        groups.setdefault((r.bucket, r.low, r.high), set()).add(r.set)
    assert max(map(len, groups.values())) < 3 * near.PART
    assert first | {p for g in groups.values() for p in planted if g.issuperset(p)} == planted


def test_rows_of_one_doc_id_are_judged_by_their_own_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, "alone")], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.class_id, r.copies) for r in near.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1)]
    assert sorted(r.text for r in near.without_near_duplicates(df).collect()) == sorted([one, two, "alone"])


def joined_rows(spark):
    """Rows that all inner and outer joins of this session's queries have made so far."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for i in range(executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            for k in range(node.metrics().size() if "Join" in node.name() else 0):
                metric = node.metrics().apply(k)
                found = values.get(metric.accumulatorId()) if metric.name() == "number of output rows" else None
                if found is not None and found.isDefined():
                    total += int(found.get().replace(",", ""))
    return total


def test_links_within_a_class_are_joined_once(spark):
    # a chain whose least node is at its end, each node linked to the next 30
    links = [(i, i + k) for i in range(300) for k in range(1, 31) if i + k < 300]
    edges = near.written(spark.createDataFrame(links, "a long, b long"))
    before = joined_rows(spark)
    got = near.components(edges).collect()
    made = joined_rows(spark) - before
    assert {tuple(r) for r in got} == {(i, 0) for i in range(300)}
    assert 0 < made < 3 * len(links) + 10 * 300


def test_labels_are_joined_by_further_links(spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3)], "node long, label long")
    more = spark.createDataFrame([(5, 6), (6, 2), (8, 9), (9, 7)], "a long, b long")
    got = {tuple(r) for r in near.joined(labels, more).collect()}
    assert got == {(1, 1), (5, 1), (2, 1), (6, 1), (3, 3), (7, 3), (8, 3), (9, 3)}
    assert {tuple(r) for r in near.joined(labels, more.where("a = 6")).collect()} == {tuple(r) for r in labels.collect()}
