"""Near-duplicate documents: DartMinHash signatures, banded joining, exact confirmation and connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, parallelism, text_of, unpacked, written
from .lines import bloom, with_known
from .words import grouped, in_groups, mixed, words

SHINGLE, SIMILARITY = 5, 0.8
#: BANDS bands of ROWS coordinates each: two documents of similarity 0.8 share none of them once in 14,000 times.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Buckets of more members are compared in parts of some PART members: each with one in common first, then each two parts.
PART = 256
#: Pairs whose signatures agree less are not looked at: more than five standard deviations below 0.8, which comes once in some 50 million.
LEAST_AGREEMENT = 0.6
SALTS = 8


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each text's distinct shingles of SHINGLE words, A-Z lower-cased; of a shorter text, of all its words together."""
    h, n = words([t.lower() for t in texts])
    row = np.repeat(np.arange(len(texts)), n)
    total = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        part = h[k:] * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) & (1 << 64) - 1)
        total[: len(part)] += np.where(row[k:] == row[: len(part)], part, np.uint64(0))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    full = (place + SHINGLE <= n[row]) | (place == 0)
    hashes, row = mixed(total[full]), row[full]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[first], hashes[first], np.diff(np.append(first, len(row)))


def cells_of(row: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each element's region, [0, weight), cut into cells of height 1, the last of which may be lower: row, cell hash, height."""
    n = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(element)), n)
    level = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return row[at], mixed(element[at] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.minimum(weight[at] - level, 1.0)


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = COORDINATES) -> np.ndarray:
    """k 64-bit coordinates for each of rows weighted sets; two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

    Darts land on each cell of an element's region as a Poisson process over time, given by the cell's hash alone. A dart has a height in its cell
    and counts if the region reaches it; it has a coordinate, which keeps the earliest dart. Some k ln k + 2 k darts a set, thrown up to a time
    in inverse proportion to its weight, mostly hit all coordinates; the sets with an empty one throw twice as long.
    A set without elements has coordinates 0.
    """
    row, cell, height = cells_of(row, element, weight)
    size = np.bincount(row, height, rows)
    best, sign = np.full(rows * k, np.inf), np.zeros(rows * k, np.uint64)
    reach = (k * np.log(k) + 2 * k) / np.maximum(size, 1e-300)
    todo = size > 0
    while todo.any():
        at = np.flatnonzero(todo[row])
        time, number = np.zeros(len(at)), 0
        while len(at):
            count = int(np.clip(reach[row[at]].mean() + 1, 1, 16))
            seed = mixed(cell[at][:, None] + np.arange(number, number + count, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F))
            times = time[:, None] + np.cumsum(-np.log(uniform(seed)), axis=1)
            thrown = times <= reach[row[at]][:, None]
            which = np.broadcast_to(at[:, None], thrown.shape)[thrown]
            dart = mixed(seed[thrown] ^ np.uint64(0xE7037ED1A0B428DB))
            moment = times[thrown]
            inside = (height[which] >= 1) | (uniform(mixed(dart + np.uint64(1))) < height[which])
            which, dart, moment = which[inside], dart[inside], moment[inside]
            key = row[which] * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, key, moment)
            first = moment == best[key]
            sign[key[first]] = dart[first]
            on = thrown[:, -1]
            at, time, number = at[on], times[on, -1], number + count
        todo &= np.isinf(best.reshape(rows, k)).any(axis=1)
        reach = np.where(todo, reach * 2, reach)
    return sign.reshape(rows, k)


def signatures(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, hash (of the text), set (a hash of the shingles and their weights; 0 for texts without words), bands (hashes of each band's coordinates) and signature (a byte of each coordinate).

    weighted: a shingle weighs as often as it occurs; else each weighs 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_groups(texts, 1 << 19):
                row, h, n = shingles(texts[a:b])
                weight = n.astype(float) if weighted else np.ones(len(n))
                sign = dart_signatures(row, h, weight, b - a)
                whole = np.zeros(b - a, np.uint64)
                np.add.at(whole, row, mixed(h ^ mixed(weight.astype(np.uint64))))
                power = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], np.uint64)
                bands = mixed((sign.reshape(b - a, BANDS, ROWS) * power).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel())), pa.array([x.tobytes() for x in (sign >> np.uint64(17)).astype(np.uint8)], pa.binary())], ["doc_id", "hash", "set", "bands", "signature"])

    return docs.select("doc_id", F.xxhash64(text_of()), F.encode(text_of(), "UTF-8")).mapInArrow(run, "doc_id long, hash long, set long, bands array<long>, signature binary")


def spanning(doc: np.ndarray, sign: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Pairs to confirm first in one part of a bucket, and its most central member.

    Pairs are taken by falling agreement, those that connect two so far unconnected groups; and, as a pair near the limit may prove less
    alike, the three best of each member under 0.9 besides. All pairs that these leave unconnected are up to unconnected.
    """
    m = len(doc)
    agree = (sign[:, None, :] == sign[None, :, :]).mean(axis=2)
    a, b = np.triu_indices(m, 1)
    s = agree[a, b]
    order = np.argsort(-s, kind="stable")
    order = order[s[order] >= LEAST_AGREEMENT]
    group, used, out = list(range(m)), [0] * m, []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i in order.tolist():
        x, y = int(a[i]), int(b[i])
        rx, ry = root(x), root(y)
        if rx != ry:
            group[rx] = ry
        elif s[i] >= 0.9 or (used[x] >= 3 and used[y] >= 3):
            continue
        if s[i] < 0.9:
            used[x] += 1
            used[y] += 1
        out.append((int(doc[x]), int(doc[y])))
    return out, int(doc[np.argmax(agree.sum(axis=1))])


def bucket_members(sets: DataFrame) -> DataFrame:
    """bucket, part, set, signature, count (the bucket's members) of sets that share a band. sets: set, bands, signature, one row for each."""
    # a band's hash heeds the band's number, so it names a bucket
    each = sets.select("set", "signature", F.explode("bands").alias("bucket")).withColumn("salt", salt_of("set"))
    counts = salted(each.groupBy("bucket").count().where("count > 1"))
    part = F.pmod(F.xxhash64("set", F.lit(3)), F.ceil(F.col("count") / PART))
    return cut(each.join(counts, ["bucket", "salt"]).select("bucket", part.alias("part"), "set", "signature", "count"))


def salt_of(name: str):
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    """Each row once for each salt."""
    return df.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))


def candidates(members: DataFrame) -> DataFrame:
    """a, b (a < b): pairs of sets to confirm first, from the buckets of bucket_members: few, but enough to connect most of what is alike.

    Buckets go in parts of some PART members through spanning. Each part's most central member is paired with all members of the next part besides, so parts join up
    in a ring. No bucket is ever whole in a task, and no set has more pairs than some PART for each of its bands. What stays apart is up to unconnected.
    """
    spark = members.sparkSession

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handled(t: pa.Table) -> pa.RecordBatch:
            bucket, part, doc, count = (t.column(c).to_numpy() for c in ("bucket", "part", "set", "count"))
            sign = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]))
            sizes = np.diff(np.append(first, len(doc)))
            two = first[sizes == 2]
            two = two[(sign[two] == sign[two + 1]).mean(axis=1) >= LEAST_AGREEMENT]
            pairs = [np.stack([doc[two], doc[two + 1]], 1)]
            central = []
            for f, n in zip(first[sizes != 2].tolist(), sizes[sizes != 2].tolist(), strict=True):
                found, middle = spanning(doc[f : f + n], sign[f : f + n]) if n > 1 else ([], int(doc[f]))
                pairs.append(np.array(found, np.int64).reshape(-1, 2))
                if count[f] > PART:
                    central.append((int(bucket[f]), int(part[f]), middle))
            p, c = np.concatenate(pairs), np.array(central, np.int64).reshape(-1, 3)
            none = np.zeros(len(p), np.int64)
            columns = [np.append(none, c[:, 0]), np.append(none, c[:, 1]), np.append(p.min(axis=1), c[:, 2]), np.append(p.max(axis=1), c[:, 2])]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.arange(len(p) + len(c)) >= len(p))], ["bucket", "part", "a", "b", "central"])

        for t in grouped(batches, ["bucket", "part"]):
            yield handled(t)

    n = parallelism(spark)
    found = cut(members.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(link, "bucket long, part long, a long, b long, central boolean"))
    middle = found.where("central").select("bucket", "part", F.col("a").alias("middle"))
    before = F.pmod(F.col("part") - 1, F.ceil(F.col("count") / PART))
    ring = members.where(F.col("count") > PART).select("bucket", before.alias("part"), "set").join(middle, ["bucket", "part"]).where("set <> middle")
    pairs = found.where("NOT central").select("a", "b").union(ring.select(F.least("set", "middle"), F.greatest("set", "middle")))
    return pairs.distinct()


def unconnected(members: DataFrame, label: DataFrame) -> DataFrame:
    """bucket, low, high, part, set, label, signature: groups of at most some 2 * PART sets, in which are all pairs that share a bucket, have different labels and
    signatures that agree in at least LEAST_AGREEMENT; sets without such a partner in their group are left out.

    label: node, label of confirmed classes; other sets are a class each. Buckets of one class are left out. In the others each two parts,
    and each part with itself, make a group, so every pair meets, and no group is larger.
    """
    own = cut(members.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set")).withColumn("salt", salt_of("set")))
    mixed_ones = salted(own.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket"))
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("count") / PART) - 1)
    dealt = own.join(mixed_ones, ["bucket", "salt"]).select("bucket", "part", "set", "signature", "label", F.explode(parts).alias("other"))
    dealt = dealt.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "set", "label", "signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, GROUP_OF_PARTS):
            label, sign = t.column("label").to_numpy(), signs(t)
            meets = np.zeros(t.num_rows, bool)
            for i, right in partners(t):
                j = right[label[right] != label[i]]
                j = j[(sign[j] == sign[i]).mean(axis=1) >= LEAST_AGREEMENT]
                meets[j] = True
                meets[i] |= len(j) > 0
            yield from t.filter(pa.array(meets)).combine_chunks().to_batches()

    return by_parts(dealt).mapInArrow(compare, dealt.schema)


GROUP_OF_PARTS = ["bucket", "low", "high"]


def by_parts(df: DataFrame) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), *GROUP_OF_PARTS).sortWithinPartitions(*GROUP_OF_PARTS)


def signs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def partners(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of the lower part of its group, with the rows of the higher part, or those after it in the same part."""
    bucket, low, high, part = (t.column(c).to_numpy() for c in (*GROUP_OF_PARTS, "part"))
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    for f, e in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True):
        rows = np.arange(f, e)
        left, right = rows[part[f:e] == low[f]], rows[part[f:e] == high[f]]
        for i in left.tolist():
            yield i, right[right > i] if low[f] == high[f] else right


def late_links(docs: DataFrame, firsts: DataFrame, groups: DataFrame, least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """a, b, similarity of links between sets of different labels, from the groups of unconnected: enough of them to connect what is connected there.

    A group's pairs are compared in its task, on the shingles themselves; a pair that shares several buckets only in the first of them. So pairs
    that aren't alike enough, of which a large group of looser copies has very many, never leave a task.
    firsts: set, bands, and doc_id and hash of a text that has it.
    """
    sets = shingles_of(docs, firsts, groups.select("set").distinct(), weighted).join(firsts.select("set", "bands"), "set")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, GROUP_OF_PARTS):
            bucket, name, label, sign = t.column("bucket").to_numpy(), t.column("set").to_numpy(), t.column("label").to_numpy(), signs(t)
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            own = [numbered(np.frombuffer(x, np.uint32)) for x in t.column("shingles").to_pylist()]
            size, group, out = np.array([len(x) for x in own]), {}, []

            def root(x: int, group: dict[int, int] = group) -> int:
                while group.get(x, x) != x:
                    x = group[x]
                return x

            for i, right in partners(t):
                j = right[(label[right] != label[i]) & (np.minimum(size[right], size[i]) >= least * np.maximum(size[right], size[i]) - 1e-9)]
                j = j[(sign[j] == sign[i]).mean(axis=1) >= LEAST_AGREEMENT]
                same = bands[j] == bands[i]
                j = j[bands[j, same.argmax(axis=1)] == bucket[i]]
                if not len(j):
                    continue
                both = np.concatenate([own[k] for k in j.tolist()])
                at = np.minimum(np.searchsorted(own[i], both), size[i] - 1)
                common = np.bincount(np.repeat(np.arange(len(j)), size[j]), own[i][at] == both, len(j))
                alike = common / (size[j] + size[i] - common)
                for k, x in zip(j[alike >= least].tolist(), alike[alike >= least].tolist(), strict=True):
                    a, b = root(int(label[i])), root(int(label[k]))
                    if a != b:
                        group[a] = b
                        out.append((min(name[i], name[k]), max(name[i], name[k]), x))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x)) for x in zip(*out, strict=True)], ["a", "b", "similarity"])

    dealt = by_parts(groups.join(sets, "set").select(*GROUP_OF_PARTS, "part", "set", "label", "signature", "bands", "shingles"))
    return dealt.mapInArrow(confirm, "a long, b long, similarity double")


def numbered(values: np.ndarray) -> np.ndarray:
    """Sorted values as numbers that tell a value's first, second, ... occurrence apart, sorted too."""
    first = np.searchsorted(values, values)
    return values.astype(np.uint64) << np.uint64(32) | (np.arange(len(values)) - first).astype(np.uint64)


def shingle_sets(texts: DataFrame, weighted: bool = True) -> DataFrame:
    """set, shingles: 32 bits of each distinct shingle's hash (repeated as often as it weighs), sorted, as bytes. texts: set, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in in_groups(texts, 1 << 19):
                row, h, n = shingles(texts[a:b])
                if weighted:
                    row, h = np.repeat(row, n), np.repeat(h, n)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                small = (h >> np.uint64(32)).astype(np.uint32)
                out += [small[s:e].tobytes() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["set", "shingles"])

    return texts.select("set", F.encode("text", "UTF-8")).mapInArrow(run, "set long, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays, of multisets where values repeat."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    value, side = both[order], np.where(order < len(a), 1, -1)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    apart = np.abs(np.add.reduceat(side, first)).sum() if len(first) else 0
    return float((len(both) - apart) / (len(both) + apart)) if len(both) else 0.0


def shingles_of(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """set, shingles of the wanted sets. firsts: set, and doc_id and hash of a text that has it."""
    named = cut(firsts.join(wanted, "set", "left_semi").select("set", "doc_id", "hash"))
    # only texts whose hash a filter of the wanted ones has are shuffled
    texts = with_known(docs.select("doc_id", F.xxhash64(text_of()).alias("hash"), text_of().alias("text")), "hash", bloom(named.select(F.col("hash").alias("h"))))
    texts = texts.join(named, ["doc_id", "hash"]).dropDuplicates(["set"])
    return cut(shingle_sets(texts, weighted))


def links(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """a, b, similarity of the pairs of sets that are really at least this similar. firsts: see shingles_of."""
    sets = shingles_of(docs, firsts, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), weighted)
    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            s = np.array([similarity(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) for p, q in zip(x, y, strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "similarity"]).filter(pa.array(s >= least))

    return both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that is connected.

    Each round points every node to its least neighbour (or itself), follows the pointers to their ends, and goes on with the links between different
    ends alone, each once. So a link within what is joined already isn't looked at again, at least half of the ends go each round, and long chains cost
    doublings of the pointers, in whatever order their ids are. Ends when no link is left.
    """
    left, labels = edges.select("a", "b"), None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        ends = followed(written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))))
        labels = ends if labels is None else written(moved(labels, ends))
        left = written(between(left, ends))
        if left.isEmpty():
            return labels


def followed(pointers: DataFrame) -> DataFrame:
    """node, label with each label replaced by the end of its chain of labels, by doubling."""
    while True:
        used = pointers.select("label").distinct()
        hops = written(pointers.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("next")).join(used, "label", "left_semi").select(F.col("label").alias("node"), F.col("next").alias("label")))
        if hops.isEmpty():
            return pointers
        pointers = written(moved(pointers, hops))


def moved(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """node, label with labels that are a node of ends replaced by its label."""
    # many nodes have one label, few nodes are one
    hops = ends.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.withColumn("salt", salt_of("node")).join(salted(hops), ["label", "salt"], "left").select("node", F.coalesce("next", "label").alias("label"))


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b (a < b): pairs of labels that edges connect. A node without a label is its own."""
    for c in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(c), "label"), c, "left").withColumn(c, F.coalesce("label", c)).select("a", "b")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """node, label of components' labels and further edges (a, b): only these are looked at."""
    own = labels.union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    links = written(between(more, labels))
    return own if links.isEmpty() else written(moved(own, components(links)))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and copies (documents with the very same shingles) of each document.

    Documents are linked if their word shingles have a Jaccard similarity of least or more, where each shingle weighs as often as the text has it (without weighted: 1);
    classes are what links connect. Candidates share a band of their DartMinHash signatures; each is then confirmed on the shingles themselves: first a few that
    connect most, then all pairs whose documents aren't connected by confirmed links yet. Links within a class aren't all looked at, so they aren't counted.
    Documents with the same shingles are one candidate. Texts without words (null, empty, blank) are copies of each other. A null doc_id has a null class.
    Rows with one doc_id are judged by their own texts each, so they may be in several classes.
    """
    return classified(docs, least, weighted).select("doc_id", "class_id", "copies")


def classified(docs: DataFrame, least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """As near_duplicates, with hash (of the text) and label (of the class) besides."""
    own = cut(signatures(docs, weighted))
    first = F.min(F.struct("doc_id", "hash", "bands", "signature")).alias("x")
    firsts = cut(own.where("doc_id IS NOT NULL").groupBy("set").agg(first, F.count("*").alias("copies")).select("set", "x.*", "copies"))
    members, texts = bucket_members(firsts.select("set", "bands", "signature")), docs.where("doc_id IS NOT NULL")
    confirmed = cut(links(texts, firsts, candidates(members), least, weighted))
    label = components(confirmed)
    later = cut(unconnected(members, label))
    if not later.isEmpty():
        more = cut(late_links(texts, firsts, later, least, weighted))
        if not more.isEmpty():
            label = joined(label, more)
    classes = firsts.select("set", "doc_id", "copies").join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    least_doc = salted(classes.groupBy("label").agg(F.min("doc_id").alias("class_id")))
    classes = classes.withColumn("salt", salt_of("set")).join(least_doc, ["label", "salt"]).select("set", "label", "class_id", "copies")
    out = own.select("doc_id", "hash", "set", salt_of("doc_id").alias("salt")).join(salted(classes), ["set", "salt"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "hash", F.when(known, F.col("label")).alias("label"), F.when(known, F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def without_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, of its smallest doc_id. Rows without doc_id all stay. Of rows with one doc_id and different texts each is judged by its own;
    where two of one class have its smallest doc_id, the text with the smallest hash stays."""
    own = docs.select(packed(docs, ()), "doc_id", F.xxhash64(text_of()).alias("_hash"))
    kept = classified(docs, least).where("doc_id IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "hash")).alias("x")).select("x.doc_id", F.col("x.hash").alias("_hash"))
    stay = own.where("doc_id IS NOT NULL").join(kept, ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id", "_hash"])
    return stay.unionByName(own.where("doc_id IS NULL")).select(*unpacked(docs))
