"""A manifest of a dataset: one hash tree of three branches a source, one over the sources, and each document's proof.

Leaves are ranked in Spark and dealt to aligned blocks of 3 ** height. Blocks become their roots, those are leaves of the next
level's blocks, and so on. Downwards, each block's leaves get their authentication paths by a traversal that keeps a few
nodes a height, and the block's own path, which all its leaves share, is put behind them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

ARITY = 3
HEIGHT = 6  # of a block: 729 leaves
PATH = "array<struct<before: string, after: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Computes the nodes of one run (those under one parent) at a height from their leaves, which come one by one.

    Holds at most two nodes at each lower height and the run's own: as soon as three stand at one height they become one above.
    """

    def __init__(self, height: int, first: int, leaves: int):
        """The run starts with the leaf first; the block has this many leaves."""
        self.height, self.next = height, first
        self.end = min(leaves, first + ARITY ** (height + 1))
        self.nodes: list[list[str]] = [[] for _ in range(height + 1)]

    @property
    def done(self) -> bool:
        return self.next >= self.end

    @property
    def low(self) -> int:
        """The height of its lowest node, which the schedule goes by; its own height if it has none yet."""
        return next((h for h, own in enumerate(self.nodes) if own), self.height)

    def size(self) -> int:
        return sum(map(len, self.nodes))

    def update(self, leaf: str) -> None:
        """Take the next leaf. At the end, runs that have fewer nodes than three are closed too."""
        self.next += 1
        self.nodes[0].append(leaf)
        for h in range(self.height):
            if len(self.nodes[h]) == ARITY or (self.done and self.nodes[h]):
                self.nodes[h + 1].append(joined(self.nodes[h]))
                self.nodes[h] = []


class Traversal:
    """The authentication paths of a block's leaves in turn.

    For each height it holds the run with the leaf's node, and a Treehash that gets ready the run after it. A leaf's step
    has as many updates as there are heights; each goes to the unfinished Treehash with the lowest node (of equal ones the
    lowest), so that hardly more than one has nodes at any height: memory is logarithmic in the block's leaves.
    """

    def __init__(self, leaves: int, height: int, leaf: Callable[[int], str]):
        self.leaves, self.height, self.leaf = leaves, height, leaf
        self.late = self.most = 0  # updates made at the last moment, and the most nodes held
        self.runs: list[list[str]] = []
        self.ahead: list[Treehash] = []
        for h in range(height):
            now = Treehash(h, 0, leaves)
            while not now.done:
                now.update(leaf(now.next))
            self.runs.append(now.nodes[h])
            self.ahead.append(Treehash(h, ARITY ** (h + 1), leaves))

    def root(self) -> str:
        """Of the block: asked for before the first leaf is left."""
        return joined(self.runs[-1]) if self.height else self.leaf(0)

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf, from its height on upwards: the siblings before and after its node, as one text each."""
        for i in range(self.leaves):
            path, at = [], i
            for run in self.runs:
                at, place = divmod(at, ARITY)
                path.append(("".join(run[:place]), "".join(run[place + 1 :])))
            yield path
            self.advance(i + 1)

    def advance(self, i: int) -> None:
        for _ in range(self.height):
            open_ones = [t for t in self.ahead if not t.done]
            if not open_ones:
                break
            t = min(open_ones, key=lambda t: t.low)
            t.update(self.leaf(t.next))
        self.most = max(self.most, sum(t.size() for t in self.ahead) + sum(map(len, self.runs)))
        if i < self.leaves:
            for h in range(self.height):
                if i % ARITY ** (h + 1):
                    break
                t = self.ahead[h]
                while not t.done:
                    t.update(self.leaf(t.next))
                    self.late += 1
                self.runs[h], self.ahead[h] = t.nodes[h], Treehash(h, i + ARITY ** (h + 1), self.leaves)


def levels(leaves: int, height: int) -> int:
    """How many levels a block of a tree with so many leaves has: height, or as many as a smaller tree needs."""
    h = 0
    while h < height and ARITY**h < leaves:
        h += 1
    return h


def hash_of(parts: list[Column]) -> Column:
    """Of a row: each part as - if it is null, else as its length in UTF-8 bytes, a colon and itself."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.encode(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), "UTF-8"), 256)


def leaf_of(text: Column | str = "text") -> Column:
    """The leaf of a row of documents, with another text if need be."""
    return hash_of([F.col(text) if isinstance(text, str) and c == "text" else text if c == "text" else F.col(c) for c in FIELDS])


def ranked(nodes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds rank (from 0) within tree, by the columns of order, nulls first, and n (how many the tree has). nodes must be stable.

    Ranges of (tree, order) with their numbers are written; counts by tree and range give where each starts. So a tree with a
    third of all rows is spread over as many tasks as its rows need. Order must end in a column that tells all rows apart.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = written(nodes.repartitionByRange(parts, "tree", *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("tree", "_part").count()
    whole = W.partitionBy("tree")
    starts = counts.select("tree", "_part", (F.sum("count").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).alias("_first"), F.sum("count").over(whole).alias("n"))
    inside = F.row_number().over(W.partitionBy("tree", "_part").orderBy(*order)) - 1
    return dealt.join(starts, ["tree", "_part"]).withColumn("rank", F.col("_first") + inside).select(*nodes.columns, "rank", "n")


def blocks(nodes: DataFrame, height: int) -> DataFrame:
    """With tree, rank, n, node: one row per aligned block, as a node of the level above: tree, rank (the block's number), n (blocks of the tree), node (its root)."""
    size = ARITY**height

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        own = group["node"].to_pylist()
        top = Treehash(levels(group["n"][0].as_py(), height), 0, len(own))
        for leaf in own:
            top.update(leaf)
        n = -(-group["n"][0].as_py() // size)
        return pa.table({"tree": group["tree"][:1], "rank": group["_block"][:1], "n": pa.array([n], pa.int64()), "node": pa.array([top.nodes[top.height][0]])})

    dealt = nodes.select("tree", "rank", "n", "node", F.floor(F.col("rank") / size).alias("_block"))
    return dealt.groupBy("tree", "_block").applyInArrow(root, "tree string, rank long, n long, node string")


def with_paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """nodes with subroot and path: the siblings before and after each one's node, level by level, in its block and then those of the block's own path. above: the level of the blocks, with both."""
    size = ARITY**height
    dealt = nodes.withColumn("_block", F.floor(F.col("rank") / size))
    shared = above.select("tree", F.col("rank").alias("_block"), "subroot", "path")
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def walk(group: pa.Table, block: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        own, upper = group["node"].to_pylist(), block["path"][0].as_py()
        paths = Traversal(len(own), levels(group["n"][0].as_py(), height), own.__getitem__)
        out = [[*({"before": b, "after": a} for b, a in path), *upper] for path in paths]
        return group.drop_columns(["_block"]).append_column("subroot", pa.array([block["subroot"][0].as_py()] * len(own))).append_column("path", pa.array(out, kind))

    schema = T.StructType(list(nodes.schema.fields)).add("subroot", "string").add("path", T.ArrayType(T.StructType.fromDDL("before string, after string")))
    return dealt.groupBy("tree", "_block").cogroup(shared.groupBy("tree", "_block")).applyInArrow(walk, schema)


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The levels of blocks, from the nodes (a stable table with tree, rank, n, node) up to one where each tree is one node. A level has 3 ** height times fewer rows than the one below."""
    out = [nodes]
    while out[-1].where("rank > 0").limit(1).count():
        out.append(written(blocks(out[-1], height)))
    return out


def descend(up: list[DataFrame], height: int, top: DataFrame) -> DataFrame:
    """The lowest level with subroot and path; top: the highest one with them."""
    above = top
    for at in reversed(range(len(up) - 1)):
        above = with_paths(up[at], above, height)
        if at:
            above = written(above)
    return above


def manifest(docs: DataFrame, height: int = HEIGHT, kept: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path: one row per document, of docs with doc_id, source, lang, n_chars and text.

    A leaf is the hash of a document's five columns. A source's leaves ascend by doc_id (null first; those of equal ids by
    the leaf, and equal leaves are alike); every three consecutive nodes become one, the last run may have fewer, until one
    is left: the subroot. Subroots by source (null first) become the root likewise. path: the siblings before and after the
    node, at each level from the leaf to the root. kept: columns by name, of docs, that go with each leaf.
    Null, empty and repeated rows are leaves as others; further columns of docs don't matter. No rows: no rows.

    Rows are moved by their hashes, never with their texts, and each task holds one block of 3 ** height leaves at a time,
    whatever a source's share. All levels are written to the checkpoint folder.
    """
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # null sorts first, and joins
    names = list(kept or {})
    own = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf_of().alias("node"), F.monotonically_increasing_id().alias("row"), F.struct(*((kept or {})[n].alias(n) for n in names) if names else [F.lit(0).alias("_")]).alias("kept"))
    up = climb(written(ranked(written(own), ("key", "node", "row"))), height)
    subroots = up[-1].withColumn("subroot", F.col("node"))
    over = climb(written(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node"), ("key",))), height)
    root = over[-1].select(F.col("node").alias("root"))  # one row
    ends = descend(over, height, over[-1].withColumns({"subroot": F.col("node"), "path": F.array().cast(PATH)}))
    out = descend(up, height, subroots.join(ends.select(F.col("key").alias("tree"), "path"), "tree")).crossJoin(F.broadcast(root))
    return out.select(F.col("key").alias("doc_id"), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source"), F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col("kept").getField(n).alias(n) for n in names))


def proof(path: Column) -> Column:
    """The siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give: the manifest's if neither the document nor the proof has changed."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.encode(F.concat(x["before"], node, x["after"]), "UTF-8"), 256))


def digest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: line ends are taken out of the texts of documents with even crc32(doc_id), then all are verified."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    own = manifest(docs, height, {"now": leaf_of(tampered)}).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return own.select("doc_id", "leaf", "subroot", "root", F.sha2(F.encode(proof(F.col("path")), "UTF-8"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(source_levels: int = 15, top_levels: int = 7) -> str:
    """Levels one by one: as many as 14 million documents a source and 2,000 sources need."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c, x) & 255, [0, 0, 0, 0, 0, 0, 0, 0]), lambda b, _: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)))"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    parts = [
        f"d AS MATERIALIZED (SELECT *, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)",
        f"x AS MATERIALIZED (SELECT doc_id, leaf, {leaf('changed')} AS now, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)",
    ]

    def tree(name: str, first: str, many: int) -> None:
        parts.append(f"{name}0 AS MATERIALIZED ({first})")
        for i in range(many):
            run = "PARTITION BY tree, idx // 3 ORDER BY idx ROWS BETWEEN"
            parts.append(f"{name}s{i} AS MATERIALIZED (SELECT tree, idx, node, n, CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i}))")
            parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, idx // 3 AS idx, CASE WHEN max(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node FROM {name}s{i} GROUP BY ALL)")

    tree("l", "SELECT tree, idx, leaf AS node FROM x", source_levels)
    tree("t", f"SELECT 0 AS tree, tree AS idx, node FROM l{source_levels}", top_levels)
    at = "p0 AS MATERIALIZED (SELECT *, now AS f, '' AS p FROM x)"
    for name, many, before in (("l", source_levels, 0), ("t", top_levels, source_levels)):
        for i in range(many):
            parts.append(at)
            place = "s.tree = q.tree AND s.idx = q.idx" if name == "l" else "s.idx = q.tree"
            place = place.replace("q.idx" if name == "l" else "q.tree", f"{'q.idx' if name == 'l' else 'q.tree'} // {3**i}")
            at = f"p{before + i + 1} AS MATERIALIZED (SELECT q.doc_id, q.leaf, q.tree, q.idx, CASE WHEN b IS NULL THEN f ELSE sha256(b || f || a) END AS f, CASE WHEN b IS NULL THEN p ELSE p || b || a END AS p FROM p{before + i} q JOIN {name}s{i} s ON {place})"
    parts.append(at)
    return f"WITH {', '.join(parts)} SELECT q.doc_id, q.leaf, l{source_levels}.node AS subroot, t{top_levels}.node AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t{top_levels}.node AS verified FROM p{source_levels + top_levels} q JOIN l{source_levels} ON l{source_levels}.tree = q.tree, t{top_levels}"


SQL = _sql()
