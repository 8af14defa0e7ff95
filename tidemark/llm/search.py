"""Vector search over shards: exact top-k by MaxScore, and approximate nearest neighbours by navigable small-world graphs."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS = 8192


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding of doubles of the rows that take part: without null or non-finite components, and with zero=False not all 0. Rows without
    vec_id don't take part. Of rows that share one the smallest vector counts."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    if not zero:
        own = own.where(F.exists("embedding", lambda x: x != 0))
    return own.groupBy("vec_id").agg(F.min("embedding").cast("array<double>").alias("embedding"))


def deal(own: DataFrame, every: int) -> tuple[DataFrame, DataFrame, int, int]:
    """own with a shard of some SHARD_ROWS rows each, the query rows, how many shards there are, and how many components at most."""
    n, width = own.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    return own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), own.where(F.col("vec_id") % every == 0), shards, width or 1


def past_shards(held: DataFrame, queries: DataFrame, shards: int, prepare: Callable[[pa.Table], Any], answer: Callable[[Any, pa.RecordBatch], list[tuple]], score: str) -> DataFrame:
    """query_id, vec_id, score: what answer gives for each batch of queries and what prepare makes of each shard's rows of held.

    A shard's rows go to one task once, and all queries follow them batch by batch, so a task has one shard and one batch in memory. Only queries are copied to each shard.
    """
    names = [c for c in held.columns if c not in ("shard", *queries.columns)]
    types = dict(held.dtypes)
    rows = held.select("shard", F.lit(False).alias("asks"), *(F.col(c) if c in held.columns else F.lit(None).cast(t).alias(c) for c, t in queries.dtypes), *names)
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", F.lit(True).alias("asks"), *queries.columns, *(F.lit(None).cast(types[c]).alias(c) for c in names))
    kind = {"long": pa.int64(), "double": pa.float64()}[score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        ready = None
        for batch in batches:
            shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks"))
            ends = [*(np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(shard)]
            for f, e in zip([0, *ends[:-1]], ends, strict=True):
                part = batch.slice(f, e - f)
                if e > f and not asks[f]:
                    if own and own[-1].column("shard")[0] != part.column("shard")[0]:
                        own = []
                    own, ready = [*own, part], None
                elif e > f and own and own[-1].column("shard")[0] == part.column("shard")[0]:
                    ready = ready or (prepare(pa.Table.from_batches(own)),)
                    found = answer(ready[0], part)
                    if found:
                        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, kind)], ["query_id", "vec_id", "score"])

    dealt = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def matrix(column: pa.ChunkedArray | pa.ListArray, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column as rows of width, missing components 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(ends), width), kind)
    row = np.repeat(np.arange(len(ends)), ends)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what the shards found."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def max_score(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k largest inner products with the query. postings: a row of values per term (component), 0 where a row lacks it.

    A term adds at most its bound to a score, max(0, q * largest, q * smallest). Terms go by falling bound. A few rows that lead after the first terms
    are scored in full; the k-th gives a first threshold. Terms are essential until the bounds of the rest add up to less than
    the threshold: their postings are traversed for all rows. The rest are probed, a few at a time, only for rows that can still
    reach the threshold.
    """
    terms = np.flatnonzero(query)
    bound = np.maximum(0, np.maximum(query[terms] * high[terms], query[terms] * low[terms]))
    order = np.argsort(-bound, kind="stable")
    terms, bound = terms[order], bound[order]
    rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # rest[i]: bounds of the terms from i on
    step = min(max(8, len(terms) // 4), len(terms))
    score = query[terms[:step]] @ postings[terms[:step]] if step else np.zeros(postings.shape[1])
    score[ids == own] = -np.inf
    threshold = -np.inf
    lead = np.argpartition(-score, min(4 * k, len(score)) - 1)[: 4 * k]
    lead = lead[ids[lead] != own]
    if len(lead) >= k:
        threshold = np.partition(query[terms] @ postings[np.ix_(terms, lead)], len(lead) - k)[len(lead) - k]
    essential = max(step, int(np.count_nonzero(rest[:-1] >= threshold)))
    score += query[terms[step:essential]] @ postings[terms[step:essential]]
    live = np.flatnonzero((score > -np.inf) & (score + rest[essential] >= threshold))
    score = score[live]
    for at in range(essential, len(terms), 8):
        score = score + query[terms[at : at + 8]] @ postings[np.ix_(terms[at : at + 8], live)]
        keep = score + rest[min(at + 8, len(terms))] >= threshold
        live, score = live[keep], score[keep]
    top = np.lexsort((ids[live], -score))[:k]
    return live[top], score[top]


def peaks(x: np.ndarray) -> np.ndarray:
    """The largest component of each row, by size."""
    return np.abs(x.astype(float)).max(axis=1)


def whole_scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with the query, cut to 64 bits."""
    if not len(x) or x.shape[1] * peaks(x).max() * peaks(query[None])[0] < 2.0**62:
        return x @ query
    ends = np.iinfo(np.int64)
    return np.array([min(max(s, ends.min), ends.max) for s in x.astype(object) @ query.astype(object)], np.int64)


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k other rows with the largest inner product of floor(scale * component).

    Rows are dealt to shards of a fixed size, all queries pass each shard and are answered with max_score; a window merges the shards' answers. A
    shorter vector lacks the further components, as if they were 0. See usable for the rows that take part. No rows: no rows. Scores are exact: by
    max_score in doubles for rows and queries whose sums stay within 2 ** 53, else by whole_scores in integers; floors and scores beyond 64 bits count
    as the largest or smallest 64-bit number.
    """
    own = usable(vectors, zero=True).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("embedding"))
    dealt, asked, shards, width = deal(cut(own), every)
    limit = math.isqrt(2**53 // width)

    def prepare(rows: pa.Table) -> tuple:
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), width, np.int64)
        small, large = (np.flatnonzero(k) for k in (peaks(x) <= limit, peaks(x) > limit))
        plain = x[small].astype(float)
        return ids, x, small, large, np.ascontiguousarray(plain.T), *((plain.max(axis=0), plain.min(axis=0)) if len(small) else (None, None))

    def answer(shard: tuple, queries: pa.RecordBatch) -> list[tuple]:
        ids, x, small, large, postings, high, low = shard
        names, q, found = ids[small], matrix(queries.column("embedding"), width, np.int64), []
        for own_id, query, peak in zip(queries.column("vec_id").to_pylist(), q, peaks(q).tolist(), strict=True):
            fits = peak <= limit and len(small) > 0
            at, score = max_score(postings, names, query.astype(float), own_id, k, high, low) if fits else (np.zeros(0, np.int64), np.zeros(0))
            at = names[at]
            if not fits or len(large):
                others = large if fits else np.arange(len(ids))
                others = others[ids[others] != own_id]
                at, score = np.concatenate([at, ids[others]]), np.concatenate([score.astype(np.int64), whole_scores(x[others], query)])
                top = np.lexsort((at, ~score))[:k]  # ~ turns the order around without overflow
                at, score = at[top], score[top]
            found.append((np.full(len(at), own_id), at, score.astype(np.int64)))
        return found

    return best(past_shards(dealt, asked, shards, prepare, answer, "long"), k)


EXACT_SQL = """
WITH v AS (SELECT vec_id, min([floor(256 * x::DOUBLE)::BIGINT for x in embedding]) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
e AS (SELECT vec_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, r.vec_id, sum(q.x * r.x)::BIGINT AS score FROM e q JOIN e r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""

# --- navigable small-world graphs ---

LINKS, NEAR, WIDTH, BEAM, SPARE = 20, 48, 40, 128, 8


def levels(ids: np.ndarray) -> np.ndarray:
    """Each node's level: geometric, from its hashed id."""
    from .words import mixed

    u = ((mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return np.floor(-np.log(u) / math.log(16)).astype(np.int64)


def chosen_links(v: np.ndarray, rows: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Links (from, to, choice) of the rows to some of their candidates near (nearest first, -1 for none; sims: their products).

    A candidate is chosen if it is nearer to the row than to all chosen so far, LINKS at most: so links lead in different directions. After those the
    nearest of the rest fill up half of LINKS, as later choice.
    """
    real = near >= 0
    c = np.where(real, near, 0)
    between = v[c] @ v[c].transpose(0, 2, 1)
    chosen = np.zeros(c.shape, bool)
    for j in range(c.shape[1]):
        blocked = (chosen[:, :j] & (between[:, j, :j] >= sims[:, j : j + 1])).any(axis=1)
        chosen[:, j] = real[:, j] & ~blocked & (chosen.sum(axis=1) < LINKS)
    few = real & ~chosen & (np.cumsum(real & ~chosen, axis=1) + chosen.sum(axis=1, keepdims=True) <= LINKS // 2)
    parts = []
    for choice, which in enumerate((chosen, few)):
        r, j = np.nonzero(which)
        parts.append(np.stack([rows[r], c[r, j], np.full_like(r, choice)], 1))
    return np.concatenate(parts)


def linked(v: np.ndarray, order: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Neighbours (rows of node numbers, -1 for none) of the nodes of one layer, of the vectors v.

    Nodes are put in by order, in batches that at most double the graph. Each node's candidates are the NEAR nearest that a search of the graph so
    far finds, from its entry if that is in the graph yet, and the nearest of its own batch. Links go both ways; a node keeps WIDTH, its first choices first, then the nearest.
    """
    n = len(v)
    out, choices = np.full((n, WIDTH + SPARE), -1, np.int32), np.full((n, WIDTH), 2, np.int8)
    done, placed = 0, np.zeros(n, bool)
    while done < n:
        batch = order[done : done + min(512, max(64, done))]
        own = v[batch] @ v[batch].T
        np.fill_diagonal(own, -np.inf)
        take = min(NEAR, len(batch) - 1)
        c = np.argpartition(-own, take - 1, axis=1)[:, :take] if take else np.zeros((len(batch), 0), np.int64)
        near, sims = batch[c], np.take_along_axis(own, c, 1)
        if done:
            enter = np.where(placed[entries[batch]], entries[batch], order[0])
            found, score = beam_search(v, out, enter, v[batch], NEAR)
            near, sims = np.concatenate([near, found], 1), np.concatenate([sims, score], 1)
        best_first = np.argsort(-sims, axis=1, kind="stable")[:, :NEAR]
        near, sims = np.take_along_axis(near, best_first, 1), np.take_along_axis(sims, best_first, 1)
        if near.shape[1]:
            p = chosen_links(v, batch, np.where(sims > -np.inf, near, -1), sims)
            back = p[p[:, 2] == 0][:, [1, 0, 2]] + [0, 0, 1]
            touched = np.unique(np.concatenate([p[:, 0], back[:, 0]]))
            r, j = np.nonzero(out[touched, :WIDTH] >= 0)
            held = np.stack([touched[r], out[touched[r], j], choices[touched[r], j]], 1)
            both = np.concatenate([held, p, back])
            sim = np.concatenate([np.einsum("ij,ij->i", v[x[:, 0]], v[x[:, 1]]) for x in np.array_split(both, len(both) // 200_000 + 1)])
            both = both[np.lexsort((-sim, both[:, 2], both[:, 0]))]
            _, first = np.unique(both[:, 0] * n + both[:, 1], return_index=True)
            both = both[np.sort(first)]
            place = np.arange(len(both)) - np.searchsorted(both[:, 0], both[:, 0])
            both, place = both[place < WIDTH], place[place < WIDTH]
            out[touched] = -1
            out[both[:, 0], place], choices[both[:, 0], place] = both[:, 1], both[:, 2]
        done += len(batch)
        placed[batch] = True
    return out


def reach(neighbours: np.ndarray, entry: int, seen: np.ndarray) -> None:
    """Mark in seen all nodes that links lead to from the entry."""
    front = np.array([entry])
    seen[entry] = True
    while len(front):
        to = np.unique(neighbours[front])
        front = to[(to >= 0) & ~seen[to]]
        seen[front] = True


def connect(v: np.ndarray, neighbours: np.ndarray, entry: int) -> None:
    """Give nodes that no walk from the entry reaches a link from the nearest node that one does and that has a place left, nearest pairs first."""
    seen = np.zeros(len(v), bool)
    reach(neighbours, entry, seen)
    lost, met = np.flatnonzero(~seen), np.flatnonzero(seen)
    near, sim = np.zeros(len(lost), np.int64), np.zeros(len(lost))
    for s in range(0, len(lost), 512):
        sims = v[lost[s : s + 512]] @ v[met].T
        near[s : s + 512], sim[s : s + 512] = met[sims.argmax(axis=1)], sims.max(axis=1)
    for i in np.argsort(-sim, kind="stable").tolist():
        if seen[lost[i]]:
            continue
        at = int(near[i])
        if neighbours[at, -1] >= 0:
            open_places = np.flatnonzero(seen & (neighbours[:, -1] < 0))
            at = int(open_places[np.argmax(v[open_places] @ v[lost[i]])])
        neighbours[at, int(np.argmax(neighbours[at] < 0))] = lost[i]
        reach(neighbours, int(lost[i]), seen)


def graph(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """The graph of one shard, as flat arrays: nodes' vectors, the rows of each node, and for each layer from the top its nodes and their neighbours.

    Equal vectors are one node. Vectors get one more component that gives all the same length, so that the largest inner product is the nearest vector.
    Nodes that a walk from the entry doesn't reach are linked from the nearest node that it does.
    """
    nodes, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.lexsort((ids, of))
    first = ids[order][np.searchsorted(of[order], np.arange(len(nodes)))]
    length = np.sqrt((nodes**2).sum(axis=1))
    unit = nodes / length.max()
    v = np.concatenate([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))], 1).astype(np.float32)
    first_ids = first
    level = levels(first)
    level[np.argmax(level)] = max(1, level.max())
    out = {"nodes": nodes, "ids": ids[order], "start": np.searchsorted(of[order], np.arange(len(nodes) + 1)), "tops": np.array([level.max()])}
    for k in range(int(level.max()), -1, -1):
        members = np.flatnonzero(level >= k)
        where = np.full(len(v), -1)
        where[members] = np.arange(len(members))
        # nodes of the layers above come first: they are where the others' searches enter
        above = descend(out | {"nodes": v}, v[members], k) if k < level.max() else np.full(len(members), members[0])
        first = np.lexsort((first_ids[members], level[members] <= k))
        entry = where[above] if k < level.max() else np.full(len(members), first[0])
        to = linked(v[members], first, entry)
        if k == 0:
            connect(v, to, int(np.argmax(level)))
        out[f"members{k}"], out[f"to{k}"] = members.astype(np.int32), np.where(to >= 0, members[to], -1).astype(np.int32)
    return out


def descend(g: dict[str, np.ndarray], queries: np.ndarray, bottom: int) -> np.ndarray:
    """The node of the layer over bottom at which each query's walk from the top ends: it goes on to its best neighbour while that is better."""
    nodes, q = g["nodes"].astype(np.float32), queries.astype(np.float32)
    top = int(g["tops"][0])
    at = np.full(len(q), g[f"members{top}"][0], np.int64)
    for k in range(top, bottom, -1):
        where = np.full(len(nodes), -1)
        where[g[f"members{k}"]] = np.arange(len(g[f"members{k}"]))
        to = g[f"to{k}"]
        score = np.einsum("ij,ij->i", nodes[at], q)
        moving = np.arange(len(q))
        while len(moving):
            near = to[where[at[moving]]]
            s = np.where(near >= 0, np.einsum("bwd,bd->bw", nodes[near], q[moving]), -np.inf)
            j = s.argmax(axis=1)
            best_s = s[np.arange(len(moving)), j]
            better = best_s > score[moving]
            moving, j, best_s, near = moving[better], j[better], best_s[better], near[better]
            at[moving], score[moving] = near[np.arange(len(moving)), j], best_s
    return at


def beam_search(nodes: np.ndarray, to: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The beam nodes (numbers, -1 for none) with the largest products that a search of one layer from the entries finds for each query, and these products.

    All queries walk together. Each keeps its beam best nodes and expands the best unexpanded ones, expand at a time, until all in its beam are expanded.
    """
    b, n = len(q), len(nodes)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no neighbour
    seen[:, n] = True
    found, score, done = np.full((b, beam), n), np.full((b, beam), -np.inf, np.float32), np.ones((b, beam), bool)
    found[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", nodes[entry], q), False
    seen[np.arange(b), entry] = True
    live = np.arange(b)
    while len(live):
        open_score = np.where(done[live], -np.inf, score[live])
        e = min(expand, beam)
        pick = np.argpartition(-open_score, e - 1, axis=1)[:, :e]
        real = np.take_along_axis(open_score, pick, 1) > -np.inf
        done[live[:, None], pick] = True
        near = np.where(real[:, :, None], to[np.where(real, found[live[:, None], pick], 0)], -1).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        r, c = np.nonzero(new)
        s = np.full(near.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", nodes[near[r, c]], q[live[r]])
        all_s = np.concatenate([score[live], s], 1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        all_f, all_d = np.concatenate([found[live], np.where(new, near, n)], 1), np.concatenate([done[live], ~new], 1)
        found[live], score[live], done[live] = (np.take_along_axis(z, keep, 1) for z in (all_f, all_s, all_d))
        live = live[(~done[live] & (score[live] > -np.inf)).any(axis=1)]
    return np.where(score > -np.inf, found, -1), score


def walk(g: dict[str, np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """The beam nodes (numbers, -1 for none) with the largest products that a search from the top layer finds for each query."""
    return beam_search(g["nodes"].astype(np.float32), g["to0"], descend(g, queries, 0), queries.astype(np.float32), beam)[0]


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_index(own: DataFrame, width: int) -> DataFrame:
    """shard, graph: the flat arrays of each shard's graph. own: vec_id, embedding, shard."""

    def build(rows: pa.Table) -> pa.Table:
        g = graph(rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), width))
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "graph": pa.array([pack_arrays(g)], pa.binary())})

    return own.groupBy("shard").applyInArrow(build, "shard int, graph binary")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k nearest other rows found, by inner product.

    Rows are dealt to shards of some SHARD_ROWS rows, and a task builds each shard's graph: a hierarchy of layers whose links lead to diverse near nodes, kept
    as flat neighbour arrays in a checkpointed table. All queries pass every shard, and a window merges the answers. The beam's
    vectors are scored anew in double precision. All rows with equal vectors are found together, up to k + 1 of them. A shorter vector lacks
    the further components, as if they were 0. See usable for the rows that take part. No rows: no rows.
    """
    dealt, asked, shards, width = deal(cut(usable(vectors, zero=False)), every)
    index = cut(build_index(dealt, width))

    def prepare(rows: pa.Table) -> tuple[dict, dict]:
        g = dict(np.load(io.BytesIO(rows.column("graph")[0].as_py())))
        return g, g | {"nodes": g["nodes"] / np.abs(g["nodes"]).max()}

    def answer(graphs: tuple[dict, dict], queries: pa.RecordBatch) -> list[tuple]:
        g, unit = graphs
        names, q, found = queries.column("vec_id").to_numpy(), matrix(queries.column("embedding"), width), []
        scale = np.abs(q).max(axis=1, keepdims=True)
        for s in range(0, len(q), 256):
            for own_id, query, at in zip(names[s : s + 256], q[s : s + 256], walk(unit, q[s : s + 256] / scale[s : s + 256], max(beam, k + 1)), strict=True):
                at = at[at >= 0]
                score = (g["nodes"][at] * query).sum(axis=1)
                first = g["start"][at]
                n = np.minimum(g["start"][at + 1] - first, k + 1)
                rows = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids, score = g["ids"][rows], np.repeat(score, n)
                ids, score = ids[ids != own_id], score[ids != own_id]
                top = np.lexsort((ids, -score))[:k]
                found.append((np.full(len(top), own_id), ids[top], score[top]))
        return found

    return best(past_shards(index, asked, shards, prepare, answer, "double"), k)
