"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, text_of, written
from .quality import held_out, sample_of_labels
from .words import CLASS, in_groups, words

#: The index has EXAMPLES labelled rows at most, with all terms of their whole texts.
EXAMPLES = 4000
BLOCK, NEIGHBOURS, LEADING = 32, 15, 64
#: How many examples of the usual mixture of labels each term counts as having besides its own.
SMOOTHING = 4.0
#: More than sums of weights can be off that are rounded to 32 bits.
ROUNDING = 1e-5


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash (signed) and count of each text's distinct terms: runs of letters and digits, or of other ASCII characters, A-Z lower-cased."""
    h, n = words([t.lower() for t in texts], CLASS)
    row = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first].view(np.int64), np.diff(np.append(first, len(h)))


def association(ones: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """How much terms tell about the label: the squared difference between the log-odds of label 1 among the n examples that have the term, ones of
    them with label 1, and among all, smoothed. A term that no example has tells nothing: 0."""
    has = (ones + SMOOTHING * share) / (n + SMOOTHING)
    return (np.log(has / (1 - has)) - np.log(share / (1 - share))) ** 2


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


@dataclass
class Index:
    """Postings by term in blocks of BLOCK examples, each with its largest weight, as flat arrays.

    Term t has the blocks [first[t], first[t + 1]); each has its number block, its largest weight most, and the postings [start, next start). Example i has the
    terms own_term and their weights at [limit[i], limit[i + 1]). Weights in postings and blocks are rounded to 32 bits: they only tell which examples can be near.
    """

    terms: np.ndarray  # hashes, rising
    factor: np.ndarray  # inverse document frequency times association
    doc_id: np.ndarray
    label: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    limit: np.ndarray
    own_term: np.ndarray
    own_weight: np.ndarray
    share: float  # of label 1 among the examples
    scale: tuple[float, float] = (0.0, 0.0)
    query: np.ndarray | None = None  # one query's weights, by term

    def nearest(self, t: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The NEIGHBOURS examples of the largest cosines over 0 with the terms t of weights w (of length 1 together), ties to the smaller doc_id, and their cosines.

        The postings of the LEADING heaviest terms are summed for all examples. What the other terms add to an example is at most its block's bound, the sum of
        query weight times the block's largest weight. The examples that lead so far are scored in full, by their own terms; then all that can still reach the least of these.
        """
        order = np.argsort(-w, kind="stable")
        heavy, light = order[:LEADING], order[LEADING:]
        entry, n = self.first[t[heavy]], self.start[self.first[t[heavy] + 1]] - self.start[self.first[t[heavy]]]
        at = ranges(self.start[entry], n)
        sums = np.bincount(self.example[at], np.repeat(w[heavy], n) * self.weight[at], len(self.label))
        n = self.first[t[light] + 1] - self.first[t[light]]
        entry = ranges(self.first[t[light]], n)
        bound = np.bincount(self.block[entry], np.repeat(w[light], n) * self.most[entry], -(-len(self.label) // BLOCK))
        most = sums + np.repeat(bound, BLOCK)[: len(sums)]
        if but >= 0:
            sums[but] = most[but] = -1
        lead = np.argpartition(sums, -NEIGHBOURS)[-NEIGHBOURS:] if len(sums) > NEIGHBOURS else np.arange(0)
        least = self.cosines(t, w, lead[sums[lead] >= 0]).min() if len(lead) else 0.0
        found = np.flatnonzero((most >= least - ROUNDING) & (most > 0))
        cosine = self.cosines(t, w, found)
        best = np.lexsort((self.doc_id[found], -cosine))[:NEIGHBOURS]
        best = best[cosine[best] > 0]
        return found[best], cosine[best]

    def cosines(self, t: np.ndarray, w: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """The cosines of some examples with the terms t of weights w."""
        if self.query is None:
            self.query = np.zeros(len(self.terms))
        self.query[t] = w
        n = self.limit[examples + 1] - self.limit[examples]
        at = ranges(self.limit[examples], n)
        out = np.bincount(np.repeat(np.arange(len(examples)), n), self.query[self.own_term[at]] * self.own_weight[at], len(examples))
        self.query[t] = 0
        return out

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """The share of label 1 among the neighbours, each by its cosine, with one neighbour's worth of the share among all."""
        return float((cosine @ self.label[found] + self.share) / (cosine.sum() + 1))

    def calibrated(self, vote: float) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-(a * vote + b))))


def unit(w: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Weights of rows, each row's of length 1 together."""
    length = np.sqrt(np.bincount(row, w * w, rows))
    return w / np.where(length > 0, length, 1)[row]


def build(terms: np.ndarray, idf: np.ndarray, doc_id: np.ndarray, label: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> Index:
    """An index of examples. row, term (its number) and count: what terms each example has.

    Weights are (1 + log count) * idf * association. Examples are numbered by their heaviest term, so that those alike share blocks. A logistic curve calibrates
    the votes that the examples get from the others; there each example's own label is taken out of its terms' association, as
    a new text's label isn't in it either.
    """
    share = (label.sum() + 0.5) / (len(label) + 1)
    have, ones = np.bincount(term, minlength=len(terms)), np.bincount(term, label[row], len(terms))
    factor = idf * association(ones, have, share)
    tf = 1 + np.log(count)
    weight = unit(tf * factor[term], row, len(label))
    heaviest = np.full(len(label), -1)
    order = np.lexsort((term, weight, row))
    heaviest[row[order]] = term[order]  # the last of a row's assignments holds
    order = np.lexsort((doc_id, heaviest))
    place = np.argsort(order)
    doc_id, label, row = doc_id[order], label[order].astype(float), place[row]
    order = np.lexsort((row, term))
    t, e, w = term[order], row[order], weight[order]
    start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (e[1:] // BLOCK != e[:-1] // BLOCK)])) if len(t) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(w, start) if len(t) else np.zeros(0)
    by_row = np.argsort(row, kind="stable")
    limit = np.searchsorted(row[by_row], np.arange(len(label) + 1))
    small = [x.astype(np.int32) for x in (np.searchsorted(t[start], np.arange(len(terms) + 1)), np.append(start, len(t)), term[by_row])]
    index = Index(terms, factor, doc_id, label, small[0], (e[start] // BLOCK).astype(np.int16), most.astype(np.float32), small[1], e.astype(np.int16), w.astype(np.float32), limit, small[2], weight[by_row], float(share))
    own = label[row]
    w = unit(tf * idf[term] * association(ones[term] - own, have[term] - 1, share), row, len(label))
    parts = np.split(by_row, limit[1:-1]) if len(label) else []
    votes = [index.vote(*index.nearest(term[at], w[at], but=i)) for i, at in enumerate(parts)]
    if len(set(label.tolist())) == 2:
        index.scale = logistic(np.array(votes), label)
    elif len(label):
        index.scale = (4.0, -2.0)
    return index


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a x + b))), by Newton steps towards targets drawn in a little, as few examples are never certain."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    m, c = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -35, 35)))
        c = c + np.clip(np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), m.T @ (goal - p) - 1e-3 * c), -3, 3)
    return float(c[0]), float(c[1])


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, and terms and counts as arrays, of each text."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in in_groups(texts):
                row, h, n = term_counts(texts[a:b])
                offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(n))], [*keep, "terms", "counts"])

    return docs.select(*keep, F.encode(text_of(), "UTF-8").alias("_text")).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", terms array<long>, counts array<long>")


def known_terms(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's place among the terms, and whether it is one."""
    at = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
    return at, (terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool))


def document_counts(docs: DataFrame, terms: np.ndarray, parts: int = 16) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each of the terms: over all documents, counted in each task and summed part by part of the terms."""
    known = docs.sparkSession.sparkContext.broadcast(terms)
    limits = [len(terms) * i // parts for i in range(parts + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(known.value), np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for a, b in in_groups(texts):
                at, is_one = known_terms(known.value, term_counts(texts[a:b])[1])
                total += np.bincount(at[is_one], minlength=len(total))
        for i in range(parts):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n]), pa.array([zlib.compress(total[limits[i] : limits[i + 1]].tobytes(), 1)], pa.binary())], ["part", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                n, counts = found.get(r["part"], (0, 0))
                found[r["part"]] = n + r["n"], counts + np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        for i, (n, counts) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n]), pa.array([counts.tobytes()], pa.binary())], ["part", "n", "counts"])

    schema = "part int, n long, counts binary"
    sent = docs.select(F.encode(text_of(), "UTF-8")).mapInArrow(count, schema)
    out, n = np.zeros(len(terms), np.int64), 0
    for i, n, counts in sent.repartition(min(parts, parallelism(docs.sparkSession)), "part").mapInArrow(add, schema).collect():  # parts rows
        out[limits[i] : limits[i + 1]] = np.frombuffer(counts, np.int64)
    known.destroy()
    return n, out


def packed_index(index: Index) -> bytes:
    return zlib.compress(pickle.dumps(index), 1)


def index_of(packed: bytes) -> Index:
    return pickle.loads(zlib.decompress(packed))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0) -> bytes:
    """The index of a bounded sample of labelled rows, with all terms of their whole texts, as bytes (see index_of).

    Inverse document frequencies count all documents. With those alone the chance overlap of long texts outweighs the few words that matter, so a term's weight heeds
    how much it tells about the label too (see association). The driver gets the terms and, from the one task that builds it, the index.
    """
    sample = sample_of_labels(labels, label, ~held_out(parts, held), EXAMPLES)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("y").cast("long").alias("y"), F.max("text").alias("text"))
    rows = written(counted(chosen, "doc_id", "y"))
    terms = np.sort(rows.select(F.explode("terms").alias("term")).distinct().toArrow().column("term").to_numpy())
    total, counts = document_counts(docs, terms)
    known = docs.sparkSession.sparkContext.broadcast((terms, np.log((total + 1) / np.maximum(counts, 1))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("doc_id").combine_chunks()
        lists = t.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        values = [t.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "counts")]
        own = build(*known.value, t.column("doc_id").to_numpy(), t.column("y").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(known.value[0], values[0]), values[1])
        yield pa.RecordBatch.from_arrays([pa.array([packed_index(own)], pa.binary())], ["index"])

    made = rows.repartition(1).mapInArrow(index, "index binary").first() if len(rows.take(1)) else None  # EXAMPLES rows at most
    known.destroy()
    none = np.zeros(0, np.int64)
    return bytes(made["index"]) if made else packed_index(build(none, np.zeros(0), none, none, none, none, none))


def score(docs: DataFrame, index: bytes) -> DataFrame:
    """docs with score (0 to 1), neighbours (doc_ids of the examples, nearest first) and cosines added. A text that shares no term that tells anything
    with an example, empty and null ones too, has no neighbours and the score of a vote without any."""
    known = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, neighbours array<long>, cosines array<double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = index_of(known.value)
        for texts in batches:
            yield pd.DataFrame(judged(texts.tolist(), own), columns=["score", "neighbours", "cosines"])

    def judged(items: list[bytes], own: Index) -> list[tuple]:
        out: list[tuple] = []
        seen: dict[bytes, tuple] = {}
        for a, b in in_groups(items):
            row, h, n = term_counts(items[a:b])
            at, is_one = known_terms(own.terms, h)
            row, t = row[is_one], at[is_one]
            w = unit((1 + np.log(n[is_one])) * own.factor[t], row, b - a)
            row, t, w = row[w > 0], t[w > 0], w[w > 0]
            limits = np.searchsorted(row, np.arange(b - a + 1)).tolist()
            for s, e in zip(limits[:-1], limits[1:], strict=True):
                key = t[s:e].tobytes() + w[s:e].tobytes()
                if key not in seen:
                    found, cosine = own.nearest(t[s:e], w[s:e])
                    seen[key] = own.calibrated(own.vote(found, cosine)), own.doc_id[found].tolist(), cosine.tolist()
                out.append(seen[key])
        return out

    return docs.withColumn("_judged", judge(F.encode(text_of(), "UTF-8"))).select(*docs.columns, "_judged.score", "_judged.neighbours", "_judged.cosines")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5), neighbours and cosines of each document.

    Labels are learnt only from rows whose crc32(doc_id as text) modulo parts is not held; a null doc_id is not held out and has no
    label. Without any labelled row all scores are 0.5. Repeated rows get equal scores.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label, parts, held))
    return scored.select("doc_id", F.coalesce(held_out(parts, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")
