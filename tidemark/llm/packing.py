"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction."""

from __future__ import annotations

import os
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_of

CAPACITY = 2048
CACHE = 800_000  # chunks whose ids a Python worker keeps from task to task; more only cost time
GROUP_BYTES = 1 << 19  # texts that are looked up together; more cost memory, a hundred bytes or so each, and time
END = b" "
PUNCTUATION = string.punctuation.encode()
KNOWN: dict[str, dict] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks(dict):
    """Numbers of text chunks between ASCII white space, and the ids of each.

    The tokenizer lower-cases, drops white space and lets no token span it, so a text's ids are those of its chunks in turn.
    A run of ASCII punctuation at a chunk's end, after a letter, is always a token of its own, so such chunks are put together
    from two others. Each other chunk goes through the tokenizer once, and a text is then a few array lookups.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.word, self.word_id = self._parting()
        self.forget()

    def _parting(self) -> tuple[str | None, int]:
        """A long word that is one token, and its id."""
        for word in sorted((w for w in self.tokenizer.get_vocab() if w.isascii() and w.isalpha() and w.islower()), key=lambda w: (-len(w), w))[:50]:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            if len(ids) == 1:
                return word, ids[0]
        return None, -1

    def forget(self) -> None:
        self.clear()
        self[END] = 0  # stands after each text, as id 0
        self.new: list[bytes] = []
        self.bytes = 0  # of all chunks
        self.flat, self.starts, self.lengths = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number

    def learn(self) -> None:
        """Give the new chunks their ids."""
        asked = list(self.new)
        ends = [c.rstrip(PUNCTUATION) for c in asked]
        joined = [0 < len(e) < len(c) and e[-1:].isalpha() and b"<|" not in c for e, c in zip(ends, asked, strict=True)]
        parts = [(self[e], self[c[len(e) :]]) for e, c, j in zip(ends, asked, joined, strict=True) if j]  # may add new ones, which are never joined
        joined += [False] * (len(self.new) - len(joined))
        plain = [c.decode() for c, j in zip(self.new, joined, strict=True) if not j]
        got = [self.encoded(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]
        sizes = np.zeros(len(joined), np.int64)
        sizes[~np.array(joined, bool)] = np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, sizes])
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in got)])
        if parts:
            pairs = np.array(parts, np.int64)
            at = len(self.lengths) - len(joined) + np.flatnonzero(joined)
            self.lengths[at] = self.lengths[pairs].sum(axis=1)
            self.starts[at] = len(self.flat) + np.cumsum(self.lengths[at]) - self.lengths[at]
            self.flat = np.concatenate([self.flat, self.gather(pairs.ravel())])
        self.bytes += sum(map(len, self.new))
        self.new = []

    def encoded(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these chunks, and how many each has. They go through the tokenizer as one text, a word of one id between them; one by one if a chunk has that id too."""
        if self.word:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.word} ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            between = np.flatnonzero(ids == self.word_id)
            if len(between) == len(plain) - 1:
                return np.delete(ids, between), np.diff(np.r_[-1, between, len(ids)]) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids, then id 0."""
        if len(self) > CACHE:
            self.forget()
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]  # the names of special tokens heed case
        for c in chunks:
            c.append(END)
        counts = np.cumsum([len(c) for c in chunks])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts[-1]))
        if self.new:
            self.learn()
        ends = np.cumsum(self.lengths[numbers])[counts - 1]
        return np.split(self.gather(numbers), ends[:-1])


def text_groups(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit (GROUP_BYTES) bytes of text in column 1 each, or one row."""
    limit, at, size = limit or GROUP_BYTES, 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if i > at and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if len(batch):
        yield batch.slice(at)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and id 0, cut every capacity ids. Null text counts as empty: id 0 alone."""
    path = path or tokenizer_path()
    types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KNOWN.get(path) or KNOWN.setdefault(path, Chunks(path))
        for batch in batches:
            for group in text_groups(batch):
                rows: list[tuple] = []
                for doc_id, ids in zip(group.column(0).to_pylist(), known.ids(group.column(1).to_pylist()), strict=True):
                    data = ids.astype("<u4", copy=False)
                    for i, s in enumerate(range(0, len(ids), capacity)):
                        part = data[s : s + capacity]
                        rows.append((doc_id, i, s, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.encode(text_of(), "UTF-8")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # a sequence's lengths with how often each stands in it


def reduced(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Sequences that some best packing has, as far as Martello and Toth's dominance shows it; takes them out of counts (by length).

    A set with the piece j dominates every other feasible set with j if each of the other's pieces fits into a place that one
    of its own pieces leaves. For the longest first, with k the longest piece that fits beside j:
    nothing fits: {j}; j + k fills the sequence: {j, k}; two pieces never fit beside j: {j, k};
    three never fit and no pair that fits is longer than k: {j, k}.
    Equal pieces are fixed together, and passes go on until one fixes nothing.
    """
    fixed: list[tuple[Pattern, int]] = []

    def take(*parts: int, n: int) -> None:
        for x in parts:
            counts[x] -= n
        fixed.append((tuple((x, parts.count(x)) for x in dict.fromkeys(parts)), n))

    def smallest(j: int, many: int) -> list[int]:
        """The shortest pieces but one j."""
        out: list[int] = []
        for x in np.flatnonzero(counts)[: many + 1]:
            out += [int(x)] * min(int(counts[x]) - (x == j), many - len(out))
        return out

    def best_pair(j: int, room: int) -> int:
        """The largest total of two pieces, but one j, within room."""
        have = counts.copy()
        have[j] -= 1
        xs = np.flatnonzero(have)
        best, hi = 0, len(xs) - 1
        for lo in range(len(xs)):
            while hi >= lo and xs[lo] + xs[hi] > room:
                hi -= 1
            if hi < lo:
                break
            at = hi if hi > lo or have[xs[lo]] > 1 else -1
            best = max(best, int(xs[lo] + xs[at])) if at >= 0 else best
        return best

    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                room = capacity - j
                low = smallest(j, 3)
                if not low or low[0] > room:
                    take(j, n=int(counts[j]))
                    again = True
                    continue
                fits = np.flatnonzero(counts[: room + 1])
                k = int(fits[-1]) if not (fits[-1] == j and counts[j] == 1) else int(fits[-2])
                pairs_fit, triples_fit = len(low) > 1 and low[0] + low[1] <= room, len(low) > 2 and sum(low) <= room
                if k == room or not pairs_fit or (not triples_fit and best_pair(j, room) <= k):
                    take(j, k, n=int(counts[j] // 2 if j == k else min(counts[j], counts[k])))
                    again = True
                    continue
                break
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each piece into the fullest sequence that has room; equal pieces and equal sequences go together.

    The fullest sequence with room stays the fullest while it has room, so it takes room // length pieces before the next.
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    full = np.zeros(capacity + 1, bool)  # rooms that have sequences
    by_room[capacity] = [[(), None]]  # new ones, as many as needed
    full[capacity] = True

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            by_room[room].append([pattern, n])
            full[room] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = length + int(np.argmax(full[length:]))
            pattern, n = group = by_room[room][-1]
            each = room // length
            whole = left // each if n is None else min(n, left // each)
            rest = left - whole * each if whole != n else 0
            if n is not None:
                group[1] = n - whole - (rest > 0)
                if not group[1]:
                    by_room[room].pop()
                    full[room] = bool(by_room[room])
            put(room - each * length, (*pattern, (length, each)), whole)
            if rest:
                put(room - rest * length, (*pattern, (length, rest)), 1)
            left -= whole * each + rest
    return [(p, n) for room, groups in by_room.items() for p, n in groups if n and p]


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank among those of that length: runs of ranks with the first sequence,
    the places in each sequence and the offset of the first. The arrays are sorted by length and rank.

    A length splits at most one group and opens two, so there are at most 4 * capacity groups with fewer than
    sqrt(2 * capacity) lengths each: at most some 520,000 runs for 2,048 ids, however many pieces there are.
    """
    left = counts.astype(np.int64).copy()
    runs, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, n in reduced(left, capacity) + best_fit(left, capacity):
        offset = 0
        for length, each in pattern:
            runs.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    runs.sort()
    at = np.array(runs, np.int64).reshape(-1, 5)
    return {"key": (at[:, 0] << 44) + at[:, 1], "sequence": at[:, 2], "each": at[:, 3], "offset": at[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 4096) -> DataFrame:
    """Add sequence_id and offset to a frame with doc_id, piece and length (1 to capacity), which must be stable (a table or checkpoint).

    Only the counts of each length, capacity numbers at most, decide the packing, so the driver sees those alone. A piece's
    rank among those of its length then names its place. Ranks come from counts by (length, hash bucket) and a window inside
    each bucket: one very common length is spread over as many tasks as it needs.
    Repeated rows each get a place. No rows: no rows.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    where = spark.sparkContext.broadcast(plan(counts, capacity))
    buckets = min(1 << 16, max(1, int(counts.sum()) // bucket_rows))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    starts = dealt.groupBy("length", "_bucket").count()
    starts = starts.select("length", "_bucket", (F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_first"))
    ranked = dealt.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)

    names = list(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = where.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "_rank"))
            i = np.searchsorted(runs["key"], (length << 44) + rank, "right") - 1
            rank = rank - (runs["key"][i] & ((1 << 44) - 1))
            each = runs["each"][i]
            columns = [batch.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs["sequence"][i] + rank // each), pa.array(runs["offset"][i] + rank % each * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """pieces_of, then pack: one row per piece with its place. Empty and null texts have one piece, id 0."""
    return pack(cut(pieces_of(docs, capacity, path)), capacity)
