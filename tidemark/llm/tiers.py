"""Packing into windows of several context sizes: routed to tiers, each tier packed, long windows filled from shorter ones, steps balanced.

Each piece (a document's whole sequences are cut off first) is routed to the smallest window that it fills, or in which it
leaves a gap worth filling. The longest pieces open windows; the shortest ones, just as many tokens as the gaps of those
windows have, fill them: whole where they fit, then cut. So windows are full, whatever their size, and few documents are cut.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, written
from .packing import CACHE, Chunks, text_groups

TIERS = (256, 512, 1024, 2048)
LEAST_GAP = 16  # a smaller gap isn't left to be filled; in the longest window it stays as padding
STEP_TOKENS = 64 * 2048
END_ID = 1
CACHE_BYTES = 64 << 20
KNOWN: dict[tuple, ByteChunks] = {}

#: UTF-8 of white space that isn't ASCII.
WIDE_WHITE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
HAS_WIDE_WHITE = re.compile(WIDE_WHITE)
#: In turn: letters that end in an ASCII one, and a run of ASCII digits and punctuation before an ASCII letter or white space (an
#: apostrophe may belong to the letters behind it), each with the one space before it; other words; white space up to such
#: a space; a single other white space before a word; longer white space that ends otherwise, with its word; white space at
#: the end. A byte-level tokenizer gives each of these the ids that it has in the text.
CHUNK = re.compile(rb" ?[A-Za-z\x80-\xff]++(?<=[A-Za-z])| ?[^\sA-Za-z\x80-\xff']++(?![\x80-\xff'])| ?\S+|\s+(?= \S)|\s(?=\S)|\s+\S+|\s+")
#: For other texts: chunks start at each space that no white space precedes.
LONG_CHUNK = re.compile(rb"(?: [^ ]*|[^ ]+)(?:(?:(?<=\s)|%b) [^ ]*)*" % b"|".join(b"(?<=" + w + b")" for w in WIDE_WHITE.split(b"|")))
END = b"\xff"  # in no UTF-8 text


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteChunks(Chunks):
    """As Chunks, for a byte-level tokenizer that puts a space before a word into the word's token and keeps case."""

    def __init__(self, path: str, end_id: int = END_ID):
        self.end_id = end_id
        super().__init__(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _parting(self) -> tuple[None, int]:
        """None: spaces around a word would become parts of tokens here, so chunks go through the tokenizer one by one."""
        return None, -1

    def chunks(self, text: bytes) -> list[bytes]:
        plain = (text.isascii() or not HAS_WIDE_WHITE.search(text)) and not any(s in text for s in self.special)
        return (CHUNK if plain else LONG_CHUNK).findall(text)

    def forget(self) -> None:
        super().forget()
        self.clear()
        self[END], self.flat = 0, np.array([self.end_id], np.uint32)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids, then the end's."""
        if len(self) > CACHE or self.bytes > CACHE_BYTES:
            self.forget()
        chunks = [[*self.chunks(t), END] for t in texts]
        counts = np.cumsum([len(c) for c in chunks])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts[-1]))
        if self.new:
            self.learn()
        ends = np.cumsum(self.lengths[numbers])[counts - 1]
        return np.split(self.gather(numbers), ends[:-1])


PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces_of(docs: DataFrame, capacity: int = TIERS[-1], path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens, ids: each text's ids and the end's, cut every capacity ids. Null text counts as empty.

    row is a different number for each piece; doc_tokens counts the end. ids (of two bytes each, of four for large vocabularies)
    are kept for pieces below the capacity alone, as only those can be cut again.
    """
    path = path or tokenizer_path()
    names, types = zip(*(f.split() for f in PIECES.split(", ")), strict=True)
    arrow = [pa.binary() if t == "binary" else pa.int64() for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KNOWN.get((path, end_id)) or KNOWN.setdefault((path, end_id), ByteChunks(path, end_id))
        kept = id_type(known.tokenizer.get_vocab_size())
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for group in text_groups(batch):
                rows: list[tuple] = []
                for doc_id, ids in zip(group.column(0).to_pylist(), known.ids(group.column(1).to_pylist()), strict=True):
                    data = ids.astype("<u4", copy=False)
                    for s in range(0, len(ids), capacity):
                        part = data[s : s + capacity]
                        rows.append((number, doc_id, s, len(part), zlib.crc32(part), len(ids), part.astype(kept).tobytes() if len(part) < capacity else None))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), F.encode(text_of(), "UTF-8")).mapInArrow(run, PIECES)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def route(length: int, tiers: Sequence[int], least_gap: int) -> int:
    """The smallest tier that a piece fills or leaves a gap of at least least_gap in; else the longest."""
    return next((t for t in tiers if t == length or t - length >= least_gap), tiers[-1])


def openers(counts: np.ndarray, tiers: Sequence[int], least_gap: int) -> tuple[np.ndarray, int]:
    """How many pieces of each length open a window, the longest first, while the rest have tokens for all their gaps; and how many tokens those have too many."""
    own, left = np.zeros_like(counts), int((counts * np.arange(len(counts))).sum())
    for length in range(len(counts) - 1, 0, -1):
        window = route(length, tiers, least_gap)
        step = window if window - length >= least_gap else length
        own[length] = min(int(counts[length]), left // step)
        left -= int(own[length]) * step
        if own[length] < counts[length]:
            break
    return own, left


Windows = tuple[int, tuple[tuple[int, int], ...], int, int]  # tier, lengths with how often each stands in it, how many such windows, and the room left in each


def best_fill(left: np.ndarray, room: int, least_gap: int) -> tuple[int, int]:
    """Lengths to put into a room: one that closes it, two that do, or the longest that leaves at least least_gap; 0 stands for none."""
    if left[room] and room:
        return room, 0
    pairs = np.flatnonzero((left[1:room] > 0) & (left[1:room][::-1] > 0)) + 1
    pairs = pairs[pairs * 2 >= room]
    if len(pairs) and pairs[0] * 2 == room and left[pairs[0]] < 2:
        pairs = pairs[1:]
    if len(pairs):
        return int(pairs[-1]), room - int(pairs[-1])
    fits = np.flatnonzero(left[: max(room - least_gap, 0) + 1])
    return (int(fits[-1]) if len(fits) else 0), 0


def filled(own: np.ndarray, left: np.ndarray, tiers: Sequence[int], least_gap: int) -> list[Windows]:
    """Windows with the pieces that open them and whole shorter pieces, which are taken out of left (counts by length).

    The largest gaps come first. Equal windows are filled together: a step ends a group or a length, so there are at most some 3 * capacity groups.
    """
    by_room: dict[int, list[tuple]] = defaultdict(list)
    done: list[Windows] = []
    for length in np.flatnonzero(own).tolist():
        tier = route(length, tiers, least_gap)
        by_room[tier - length if tier - length >= least_gap else 0].append((tier, ((length, 1),), int(own[length])))
    for room in range(tiers[-1], -1, -1):
        work = by_room.pop(room, [])
        while work:
            tier, pattern, n = work.pop()
            x, y = best_fill(left, room, least_gap)
            if not x:
                done.append((tier, pattern, n, room))
                continue
            if y and y != x:
                added, many = ((x, 1), (y, 1)), min(n, int(left[x]), int(left[y]))
                left[y] -= many
                left[x] -= many
            else:
                each = 2 if y else min(max(room // x - (0 < room % x < least_gap), 1), int(left[x]))
                added, many = ((x, each),), min(n, int(left[x]) // each)
                left[x] -= many * each
            by_room[room - sum(length * each for length, each in added)].append((tier, pattern + added, many))
            if many < n:
                work.append((tier, pattern, n - many))
    return done


def plan(counts: np.ndarray, tiers: Sequence[int] = TIERS, least_gap: int = LEAST_GAP, step_tokens: int = STEP_TOKENS) -> dict[str, np.ndarray]:
    """Where pieces go, by length and their rank among those of that length, as arrays that hold runs of ranks.

    whole_*: pieces that stay whole, by (length, rank). Those of higher ranks follow each other on a line, the longest first
    (line_first, line_at: by length), and gap_* are the gaps in turn, on the same line; what is left over fills windows
    of a power of two each. Nothing here grows with the number of pieces.
    """
    capacity, left = tiers[-1], counts.astype(np.int64).copy()
    own, over = openers(left, tiers, least_gap)
    left -= own
    groups = filled(own, left, tiers, least_gap)
    groups += [(1 << i, (), 1, 1 << i) for i in range(capacity.bit_length()) if over >> i & 1]
    # by tier, then with the most costly first: the longest piece of a window makes up most of its attention
    groups.sort(key=lambda g: (bool(g[1]), g[0], g[1]), reverse=True)
    whole, gaps, firsts, used, sequence, line = [], [], [], np.zeros(capacity + 1, np.int64), 0, 0
    tail = sum(n for _, pattern, n, _ in groups if pattern)
    for tier, pattern, n, room in groups:
        offset = 0
        for length, each in pattern:
            whole.append((length << 44 | int(used[length]), sequence, each, offset))
            used[length] += n * each
            offset += length * each
        if room:
            gaps.append((line, room, sequence, offset))
            line += room * n
        firsts.append((sequence, tier))
        sequence += n
    line_at = np.cumsum((left * np.arange(capacity + 1))[::-1])[::-1] - left * np.arange(capacity + 1)
    out = {f"whole_{k}": v for k, v in zip(("key", "sequence", "each", "offset"), np.array(sorted(whole), np.int64).reshape(-1, 4).T, strict=True)}
    out |= {f"gap_{k}": v for k, v in zip(("at", "room", "sequence", "offset"), np.array(gaps, np.int64).reshape(-1, 4).T, strict=True)}
    first, tier = np.array(firsts, np.int64).reshape(-1, 2).T
    return out | {"line_first": used, "line_at": line_at, "line_left": left} | steps(first, tier, sequence, tail, step_tokens)


def steps(first: np.ndarray, tier: np.ndarray, total: int, tail: int, step_tokens: int) -> dict[str, np.ndarray]:
    """Training steps of one window size each: sequences of a tier, which come by falling cost, are dealt to its steps to and fro. Those from tail on share the last step."""
    packed, of = first[first < tail], tier[first < tail]
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    starts = packed[cuts]
    many = -(-np.diff(starts, append=tail) * of[cuts] // step_tokens)
    if tail < total:
        starts, many = np.append(starts, tail), np.append(many, 1)
    return {"tier_first": first, "tier": tier, "part_first": starts, "part_steps": many, "part_step": np.cumsum(many) - many}


def step_of(sequence: np.ndarray, runs: dict[str, np.ndarray]) -> np.ndarray:
    part = np.searchsorted(runs["part_first"], sequence, "right") - 1
    turn, place = np.divmod(sequence - runs["part_first"][part], runs["part_steps"][part])
    return runs["part_step"][part] + np.where(turn % 2 == 0, place, runs["part_steps"][part] - 1 - place)


def pack(pieces: DataFrame, tiers: Sequence[int] = TIERS, least_gap: int = LEAST_GAP, step_tokens: int = STEP_TOKENS, kept: str = "<u2", bucket_rows: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step, from a table as pieces_of gives it, which must be stable.

    Only counts by length, at most capacity numbers, decide the packing and reach the driver. A piece's rank among those of
    its length names its place. Ranks come from counts by length and hash bucket, of bucket_rows rows or so each, and a
    window in each bucket, so a common length is spread over as many tasks as it needs. Only ids of lengths of which some
    are cut are shuffled.
    """
    spark, capacity = pieces.sparkSession, tiers[-1]
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    runs = plan(counts, tiers, least_gap, step_tokens)
    where = spark.sparkContext.broadcast(runs)
    buckets = spark.createDataFrame([(int(i), int(counts[i] // bucket_rows + 1)) for i in np.flatnonzero(counts)], "length long, _buckets long")
    cut_lengths = np.flatnonzero(runs["line_left"]).tolist()
    own = pieces.withColumn("ids", F.when(F.col("length").isin(cut_lengths), F.col("ids"))) if cut_lengths else pieces.withColumn("ids", F.lit(None).cast("binary"))
    dealt = own.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("row"), "_buckets"))  # at most capacity rows
    starts = dealt.groupBy("length", "_bucket").count()
    starts = starts.select("length", "_bucket", (F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_first"))
    ranked = dealt.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.row_number().over(W.partitionBy("length", "_bucket").orderBy("row")) - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]) + ", tier int, step long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = where.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "_rank"))
            is_whole = rank < runs["line_first"][length]
            stay = batch.filter(pa.array(is_whole)).select(names)
            at, nth = length[is_whole], rank[is_whole]
            i = np.searchsorted(runs["whole_key"], (at << 44) + nth, "right") - 1
            nth = nth - (runs["whole_key"][i] & ((1 << 44) - 1))
            each = runs["whole_each"][i]
            yield out(stay.columns, runs["whole_sequence"][i] + nth // each, runs["whole_offset"][i] + nth % each * at)
            rows = batch.filter(pa.array(~is_whole))
            if len(rows):
                parts = [p for row, n in zip(rows.to_pylist(), rank[~is_whole].tolist(), strict=True) for p in cut_up(row, n, runs)]
                columns = list(zip(*parts, strict=True))
                yield out([pa.array(c, pa.int64()) for c in columns[:5]], np.array(columns[5]), np.array(columns[6]))

    def cut_up(row: dict, rank: int, runs: dict[str, np.ndarray]) -> Iterator[tuple]:
        """The parts of a piece on the line, one for each gap that it meets."""
        ids = np.frombuffer(row["ids"], kept).astype("<u4")
        begin = int(runs["line_at"][row["length"]]) + (rank - int(runs["line_first"][row["length"]])) * row["length"]
        done = 0
        while done < len(ids):
            i = int(np.searchsorted(runs["gap_at"], begin + done, "right")) - 1
            nth, inside = divmod(begin + done - int(runs["gap_at"][i]), int(runs["gap_room"][i]))
            part = ids[done : done + int(runs["gap_room"][i]) - inside]
            yield row["doc_id"], row["start"] + done, len(part), zlib.crc32(part), row["doc_tokens"], int(runs["gap_sequence"][i]) + nth, int(runs["gap_offset"][i]) + inside
            done += len(part)

    def out(columns: list, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        runs = where.value
        tier = runs["tier"][np.searchsorted(runs["tier_first"], sequence, "right") - 1]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()), pa.array(step_of(sequence, runs), pa.int64())], [*names, "sequence_id", "offset", "tier", "step"])

    return ranked.select(*names, "ids", "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tiers: Sequence[int] = TIERS, least_gap: int = LEAST_GAP, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its place, the size of its window (tier) and the training step whose windows are all of that size.

    tiers: powers of two, rising. A document's whole windows of the longest tier stand alone, its rest is packed. Empty and null
    texts have one piece, the end's id. Repeated rows each get their places. Other columns of docs don't matter. No rows: no rows.
    Sequences are full but for gaps under least_gap in windows of the longest tier. The pieces' ids are written once to the
    checkpoint folder, so that texts are tokenized once.
    """
    from tokenizers import Tokenizer

    path = path or tokenizer_path()
    kept = id_type(Tokenizer.from_file(path).get_vocab_size())
    return pack(written(pieces_of(docs, tiers[-1], path, end_id)), tiers, least_gap, kept=kept)
