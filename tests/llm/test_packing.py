import itertools
import random
import zlib

import numpy as np
import pytest
from conftest_rows import rows

from tidemark.llm import packing

SF = "/root/testdata/sf0.001"


def brute_pieces(docs, capacity):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(packing.tokenizer_path()), []
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(d, i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def check_places(packed, capacity):
    """No gaps, no overlaps, nothing over the capacity; returns how many sequences there are."""
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 7])
def test_pieces_and_places(awkward, clashing, capacity):
    want = brute_pieces([r[:2] for r in rows()], capacity)
    for df in (awkward, clashing):
        got = packing.pack_documents(df, capacity).collect()
        assert sorted((tuple(r[:5]) for r in got), key=repr) == want
        assert check_places(got, capacity) >= -(-sum(r.length for r in got) // capacity)


def test_ids_of_odd_texts():
    """Chunks put together give what the tokenizer gives for the whole text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    random.seed(3)
    alphabet = ["a", "B", "zz", "The", "the", ".", ",", "...", "'s", "don't", "!?", "\"", "(", ")", "<|", "|>", "<|endoftext|>", "é", "É", "ß", "İ", "あ", "\U0001f600", " ", " ", "​", "1", "23", "_", "-", " ", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\x00", "é", "ﬁ"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(3000)]
    got = packing.Chunks(packing.tokenizer_path()).ids([t.encode() for t in texts])
    wrong = [t for t, ids in zip(texts, got, strict=True) if ids.tolist() != [*tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    assert not wrong, wrong[:5]


def least_sequences(lengths, capacity):
    """The best packing, by trying all."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(room)
            go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_reduction_keeps_a_best_packing():
    random.seed(7)
    for _ in range(150):
        capacity = random.randint(5, 20)
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        left = counts.copy()
        fixed = packing.reduced(left, capacity)
        used = np.zeros(capacity + 1, np.int64)
        for pattern, n in fixed:
            assert sum(x * m for x, m in pattern) <= capacity
            for x, m in pattern:
                used[x] += m * n
        assert (used + left == counts).all()
        rest = list(itertools.chain.from_iterable([x] * int(n) for x, n in enumerate(left)))
        assert sum(n for _, n in fixed) + least_sequences(rest, capacity) == least_sequences(lengths, capacity)
        total = sum(n for _, n in fixed) + sum(n for _, n in packing.best_fit(left, capacity))
        assert total <= least_sequences(lengths, capacity) * 1.5 + 1


def test_one_common_length_and_repeated_rows(spark):
    df = spark.range(20_000).selectExpr("id % 10000 AS doc_id", "0 AS piece", "IF(id % 3 = 0, 700, 1 + id % 50) AS length")
    df = df.selectExpr("doc_id", "CAST(piece AS int) piece", "CAST(length AS long) length")
    got = packing.pack(df, 2048, bucket_rows=512).collect()
    assert len(got) == 20_000
    assert len({(r.sequence_id, r.offset) for r in got}) == 20_000
    n = check_places(got, 2048)
    assert n <= 1.01 * sum(r.length for r in got) / 2048 + 1 or n <= sum(r.length == 700 for r in got) / 2 + 1


def test_no_rows(none):
    assert packing.pack_documents(none).count() == 0


def test_query(spark):
    from tidemark.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op2_pack_sequences"](spark, SF).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == brute_pieces(docs, 2048)
    assert check_places(got, 2048) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_texts_are_looked_up_in_small_groups():
    import pyarrow as pa

    texts = [b"", b"a" * 600_000, b"", *[b"b c " * 1000] * 1000, b"d" * 400_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 2)), pa.array([b"x", b"y", *texts], pa.binary())], ["doc_id", "text"]).slice(2)
    groups = list(packing.text_groups(batch))
    assert [(i, t) for g in groups for i, t in zip(g.column(0).to_pylist(), g.column(1).to_pylist(), strict=True)] == list(enumerate(texts, 2))
    assert all(len(g) == 1 or sum(map(len, g.column(1).to_pylist())) <= 1 << 19 for g in groups)
    assert len(groups) < 14
    assert list(packing.text_groups(batch.slice(0, 0))) == []


def test_known_chunks_count_their_bytes():
    known = packing.Chunks(packing.tokenizer_path())
    known.ids([b"one two, two,", b"three"])
    assert known.bytes == len(b"one" + b"two," + b"two" + b"," + b"three")


def test_new_chunks_go_through_the_tokenizer_as_one_text():
    known = packing.Chunks(packing.tokenizer_path())
    plain = ["word", "it's", "x" * 60, "été", "áb", "́", "　wide　", "日本語", "12,5%", "<|", "a<|b|>", "​", "﻿", "\U0001f600ok"]
    for chunks, calls in ((plain, 1), ([*plain, known.word, "end"], 2), ([known.word], 2), (["one"], 1)):
        each = [known.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]
        seen, own = [], known.tokenizer

        class Counting:
            def encode_batch_fast(self, texts, **kw):
                seen.append(len(texts))
                return own.encode_batch_fast(texts, **kw)

        known.tokenizer = Counting()
        ids, sizes = known.encoded(chunks)
        known.tokenizer = own
        assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == each
        assert len(seen) == calls and seen[0] == 1
