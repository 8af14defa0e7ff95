import random
import zlib

import numpy as np
import pytest
from conftest_rows import rows

from tidemark.llm import tiers

SF = "/root/testdata/sf0.001"


def brute_ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tiers.tokenizer_path())
    return [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in docs]


def check_pieces(got, docs):
    """Pieces of the documents, in any order of rows that share an id, are their ids, each once."""
    want = {}
    for d, ids in brute_ids(docs):
        want.setdefault((d, len(ids)), []).append(ids)
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert set(have) == set(want)
    for key, texts in want.items():
        own = sorted(have[key], key=lambda r: (r.start, r.length))
        assert sum(r.length for r in own) == sum(len(t) for t in texts)
        for r in own:
            assert any(zlib.crc32(t[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for t in texts)
        if len(texts) == 1:
            at = 0
            for r in own:
                assert r.start == at
                at += r.length


def padding(got, longest, least_gap):
    """Checks all places; returns padding tokens and the number of sequences."""
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert len({(r.tier, r.step) for r in parts}) == 1
        tier = parts[0].tier
        assert at == tier or (tier == longest and longest - least_gap < at < longest)
        assert tier & (tier - 1) == 0 and tier <= longest
        total += tier - at
    return total, len(sequences)


def test_ids_of_odd_texts():
    """Chunks put together give what the tokenizer gives for the whole text."""
    random.seed(3)
    alphabet = ["a", "B", "zz", "The", ".", ",", "...", "'s", "'", "don't", "!?", "(", "<|", "|>", "<|endoftext|>", "é", "ß", "İ", "あ", "\U0001f600", " ", " ", " ", " ", " ", " ", "　", "1", "23", "²", "Ⅷ", "_", "-", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\x00", "́", "ﬁ", " ", " ", " "]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(20_000)] + [" " * 5000 + "x", "x" + "\n " * 3000, "ab " * 9000]
    known = tiers.ByteChunks(tiers.tokenizer_path())
    wrong = [t for t, ids, (_, want) in zip(texts, known.ids([t.encode() for t in texts]), brute_ids([(0, t) for t in texts]), strict=True) if ids.tolist() != want.tolist()]
    assert not wrong, wrong[:5]
    known.forget()
    assert known.ids([b"again, again"])[0].tolist() == brute_ids([(0, "again, again")])[0][1].tolist()


def test_route():
    assert [tiers.route(n, tiers.TIERS, 16) for n in (1, 240, 241, 255, 256, 257, 1024, 1023, 2032, 2040, 2048)] == [256, 256, 512, 512, 256, 512, 1024, 2048, 2048, 2048, 2048]


@pytest.mark.parametrize("kind", ["spread", "short", "long", "one", "few", "equal", "none"])
def test_plan_places_every_token(kind):
    """The plan's runs give each (length, rank) its own gapless place; nothing is lost."""
    rng = np.random.default_rng(7)
    sample = {"spread": rng.integers(1, 2049, 5000), "short": rng.integers(1, 60, 3000), "long": rng.integers(1500, 2049, 400), "one": np.array([777]), "few": np.array([300, 9]), "equal": np.full(1000, 1025), "none": np.zeros(0, int)}[kind]
    counts = np.bincount(sample, minlength=2049).astype(np.int64)
    runs = tiers.plan(counts, step_tokens=8 * 2048)
    fill: dict[int, list] = {}
    line = 0
    for length in np.flatnonzero(counts).tolist():
        for rank in range(int(counts[length])):
            if rank < runs["line_first"][length]:
                i = int(np.searchsorted(runs["whole_key"], (length << 44) + rank, "right")) - 1
                nth = rank - int(runs["whole_key"][i] & ((1 << 44) - 1))
                fill.setdefault(int(runs["whole_sequence"][i] + nth // runs["whole_each"][i]), []).append((int(runs["whole_offset"][i] + nth % runs["whole_each"][i] * length), length))
            else:
                line += length
    gaps = 0
    for i in range(len(runs["gap_at"])):
        end = runs["gap_at"][i + 1] if i + 1 < len(runs["gap_at"]) else line
        many, rest = divmod(int(end - runs["gap_at"][i]), int(runs["gap_room"][i]))
        assert rest == 0
        for n in range(many):
            fill.setdefault(int(runs["gap_sequence"][i]) + n, []).append((int(runs["gap_offset"][i]), int(runs["gap_room"][i])))
            gaps += 1
    assert sorted(fill) == list(range(len(fill)))
    wasted, by_step = 0, {}
    for sequence, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        tier = int(runs["tier"][np.searchsorted(runs["tier_first"], sequence, "right") - 1])
        assert at == tier or 2032 < at < tier == 2048
        wasted += tier - at
        by_step.setdefault(int(tiers.step_of(np.array([sequence]), runs)[0]), []).append((tier, sum(x * x for _, x in parts)))
    assert wasted <= 0.008 * max(1, int(sample.sum()))
    if kind == "spread":
        assert gaps < 0.3 * len(sample) and runs["line_left"].sum() < 0.1 * len(sample)  # most pieces stay whole; fewer are cut of more pieces
        assert set(by_step) == set(range(len(by_step)))
        whole_steps = [v for v in by_step.values() if len({t for t, _ in v}) == 1]
        assert len(whole_steps) >= len(by_step) - 1
        for tier in tiers.TIERS[2:]:  # all shorter ones went into gaps
            costs = [sum(c for _, c in v) for v in whole_steps if v[0][0] == tier]
            sizes = [len(v) for v in whole_steps if v[0][0] == tier]
            assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= 8 * 2048
            assert max(costs) / min(costs) < 1.25


@pytest.mark.parametrize("sizes", [tiers.TIERS, (4, 8, 16)])
def test_awkward_rows(awkward, clashing, none, sizes):
    docs = [r[:2] for r in rows()]
    for df in (awkward, clashing):
        got = tiers.pack_documents(df, sizes, least_gap=min(16, sizes[0] // 2)).collect()
        check_pieces(got, docs)
        padding(got, sizes[-1], min(16, sizes[0] // 2))
    assert tiers.pack_documents(none, sizes).count() == 0


def test_common_length_is_dealt(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, repeat('a b ', CAST(id % 300 AS int))) AS text")
    pieces = tiers.written(tiers.pieces_of(docs))
    got = tiers.pack(pieces, bucket_rows=256).collect()
    wasted, many = padding(got, 2048, 16)
    assert sum(r.length for r in got) == sum(int(r.length) for r in pieces.collect()) and wasted < 0.001 * 2048 * many
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_query(spark):
    from tidemark.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_tiered_packing"](spark, SF).collect()
    check_pieces(got, docs)
    wasted, _ = padding(got, 2048, 16)
    assert wasted <= 0.001 * sum(r.length for r in got)
    assert len(got) < 1.6 * len(docs) + sum(r.length for r in got) / 2048


def test_byte_level_chunks_are_not_joined_by_spaces():
    known = tiers.ByteChunks(tiers.tokenizer_path())
    assert known.word is None
    plain = ["transformation", " transformation", "a", " b", "  ", "transformation"]
    ids, sizes = known.encoded(plain)
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [known.tokenizer.encode(c, add_special_tokens=False).ids for c in plain]
