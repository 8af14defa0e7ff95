"""Fill-in-the-middle: documents cut in three at unit borders and put together in another order.

A unit is a run of ASCII letters or any other single character. A text is kept as runs of one character class, with how many
units and characters come before each; the run that holds a cut is found by binary search and the place in it by arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, text_of

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
LETTER, FOLLOWS = 0, 5
#: Class of each UTF-8 byte: a letter, another character by how many bytes it has (1 to 4), or a byte that only continues one.
CLASSES = np.full(256, 1, np.uint8)
CLASSES[0x80:0xC0], CLASSES[0xC0:0xE0], CLASSES[0xE0:0xF0], CLASSES[0xF0:] = FOLLOWS, 2, 3, 4
CLASSES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = LETTER
WIDTHS = np.array([1, 1, 2, 3, 4])
SLICE = 8 << 20  # bytes of text whose runs a task holds at once; a longer text is taken alone


@dataclass
class Runs:
    """Maximal runs of one class, none of which crosses a text's end, over several texts laid end to end; one empty run stands last."""

    byte: np.ndarray  # where each run starts, by bytes,
    char: np.ndarray  # by characters,
    unit: np.ndarray  # by units
    width: np.ndarray  # bytes a character

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray) -> Runs:
        """starts: where each text starts in data, by bytes, and where the last ends."""
        classes = CLASSES[data]
        heads = np.flatnonzero(classes != FOLLOWS)
        classes = classes[heads]
        new = np.empty(len(heads), bool)
        new[:1] = True
        np.not_equal(classes[1:], classes[:-1], out=new[1:])
        new[np.searchsorted(heads, starts[:-1][starts[:-1] < len(data)])] = True
        char = np.flatnonzero(new)
        kind = classes[char]
        sizes = np.diff(char, append=len(heads))
        return cls(np.append(heads[char], len(data)), np.append(char, len(heads)), np.append(0, np.cumsum(np.where(kind == LETTER, 1, sizes))), np.append(WIDTHS[kind], 1))

    def units_before(self, places: np.ndarray) -> np.ndarray:
        """Units before each place (a byte at which a run starts, or the end)."""
        return self.unit[np.searchsorted(self.byte, places)]

    def at(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and characters before each number of units. A letter run is one unit, so a cut in it lies at its start."""
        run = np.searchsorted(self.unit, units, "right") - 1
        inside = units - self.unit[run]
        return self.byte[run] + inside * self.width[run], self.char[run] + inside


def hashes(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers that depend on the seed and the id alone; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output, rest (a struct of the other columns): one row per row.

    rate of 100 documents are cut, and spm_rate of 100 of those have their suffix first; which ones and where follows from seed
    and doc_id, so reruns and other orders of the rows agree. Plain ones (also empty and null texts, and texts that hold a mark)
    come out as they are, with null lengths. Rows with the same doc_id have the same form, if their texts can be cut. Each
    row is worked on alone: nothing is shuffled, and a lost task is run again. No rows: no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"), packed(docs, ("doc_id", "text")).alias("rest"))
    marks = [m.encode() for m in MARKS]

    def cut(names: list, texts: list[bytes]) -> Iterator[tuple]:
        starts = np.cumsum([0, *map(len, texts)])
        runs = Runs.of(np.frombuffer(b"".join(texts), np.uint8), starts)
        first = runs.units_before(starts)
        counts = np.diff(first)
        drawn = [hashes(seed, d) for d in names]
        places = np.array([(a % (n + 1), b % (n + 1)) for (a, b, _, _), n in zip(drawn, counts.tolist(), strict=True)], np.int64).reshape(-1, 2)
        places.sort(axis=1)
        bytes_at, chars_at = runs.at(first[:-1, None] + places)
        bytes_at -= starts[:-1, None]
        chars_at = np.diff(chars_at, axis=1, prepend=runs.char[np.searchsorted(runs.byte, starts[:-1])][:, None])
        for text, (_, _, c, d), n, (i, j), (before, inside) in zip(texts, drawn, counts.tolist(), bytes_at.tolist(), chars_at.tolist(), strict=True):
            if not text or c % 100 >= rate or any(m in text for m in marks):
                yield n, "plain", None, None, text
            elif d % 100 < spm_rate:
                yield n, "spm", before, inside, b"".join((marks[1], text[j:], marks[0], text[:i], marks[2], text[i:j]))
            else:
                yield n, "psm", before, inside, b"".join((marks[0], text[:i], marks[1], text[j:], marks[2], text[i:j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
        for batch in batches:
            at = 0
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and (end == at or size + len(batch.column(1)[end].as_buffer()) <= SLICE):
                    size += len(batch.column(1)[end].as_buffer())
                    end += 1
                part = batch.slice(at, end - at)
                rows = zip(*cut(part.column(0).to_pylist(), part.column(1).to_pylist()), strict=True)
                n, form, before, inside, output = (pa.array(x, t) for x, t in zip(rows, types, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), n, form, before, inside, output.view(pa.string()), part.column(2)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "rest"])
                at = end

    schema = T.StructType.fromDDL("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string").add("rest", own.schema["rest"].dataType)
    return own.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output from. Cut texts hold no mark, so the marks in output are the three put there."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    back = restored(F.col("output"), F.col("form"))
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
h AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output ELSE pre || mid || suf END) AS restored_sha256 FROM o
"""
