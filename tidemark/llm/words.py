"""Words of many texts at once, as 64-bit hashes: arrays in, arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Classes of bytes: 0 ASCII white space, 1 letters, digits and all bytes of other letters, 2 other ASCII.
CLASS = np.array([0 if b in b"\t\n\x0b\x0c\r " else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
SOLID = np.minimum(CLASS, 1)
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i up to n."""
    if len(_powers["base"]) <= n:
        for name, factor in (("base", BASE), ("inverse", INVERSE)):
            x = np.full(max(n + 1, 1 << 20), factor, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["base"], _powers["inverse"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a multiply and shift finaliser)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of a byte array, modulo 2 ** 64."""
    base, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * base[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), whatever stands before them."""
    _, inverse = powers(len(prefixes))
    return mixed((prefixes[ends] - prefixes[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], classes: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (runs of bytes of one class but 0), and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = classes[data]
    change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.append(change[1:], len(data))
    solid = kind[change] > 0
    starts, ends = change[solid], ends[solid]
    limits = np.cumsum([len(t) + 1 for t in texts])
    return span_hashes(prefix_hashes(data), starts, ends), np.diff(np.searchsorted(starts, limits), prepend=0)


def in_groups(items: list, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts of some size bytes together, at least one text each."""
    at = 0
    while at < len(items):
        end, total = at, 0
        while end < len(items) and (end == at or total + len(items[end]) <= size):
            total += len(items[end])
            end += 1
        yield at, end
        at = end


def grouped(batches: Iterator[pa.RecordBatch], keys: str | list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of some rows (at least, but for the last) of whole groups that share the keys, of batches sorted by them."""
    names = [keys] if isinstance(keys, str) else keys
    held: list[pa.RecordBatch] = []

    def ends(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(k)[at].as_py() for k in names)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = ends(batch, batch.num_rows - 1)
        if held and ends(held[-1], held[-1].num_rows - 1) == last:
            held.append(batch)
            continue
        own = np.any([batch.column(k).to_numpy() != x for k, x in zip(names, last, strict=True)], axis=0)
        end = int(np.flatnonzero(own)[-1]) + 1 if own.any() else 0
        if sum(b.num_rows for b in held) + end >= rows:
            whole = [*held, batch.slice(0, end)] if end else held
            yield pa.Table.from_batches(whole)
            held = [batch.slice(end)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
