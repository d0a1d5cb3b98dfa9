"""Words and hashes of many texts at once, on the bytes of an Arrow column.

A chunk is a run of whole rows of about CHUNK bytes (one row, if that is longer). Hashes are
polynomials over bytes or words modulo 2**64, taken from running sums, then mixed; equal strings have
equal hashes and different ones differ but for one chance in 2**64 or so a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 250_000
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0x2545F4914F6CDD1D))


VALUES = _byte_values()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_powers = _Powers()


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, starts, ends) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (np.asarray(ends) - starts).astype(np.uint64))


@dataclass
class Chunk:
    first: int  # row number in the batch
    data: np.ndarray  # bytes
    bounds: np.ndarray  # n + 1 places in data, one row between two


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The UTF-8 bytes of a text column (null: empty), by whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    every = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, every[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # row in the chunk of each word
    counts: np.ndarray  # words of each row
    hashes: np.ndarray
    roll: Rolling


def words(c: Chunk, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes within rows, hashed after lower-casing A-Z."""
    low = LOWER[c.data]
    inside = is_word[low]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cuts = c.bounds[:-1][c.bounds[:-1] < len(inside)]
    before[:1] = False
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    cuts = c.bounds[1:] - 1
    after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(c.bounds, starts, "right") - 1
    counts = np.bincount(row, minlength=len(c.bounds) - 1)
    roll = Rolling(VALUES[low])
    return Words(starts, ends, row, counts, roll.hash(starts, ends), roll)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of fewer words, but not none, is one run of all."""
    total = len(w.hashes)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(w.counts)))
    place = np.arange(total) - first[w.row]
    left = w.counts[w.row] - place
    begin = np.flatnonzero((left >= k) | (place == 0))
    end = begin + np.minimum(k, w.counts[w.row[begin]])
    return w.row[begin], Rolling(w.hashes).hash(begin, end)
