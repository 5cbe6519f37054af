"""Words, hashes and minimisers of many texts at once, as NumPy arrays inside a task.

Words are maximal runs of bytes other than the ASCII blanks (space, tab, newline, vertical tab, form feed,
carriage return); that is what ``bytes.split()`` yields on UTF-8, and equals the pattern ``[^\\x20\\x09-\\x0D]+``.
All hashes are 64 bits wide and depend on the content only, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One random 64-bit value for each byte, from a fixed seed.
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, _INVERSE, np.uint64)
        down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


class RollingHash:
    """Hashes of any substrings of a byte array, from one running sum modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.up, down = _power_arrays(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each position on; shorter data have none."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Words:
    """Words of several texts, in order: `data` holds them joined by single spaces."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of all words at the end."""
        return np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self, most: int = 4_000_000) -> np.ndarray:
        """Of each word; of long texts `most` bytes at a time, for which tables of powers are kept."""
        if len(self.data) <= 2 * most:
            return RollingHash(self.data).of(self.start, self.end)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.data), most)), len(self.start))).tolist()
        out = np.zeros(len(self.start), np.uint64)
        for a, z in zip(cuts, cuts[1:]):
            base = self.start[a]
            out[a:z] = RollingHash(self.data[base : self.end[z - 1]]).of(self.start[a:z] - base, self.end[a:z] - base)
        return out

    def text(self, doc: int) -> bytes:
        """The words of one text joined by single spaces."""
        a, b = self.first[doc], self.first[doc + 1]
        return self.data[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


_INSIDE = np.ones(256, bool)
_INSIDE[list(b" \t\n\v\f\r")] = False


def word_bytes(text: bytes) -> np.ndarray:
    """Which bytes of a text lie in words."""
    return _INSIDE[np.frombuffer(text, np.uint8)]


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """Split texts into words. `lower` maps A-Z to a-z and leaves other characters."""
    parts = [(t.lower() if lower else t).split() for t in texts]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = b" ".join([b" ".join(p) for p in parts if p])
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    if len(data):
        start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    else:
        start = end = np.zeros(0, np.int64)
    return Words(data, start, end, np.repeat(np.arange(len(parts)), count), count)


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on (also across texts; callers mask those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= _BASE
            out += hashes[j : j + n]
    return mix(out)


@dataclass
class Runs:
    """Maximal runs of neighbouring windows that share one minimiser."""

    start: np.ndarray  # first window
    length: np.ndarray  # windows in the run
    seed: np.ndarray  # hash of the minimiser
    at: np.ndarray  # its first unit


def minimiser_runs(grams: np.ndarray, doc: np.ndarray, window: int, k: int) -> Runs:
    """Split all windows of `window` units into runs by their least k-gram.

    The choice depends on a window's content alone, so equal windows have equal seeds wherever they stand.
    `doc` names the text of each unit; windows that leave their text don't exist.
    """
    w, n = window - k + 1, len(doc) - window + 1
    if n <= 0:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bits = _U(int(len(grams)).bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    at = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    if not len(at):
        return Runs(at, at, np.zeros(0, np.uint64), at)
    seed_at = (least[at] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.concatenate(([True], (seed_at[1:] != seed_at[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    return Runs(at[first], np.diff(np.concatenate((first, [len(at)]))), grams[seed_at[first]], seed_at[first])


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the units in the union of [start, start + length)."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps, dtype=np.int32)[:n] > 0


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    values = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [b"" if x is None else x for x in values.to_pylist()]


#: What an operator keeps in a Python worker between its tasks, by owner: the functions that let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2_000_000, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about `most` bytes in each; one long text stays whole.

    Spark runs the tasks of all stages in the same Python workers, so a task first drops what other operators kept.
    """
    for name, forget in KEPT.items():
        if name != owner:
            forget()
    for batch in batches:
        size = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)] if len(size) else [0, 0]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def within(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + length), one range after the other."""
    begin = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - begin, length)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of word values for each text."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]
