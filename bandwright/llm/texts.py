"""Words, lines and shingles of a column of texts, as arrays over its UTF-8 bytes.

Everything here works on one Arrow batch inside a task. Hashes are 64-bit and
depend on bytes only, so every task and every run gets the same ones. Where equality
itself is decided, use digests.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text taken at a time; arrays beside it hold some 40 bytes for each.
SLICE_BYTES = 1_000_000

U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))

BYTES = np.arange(256)
SPACE = np.isin(BYTES, [32, 9, 10, 11, 12, 13])
CONTINUATION = (BYTES & 0xC0) == 0x80
LETTER = ((BYTES | 32) >= 97) & ((BYTES | 32) <= 122) | (BYTES >= 128)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)


@dataclass
class Texts:
    """Bytes of several texts end to end; text ``i`` is ``offsets[i]:offsets[i+1]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Set flags per text."""
        return per_text(flags, self.offsets)


@dataclass
class Runs:
    """Runs of bytes (words, lines): byte ranges, and per text the range of its runs."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text each run is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def column_bytes(column: pa.Array) -> Texts:
    """A string column's bytes; null counts as the empty text."""
    filled = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)
    offsets = offsets[filled.offset : filled.offset + len(filled) + 1]
    buffer = filled.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False
        )
        before = np.cumsum(lengths) - lengths
        cuts = np.flatnonzero(np.diff(before // SLICE_BYTES, prepend=-1))
        for first, after in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(first, after - first)
    release()


def release() -> None:
    """Give the system back what this process has freed.

    Workers stay for later tasks, and what they keep adds to the executor's memory.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def runs(texts: Texts, inside: np.ndarray) -> Runs:
    """Longest runs of bytes flagged ``inside``, not crossing texts."""
    n = len(texts.data)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    before[texts.offsets] = False
    after[texts.offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Runs(starts, ends, np.searchsorted(starts, texts.offsets))


def words(texts: Texts) -> Runs:
    """Longest runs of bytes other than space, tab, and line and page breaks."""
    return runs(texts, ~SPACE[texts.data])


def lines(texts: Texts) -> Runs:
    r"""Each text split at ``\n``; k breaks make k + 1 lines, empty ones included."""
    broken = np.flatnonzero(texts.data == 10)
    offsets = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(broken, texts.offsets)) + 1)])
    last = np.zeros(offsets[-1], bool)
    last[offsets[1:] - 1] = True
    ends = np.empty(len(last), np.int64)
    ends[last] = texts.offsets[1:]
    ends[~last] = broken
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(last)]
    starts[offsets[:-1]] = texts.offsets[:-1]
    return Runs(starts, ends, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    values = values ^ (values >> U64(30))
    values = values * U64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> U64(27))
    values = values * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    factors = np.full(max(n, 1), base, U64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Prefixes:
    """Hash of any byte range in constant time, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.sums = np.zeros(n, U64)
        np.cumsum(BYTE_CODES[data] * powers(n)[:-1], out=self.sums[1:])
        self.inverse = powers(n, BASE_INVERSE)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


# Longer runs can be made to agree in running sums modulo a power of two, so they are
# told apart by a digest.
LONG_RUN = 64


def run_hashes(data: np.ndarray, found: Runs) -> np.ndarray:
    """A hash of each run's bytes."""
    hashes = Prefixes(data).hash(found.starts, found.ends)
    long = np.flatnonzero(found.ends - found.starts > LONG_RUN)
    if len(long):
        hashes[long] = run_digests(data, found.starts[long], found.ends[long])[:, 0]
    return hashes


def run_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The two halves of a 128-bit digest of each run's bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    spans = zip(starts.tolist(), ends.tolist())
    found = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in spans)
    return np.frombuffer(found, U64).reshape(-1, 2)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and the first word's index of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    windows = np.zeros(n, U64)
    for place, factor in enumerate(powers(size, U64(3 * int(BASE) % 2**64))):
        windows += hashes[place : place + n] * factor
    starts = np.arange(n)
    last = np.repeat(offsets[1:], np.diff(offsets))[:n]
    whole = starts + size <= last
    return mixed(windows[whole]), starts[whole]


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
