"""Array scans over the raw UTF-8 buffers of Arrow string columns.

Every function takes whole chunks of documents laid end to end, so the cost of
a numpy call is shared by many documents and no text is ever decoded to Python
strings unless an operator needs code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Documents are handled in chunks of about this many bytes; a longer one is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of words that are hashed together, with some 50 bytes of sums and powers each; a longer word is a block of its own.
HASH_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(seed: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([seed], dtype=U))[0] | U(1)


BASE = _odd(7)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(n, base, dtype=U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Chunk:
    """Some documents of one Arrow batch: their bytes end to end and where each starts."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        self.batch = batch
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = pc.fill_null(text, "")
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def text_of(self, k: int) -> np.ndarray:
        return self.data[self.offsets[k] : self.offsets[k + 1]]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 60_000) -> Iterator[Chunk]:
    """Cuts batches between documents so that one chunk holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + limit, "right"))))
            yield Chunk(batch.slice(start, stop - start), column)
            start = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and what the allocators keep counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def prefix_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for constant-time hashes of any byte range, and the inverse powers."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(BYTE_CODE[data] * up[:n], out=sums[1:])
    return sums, down


def range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


#: Everything but ASCII letters, digits and the bytes of non-ASCII characters.
PUNCTUATION = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def words(chunk: Chunk, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside ``space``: start, end, hash of the lower-cased (A-Z only) word, and the first word of each document."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    inside = ~space[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    hashes = np.empty(len(starts), dtype=U)
    a = 0
    while a < len(starts):  # a word's hash depends on its bytes alone, so words are hashed in blocks
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HASH_BYTES, "right")))
        low = starts[a]
        sums, down = prefix_codes(LOWER[data[low : ends[b - 1]]])
        hashes[a:b] = range_hash(sums, down, starts[a:b] - low, ends[a:b] - low)
        a = b
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct hashed n-word shingles of each document, ascending; shorter documents have their whole sequence as one."""
    out: list[np.ndarray] = []
    factors = [_odd(100 + i) for i in range(n)]
    total = len(hashes)
    if total >= n:
        rolled = np.zeros(total - n + 1, dtype=U)
        for i, f in enumerate(factors):
            rolled += hashes[i : total - n + 1 + i] * f
        rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            one = np.array([b - a], dtype=U)
            for f, k in zip(factors, range(a, b), strict=False):
                one += hashes[k : k + 1] * f
            out.append(mix(mix(one)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out
