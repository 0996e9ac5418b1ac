"""Vectorised text kernels over Arrow batches, shared by the operators that run in Python workers.

Everything works on the UTF-8 bytes of an Arrow string column. A *word* is a maximal run of
bytes outside ``\\x20`` and ``\\x09-\\x0D`` (the pattern ``[^\\x20\\x09-\\x0D]+``), never
crossing a row. Words and windows are identified by well mixed 64-bit hashes: two different
items among ``n`` collide with a probability below ``n**2 / 2**65``.

Memory: texts are handled in chunks of about ``CHUNK`` bytes (a longer single text is a chunk
of its own), and hashing works through blocks of ``BLOCK`` bytes inside a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLOCK = 1 << 18
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 2 << 20

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Freed memory goes back to the system: workers are used again by tasks of other operators, and idle ones stay."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark) -> None:
    """Bound the batches that reach Python workers, in rows and in bytes: whole texts can be long.

    The settings are the session's and hold when a plan runs, so they stay; they are only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW = np.ones(0, np.uint64)
_IPOW = np.ones(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, BLOCK + 4096)
        grown = []
        for base in (_ODD, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        if n > BLOCK + 4096:
            return grown[0], grown[1]
        _POW, _IPOW = grown
    return _POW, _IPOW


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and the n + 1 offsets of the rows. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of ``column``: (slice, bytes, offsets). Ends a task's work."""
    for batch in batches:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + most, "right")) - 1
            j = min(n, max(j, i + 1))
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        del batch, buf, off
    release()


def runs(same: np.ndarray, keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal ``same`` where ``keep``, within rows: starts, ends, and the index of each row's first run."""
    n = len(same)
    new = np.ones(n + 1, bool)
    new[1:n] = same[1:] != same[:-1]
    new[offsets] = True
    starts = np.flatnonzero(new[:n])
    ends = np.append(starts[1:], n)
    kept = keep[starts] if n else np.zeros(0, bool)
    starts, ends = starts[kept], ends[kept]
    return starts, ends, np.searchsorted(starts, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and one past the last) the index of its first word."""
    dark = ~SPACE[buf]
    return runs(dark, dark, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; ``fold`` takes A-Z as a-z. Ranges are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    table, i = _FOLDED if fold else _BYTE, 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[j - 1])
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(items: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``size`` items in a row within one row's items: (hash, index of the window's first item)."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = items[:n].copy()
    for k in range(1, size):
        acc *= np.uint64(0xA0761D6478BD642F)
        acc += items[k : k + n]
    ok = np.ones(n, bool)
    for k in range(1, size):  # a window may not reach over the start of a later row
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    return mix(acc[at]), at


def row_of(index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row that each item index belongs to."""
    return np.searchsorted(first, index, "right") - 1


def chars(buf: np.ndarray) -> np.ndarray:
    """1 at the first byte of each code point, else 0."""
    return ((buf & 0xC0) != 0x80).astype(np.int64)


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def log_choose(n: int, k: int) -> float:
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
