"""Vectorised word and shingle hashing on Arrow text columns.

Text is handled as one byte buffer per slice of rows. A word is a maximal run of
bytes other than ``\\x20 \\x09-\\x0D``; A-Z are folded to a-z. A shingle is ``k``
consecutive words; a text with fewer than ``k`` words (but at least one) has its
whole word sequence as its only shingle. Words and shingles are identified by
64-bit hashes. Null text is handled as empty text.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (a bijection on 64-bit integers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _fold_table() -> np.ndarray:
    byte = np.arange(256)
    byte[65:91] += 32
    return mix((byte.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


_BYTE = _fold_table()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = 0xD1342543DE82EF95
_P_INV = pow(_P, -1, 1 << 64)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)
_powers: dict[str, np.ndarray] = {}
_FIRST_POOL = pa.default_memory_pool()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and its inverse; kept until the task ends, but for a text beyond any slice."""
    have = _powers.get("p")
    if have is not None and len(have) >= n:
        return _powers["p"], _powers["i"]
    tables = []
    for base in (_P, _P_INV):
        t = np.full(max(n, SLICE_BYTES + 1), _U(base))
        t[0] = _U(1)
        tables.append(np.multiply.accumulate(t))
    if n <= 4 * SLICE_BYTES:
        _powers["p"], _powers["i"] = tables
    return tables[0], tables[1]


def text_slices(batch: pa.RecordBatch, text_col: str = "text", max_bytes: int = SLICE_BYTES):
    """Yield ``(first_row, n_rows, bytes, offsets)`` with at most ``max_bytes`` of text.

    A longer single text forms its own slice.
    """
    arr = batch.column(batch.schema.get_field_index(text_col))
    arr = arr.cast(pa.string()) if not pa.types.is_string(arr.type) else arr
    arr = arr.fill_null("") if arr.null_count else arr
    if not len(arr):
        return
    _, off_buf, data_buf = arr.buffers()
    off = np.frombuffer(off_buf, np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(arr):
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1)
        yield a, b - a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the index of each text's first word."""
    n = len(data)
    word = ~_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < n)]
    start[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * power[:len(data)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s])


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in text order, and the index of each text's first shingle."""
    n = len(h)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += padded[j:j + n] * _PLACE[j]
    count = np.diff(first)
    keep = np.ones(n, bool)
    for j in range(1, k):
        keep[first[1:][count >= j] - j] = False
    for d in np.flatnonzero((count > 0) & (count < k)):
        a, c = int(first[d]), int(count[d])
        out[a] = (np.append(h[a:a + c], _U(c)) * np.append(_PLACE[:c], _PLACE[k + 1])).sum(dtype=np.uint64)
        keep[a] = True
    per = np.where(count >= k, count - k + 1, count > 0)
    return mix(out[keep]), np.concatenate([[0], np.cumsum(per)])


def shingles_of(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = word_spans(data, off)
    return shingle_hashes(word_hashes(data, s, e), first, k)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bits_to_filter(n_bits_log2: int, hashes: np.ndarray) -> np.ndarray:
    """A fixed-size presence filter (bool per slot): no false negatives."""
    slots = np.zeros(1 << n_bits_log2, bool)
    slots[hashes >> _U(64 - n_bits_log2)] = True
    return slots


def keep_memory_low() -> None:
    """Let freed arrays go back to the system at once, in this worker: Arrow's by the C library, large ones unmapped."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: a fixed one, the default grows with what is freed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def give_back_memory() -> None:
    """Drop tables and return freed memory to the system: Spark keeps a Python worker for its next task."""
    _powers.clear()
    gc.collect()
    for pool in (_FIRST_POOL, pa.default_memory_pool()):
        pool.release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
