"""Vectorised text helpers used inside Spark tasks.

Everything works on one Arrow batch at a time, cut into pieces of bounded size.
Hashes are 64-bit polynomials over random per-byte values; equal text always
gives equal hashes, and unequal text collides with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at a time (a longer single text is one piece of its own).
CHUNK_BYTES = 1 << 19
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = np.uint64(0xD6E8FEB86659FD93 | 1)
#: The six ASCII blanks 0x20 and 0x09-0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the byte base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    p, q = _powers[0][:n], _powers[1][:n]
    if n > 4 * CHUNK_BYTES:
        _powers[0] = _powers[1] = np.ones(1, np.uint64)
    return p, q


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix polynomials, one longer than the data, for span_hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    if len(data):
        np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of the data that the prefix polynomials were made of."""
    inverse = powers(len(prefix))[1]
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than the six ASCII blanks."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~_BLANK[data]
    before, after = np.empty_like(ink), np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    after[-1], after[:-1] = False, ink[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word; `lower` folds A-Z first."""
    if lower:
        data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h, rows, starts, ends


def gram_hashes(h: np.ndarray, k: int, base: np.uint64 = _GRAM) -> np.ndarray:
    """Hash of each run of k consecutive entries of h (length len(h)-k+1, or none)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, step, power = None, 0, h, base
        bits = k
        while True:  # step covers `width` entries; join the widths that k is made of
            width = len(h) - len(step) + 1
            if bits & 1:
                if out is None:
                    out, have = step, width
                else:
                    n = len(h) - have - width + 1
                    out = out[:n] + step[have : have + n] * np.uint64(pow(int(base), have, 2**64))
                    have += width
            bits >>= 1
            if not bits:
                break
            n = len(step) - width
            step = step[:n] + step[width : width + n] * power
            power = np.uint64(int(power) * int(power) & (2**64 - 1))
    return mix64(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every k-word shingle of the lower-cased texts, with repeats.

    A text of one to k-1 words has one shingle, its whole sequence; an empty one has none.
    """
    h, rows, _, _ = word_hashes(data, offsets, True)
    grams = gram_hashes(h, k)
    ok = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
    out_rows, out = rows[: len(grams)][ok], grams[ok]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.array([gram_hashes(h[a : a + c], int(c))[0] for a, c in zip(first, counts[short], strict=True)], np.uint64)
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, mix64(extra + counts[short].astype(np.uint64))])
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out


def distinct_by_row(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, end to end, with n+1 offsets."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[keep], values[keep]
    return values, np.searchsorted(rows, np.arange(n + 1))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest entry (by its leading bits) of each window of w entries; leftmost on ties."""
    n = len(x)
    if n < w:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, n.bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    packed = (x & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    padded[:n] = packed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def to_unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
