"""Byte-level BPE encoding and decoding on padded matrices (operator 9).

Texts are split into tokens-to-be (see pretokens); each distinct one is encoded once per worker. They are
bucketed by length into padded matrices of byte ids. In each round every row merges its leftmost pair
of smallest rank, found by binary search of the hashed pair (left id, right id) in a sorted table, and the
row is compacted; rows without a pair are done. The decoder joins the bytes of the ids.

Defined cases: null and empty texts have no tokens; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored. Very long tokens-to-be (over LONG bytes) would make wide
matrices; those are merged by the same rule with a heap, one by one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import pretokens

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 512
#: Cells of one padded matrix.
CELLS = 1 << 19


class Vocabulary:
    """Merge ranks of a rank file: bytes of each id, and the sorted table of pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.rank.values()) + 1
        self.bytes_of = [b""] * self.size
        for raw, i in self.rank.items():
            self.bytes_of[i] = raw
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for raw, i in self.rank.items():
            for k in range(1, len(raw)):
                a, b = self.rank.get(raw[:k]), self.rank.get(raw[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        order = np.argsort(keys)
        keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        # open addressing: pair -> merged id
        self.mask = (1 << int(len(keys) * 4).bit_length()) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_id = np.full(self.mask + 1, self.size, np.int64)
        left = np.arange(len(keys))
        at = self._home(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] < 0
            _, one = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            put = left[one[free[one]]]
            self.slot_key[at[put]], self.slot_id[at[put]] = keys[put], self.merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (the merged id) of each pair; `size` where it does not merge."""
        keys = a * self.size + b
        at = self._home(keys)
        out = np.full(keys.shape, self.size, np.int64)
        hit = self.slot_key[at] == keys
        out[hit] = self.slot_id[at[hit]]
        todo = np.flatnonzero((~hit & (self.slot_key[at] >= 0)).ravel())
        flat, keys, at = out.reshape(-1), keys.reshape(-1), at.reshape(-1)
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            k = self.slot_key[at[todo]]
            same = k == keys[todo]
            flat[todo[same]] = self.slot_id[at[todo[same]]]
            todo = todo[~same & (k >= 0)]
        return flat.reshape(out.shape)

    def merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges every row of a padded matrix (padding -1) in place to its end; returns the new lengths."""
        live = np.arange(len(ids))
        ranks = np.full((len(ids), max(1, ids.shape[1] - 1)), self.size, np.int64)
        if ids.shape[1] > 1:
            both = ids[:, 1:] >= 0
            a, b = ids[:, :-1][both], ids[:, 1:][both]
            ranks[both] = self.merge_rank(a, b)
        width = ranks.shape[1]
        columns = np.arange(ids.shape[1])
        while len(live):
            r = ranks[live]
            j = r.argmin(axis=1)  # leftmost of the smallest
            best = r[np.arange(len(live)), j]
            go = best < self.size
            live, j, best = live[go], j[go], best[go]
            if not len(live):
                break
            row = ids[live]
            row[np.arange(len(live)), j] = best
            # compaction: what stands right of the pair moves one place to the left
            moved = np.full_like(row, -1)
            moved[:, :-1] = row[:, 1:]
            row = np.where(columns[None, :] > j[:, None], moved, row)
            ids[live] = row
            lengths[live] -= 1
            rr = ranks[live]
            shifted = np.full_like(rr, self.size)
            shifted[:, :-1] = rr[:, 1:]
            rr = np.where(columns[None, :width] > j[:, None], shifted, rr)
            k = np.arange(len(live))
            right = np.where(j + 1 < lengths[live], row[k, np.minimum(j + 1, ids.shape[1] - 1)], -1)
            new_right = np.full(len(live), self.size, np.int64)
            ok = right >= 0
            new_right[ok] = self.merge_rank(best[ok], right[ok])
            inside = j < width
            rr[k[inside], j[inside]] = new_right[inside]
            ok = j > 0
            rr[k[ok], j[ok] - 1] = self.merge_rank(row[k[ok], j[ok] - 1], best[ok])
            ranks[live] = rr
        return lengths

    def merge_long(self, raw: bytes) -> list[int]:
        """The same rule for one long token-to-be: a linked list and a heap of (rank, place)."""
        n = len(raw)
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n

        def rank(i: int) -> int:
            j = right[i]
            return -1 if j < 0 else int(self.merge_rank(np.array([ids[i]]), np.array([ids[j]]))[0])

        first = self.merge_rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(r), i) for i, r in enumerate(first) if r < self.size]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = right[i]
            ids[i], alive[j] = r, False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and 0 <= (x := rank(k)) < self.size:
                    heapq.heappush(heap, (x, k))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each span end to end, and how many each has."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (span numbers, padded ids)
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(size[short], kind="stable")]
        a = 0
        while a < len(short):
            width = int(size[short[a]])
            width = width if width < 24 else -(-width // 8) * 8
            b = min(int(np.searchsorted(size[short], width, "right")), a + max(1, CELLS // max(1, width)))
            rows = short[a:b]
            k = np.arange(width)
            inside = k < size[rows][:, None]
            ids = np.where(inside, self.of_byte[data[np.where(inside, starts[rows][:, None] + k, 0)]], -1)
            counts[rows] = self.merge_rows(ids, size[rows].copy())
            parts.append((rows, ids))
            a = b
        edges = np.concatenate([[0], np.cumsum(counts)])
        longer = {int(i): self.merge_long(data[starts[i] : ends[i]].tobytes()) for i in np.flatnonzero(size > LONG)}
        for i, ids in longer.items():
            counts[i] = len(ids)
        if longer:
            edges = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(edges[-1], np.int32)
        for rows, ids in parts:
            k = np.arange(ids.shape[1])
            inside = k < counts[rows][:, None]
            out[(edges[rows][:, None] + k)[inside]] = ids[inside]
        for i, ids in longer.items():
            out[edges[i] : edges[i + 1]] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _encoder(path: str) -> pretokens.Cache:
    return pretokens.Cache(vocabulary(path).encode_spans)


@lru_cache(2)
def _decimals(path: str) -> list[str]:
    return [str(i) for i in range(vocabulary(path).size)]


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts end to end, with offsets."""
    starts, ends, rows = pretokens.split(data, offsets)
    cache = _encoder(path)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    slots = cache.look_up(data, starts, ends)
    ids, n = pretokens.gather(cache.edges, cache.ids, slots)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(rows, weights=n, minlength=len(offsets) - 1).astype(np.int64))])


def _digest(path: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, names = vocabulary(path), _decimals(path)
        for batch in batches:
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                ids, edges = encode(data, offsets, path)
                listed = ids.tolist()
                words = [names[i] for i in listed]
                raw = [vocab.bytes_of[i] for i in listed]
                e = edges.tolist()
                spans = list(zip(e[:-1], e[1:], strict=True))
                columns = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_tokens": pa.array(np.diff(edges)),
                    "ids_sha256": pa.array([hashlib.sha256(",".join(words[p:q]).encode()).hexdigest() for p, q in spans]),
                    "decoded_sha256": pa.array([hashlib.sha256(b"".join(raw[p:q])).hexdigest() for p, q in spans]),
                }
                if texts:
                    columns["ids"] = K.list_array(ids, edges, pa.int32())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def digest(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of docs(doc_id, text).

    path: a rank file that every executor can read.
    """
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return rows.mapInArrow(_digest(path, ids), schema)
