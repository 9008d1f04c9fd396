"""Splitting text the way the byte-level tokenizers do, on whole batches of code points.

The rules are those of the pattern that comes with the rank files: contractions ('s 't 're 've 'm 'll 'd)
at the start of a token, letters, numbers or other signs with an optional single space before them, and
runs of blanks, whose last blank before a sign is left to that sign (or stands alone).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from . import kernels as K

BLANK, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = [chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000)]
    everything = "".join(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    out[WHITE] = BLANK
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every token-to-be of the UTF-8 texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
    lead = data[first]
    size = np.diff(np.append(first, len(data)))
    cp = lead.astype(np.int64)
    if len(first) != len(data):
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = np.flatnonzero(size == n)
            if len(at):
                v = (lead[at] & mask).astype(np.int64)
                for j in range(1, n):
                    v = (v << 6) | (data[first[at] + j] & 0x3F)
                cp[at] = v
    kind = classes()[np.minimum(cp, 0x10FFFF)]
    n = len(cp)
    begins = np.zeros(n + 1, bool)  # a text begins here
    edges = np.searchsorted(first, offsets)
    begins[edges] = True
    same = np.zeros(n, bool)  # same class as the code point before, in the same text
    same[1:] = (kind[1:] == kind[:-1]) & ~begins[1:n]
    new = ~same
    # the last blank of a run goes with what follows, if that is in the same text
    blank = kind == BLANK
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~begins[1:n]
    new[last] = True
    taken = np.flatnonzero(last & (cp == 32))
    new[taken + 1] = False
    # contractions: an apostrophe that begins a token and is followed by letters
    quote = np.flatnonzero((cp == 39) & new)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~begins[quote + 1]]
    if len(quote):
        nxt = cp[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        nn = np.where((quote + 2 < n) & ~begins[np.minimum(quote + 2, n)], cp[after], -1)
        one = np.isin(nxt, [ord(c) for c in "stmd"])
        two = ((nxt == ord("r")) & (nn == ord("e"))) | ((nxt == ord("v")) & (nn == ord("e"))) | ((nxt == ord("l")) & (nn == ord("l")))
        new[quote[one] + 1] = False
        stop = quote[one] + 2
        new[quote[two] + 1] = False
        new[quote[two] + 2] = False
        stop = np.concatenate([stop, quote[two] + 3])
        stop = stop[stop < n]
        new[stop[~(last[stop - 1] & (cp[stop - 1] == 32))]] = True
    at = np.flatnonzero(new)
    starts = first[at]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Cache:
    """Distinct tokens-to-be of a worker: their hashes, with one row of results for each.

    Forgotten when it holds more than `most` entries, so its memory is bounded.
    """

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.edges = np.zeros(1, np.int64)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of each span; spans not seen before are encoded."""
        h = K.span_hash(K.prefix_hash(data), starts, ends)
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self.clear()
        where = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[where] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        fresh = np.flatnonzero(~known)
        slots = np.empty(len(distinct), np.int64)
        slots[known] = self.slots[where[known]] if len(self.hashes) else 0
        if len(fresh):
            ids, lengths = self.encode(data, starts[at[fresh]], ends[at[fresh]])
            base = len(self.edges) - 1
            slots[fresh] = base + np.arange(len(fresh))
            self.ids = np.concatenate([self.ids, ids])
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(lengths)])
            merged = np.concatenate([self.hashes, distinct[fresh]])
            order = np.argsort(merged, kind="stable")
            self.slots = np.concatenate([self.slots, slots[fresh]])[order]
            self.hashes = merged[order]
        return slots[inverse]


def gather(edges: np.ndarray, values: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each slot end to end, and how many each has."""
    n = edges[slots + 1] - edges[slots]
    shift = np.repeat(edges[slots] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return values[shift + np.arange(len(shift))], n
