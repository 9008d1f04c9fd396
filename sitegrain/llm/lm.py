"""Language-model scores by a gated recurrent network (operator 6).

Tokens are lower-cased words (A-Z) between the six ASCII blanks, then one end for each text. Counts of all
training tokens are gathered over the whole corpus. The SHORT most frequent words, the end and one token for
all other words make the network's 1024 outputs: 32 classes of 32, so a token's probability is that of its class
times that within the class (class-factored softmax). A word outside the short list has the network's probability
of the rare token times its add-0.1 share among all words outside the list, seen or not; so the
probabilities of all texts add up.

The network is a gated recurrent unit, trained in numpy by truncated back-propagation through time: windows of
WINDOW steps, the state being carried from window to window to the end of each text. Its output biases start
at the corpus' frequencies. Every training row is learned from once: rows are dealt to ROUNDS rounds of shards of about
SHARD_CHARS characters; each shard trains a copy of the network and Spark averages the copies, round by round. A shard
is learned from in the order of its text keys, whatever the order of arrival, and in as many lanes side by side as
leave it STEPS updates (LANES at most).
Copies of a text are counted, and each shard gets its part of the count, so no text makes a shard larger than others.
Scoring runs many texts side by side, of as many batches as make SCORE_TOKENS, and carries each state through the whole text.

Counts of the HEAD most frequent words (a bounded broadcast of 16 bytes each) are looked up in the tasks; the words
beyond are joined to the count table.

Defined cases: null and empty texts are the end token alone; null doc_id trains; with no training text every
count is 0 and the network keeps its starting weights; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, text_key

FOLDS = 10
CLASSES = WITHIN = 32
SHORT = CLASSES * WITHIN - WITHIN - 1  # class 0 holds the rare token alone, class 1 begins with the end
RARE, END = 0, WITHIN
HEAD = 262_144
EMBED, HIDDEN = 16, 16
WINDOW, LANES, STEPS, SCORE_LANES = 16, 128, 256, 1024
ROUNDS = 2
SHARD_CHARS = 16_000_000
RATE = 0.01
#: Bytes of text whose words are hashed at a time, and tokens that are scored side by side at a time (a longer text is scored by itself).
HASH_BYTES, SCORE_TOKENS = 1 << 16, 1 << 21
#: Leading bits of a word's hash that lead to its place in the head.
HEAD_BITS = 20
END_HASH = np.uint64(0x5E7FEED5E7FEED5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def token_runs(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, offsets) for runs of rows of about `limit` bytes, whose words are hashed a cache's worth of bytes at a time."""
    for a, b, data, offsets in K.text_chunks(column, limit):
        parts, at = [], 0
        while at < b - a:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, "right")) - 1)
            parts.append(tokens(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to
        edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))])
        yield a, b, np.concatenate([h for h, _ in parts]), edges


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by the end, with offsets."""
    h, rows, _, _ = K.word_hashes(data, offsets, True)
    n = len(offsets) - 1
    edges = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n) + 1)])
    out = np.empty(edges[-1], np.uint64)
    out[np.arange(len(h)) + rows] = h
    out[edges[1:] - 1] = END_HASH
    return out, edges


@dataclass
class Words:
    """What the tasks know of the corpus: short-list ids and the counts of the most frequent words."""

    short: np.ndarray  # sorted hashes
    short_id: np.ndarray
    head: np.ndarray  # sorted hashes
    head_count: np.ndarray
    total: int
    distinct: int
    rest_total: int
    rest_distinct: int

    def ids(self, h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.short, h), len(self.short) - 1)
        return np.where(self.short[i] == h, self.short_id[i], RARE).astype(np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        """The place in the head of the first word of each cell of leading bits, and the end."""
        return np.searchsorted(self.head >> np.uint64(64 - HEAD_BITS), np.arange((1 << HEAD_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts, -1 for words beyond the head."""
        out = np.full(len(h), -1, np.int64)
        cell = (h >> np.uint64(64 - HEAD_BITS)).astype(np.int64)
        i, end = self.first[cell], self.first[cell + 1]
        left = np.flatnonzero(i < end)
        while len(left):  # one word of each cell at a time; few cells have more than two
            at = i[left]
            found = self.head[at] == h[left]
            out[left[found]] = self.head_count[at[found]]
            left = left[~found]
            i[left] += 1
            left = left[i[left] < end[left]]
        return out


class Network:
    """Weights as a dict of float32 arrays."""

    SHAPES = {"E": (CLASSES * WITHIN, EMBED), "W": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "U": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN,), "V": (HIDDEN, CLASSES), "v": (CLASSES,), "O": (CLASSES, WITHIN, HIDDEN), "o": (CLASSES, WITHIN)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Random weights; the biases give each output its share of `counts` (negative: no such output)."""
        rng = np.random.default_rng(6)
        w = {k: (rng.standard_normal(s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for k, s in cls.SHAPES.items()}
        w["V"] *= 0.1
        w["O"] *= 0.1
        table = np.where(counts < 0, 0, counts + 0.1).reshape(CLASSES, WITHIN)
        sums = table.sum(axis=1)
        with np.errstate(divide="ignore"):
            w["v"] = np.maximum(np.log(sums / sums.sum()), -1e4).astype(np.float32)
            w["o"] = np.maximum(np.log(table / np.maximum(sums, 1e-9)[:, None]), -1e4).astype(np.float32)
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        w, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            w[k] = flat[at : at + n].reshape(s).astype(np.float32, copy=False)
            at += n
        return cls(w)

    def cell(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input weights, their bias and recurrent weights with bias, a row for each gate cell, as the step takes them.

        Those of the reset and update gates are negated and those of the candidate doubled, which is what exp is taken of.
        """
        by = np.repeat(np.array([-1, -1, 2], np.float32), HIDDEN)[:, None]
        bias = np.concatenate([np.zeros(2 * HIDDEN, np.float32), self.w["c"]])[:, None]
        return by * self.w["W"].T, by * self.w["b"][:, None], by * np.hstack([self.w["U"].T, bias])

    @staticmethod
    def inputs(cell: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
        """Gate inputs of the embedded tokens x[step, lane] as (step, gate cell, lane)."""
        out = np.matmul(cell[0], x.transpose(0, 2, 1))
        out += cell[1]
        return out

    @staticmethod
    def step(back: np.ndarray, x: np.ndarray, h: np.ndarray, new: np.ndarray, gates: np.ndarray | None = None, part: np.ndarray | None = None) -> np.ndarray:
        """The candidate of gate inputs x and states h (closed by a row of ones), lanes side by side as columns; new takes the next states.

        gates and part, if given, take the reset and update gates and twice the state's part of the candidate. Exponentials may be
        infinite, which makes a gate 0 and a candidate 1.
        """
        u = np.matmul(back, h)
        gates = np.add(x[: 2 * HIDDEN], u[: 2 * HIDDEN], out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        if part is not None:
            part[:] = u[2 * HIDDEN :]
        n = gates[:HIDDEN] * u[2 * HIDDEN :]
        n += x[2 * HIDDEN :]
        np.exp(n, out=n)  # tanh(n) = 1 - 2 / (exp(2n) + 1)
        n += 1
        np.divide(np.float32(-2), n, out=n)
        n += 1
        np.subtract(h[:HIDDEN], n, out=new)
        new *= gates[HIDDEN:]
        new += n
        return n

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target given the states (a row each)."""
        out, classes, inner, order, edges = np.empty(len(h)), *_by_class(target)
        s, k = h[order], np.arange(len(h))
        p = s @ self.w["V"]
        p += self.w["v"]
        own = p[k, classes]
        own -= _logsum(p)
        at = int(edges[1])  # the rare token is alone in its class
        q = _within(self.w, s, classes, edges)
        own[at:] += q[k[: len(q)], inner[at:]] - _logsum(q)
        out[order] = own
        return out


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets in the order of their classes: classes, places within, the order, and each class's first place."""
    classes = target // WITHIN
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    classes = classes[order].astype(np.int64)
    return classes, (target % WITHIN)[order].astype(np.int64), order, np.searchsorted(classes, np.arange(CLASSES + 1))


def _within(w: dict, states: np.ndarray, classes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Logits within their classes of states sorted by class, those of class 0 left out."""
    at = int(edges[1])
    q = np.empty((len(states) - at, WITHIN), np.float32)
    for c in np.flatnonzero(np.diff(edges)).tolist():
        if c:
            np.matmul(states[edges[c] : edges[c + 1]], w["O"][c].T, out=q[edges[c] - at : edges[c + 1] - at])
    q += w["o"][classes[at:]]
    return q


def _logsum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; overwrites x."""
    top = np.float32(0) if not len(x) or x.max() < 60 else x.max(axis=1)  # most logits are small, and need no shift
    if np.ndim(top):
        x -= top[:, None]
    np.exp(x, out=x)
    return top + np.log(x @ np.ones(x.shape[1], np.float32) + np.float32(1e-30))


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Deals texts to at most `most` lanes, longest first, each to the lane that stands lowest."""
    n = max(1, min(most, len(lengths)))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for k in np.argsort(-lengths, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        out[i].append(k)
        heapq.heappush(heap, (load + int(lengths[k]), i))
    return out


def _lay_out(ids: np.ndarray, edges: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(targets, previous tokens, text numbers) as (step, lane) matrices, and each lane's length; longest lane first."""
    dealt = lanes(np.diff(edges), most)
    sizes = np.array([sum(int(edges[k + 1] - edges[k]) for k in lane) for lane in dealt])
    dealt = [dealt[i] for i in np.argsort(-sizes, kind="stable")]
    sizes = np.sort(sizes)[::-1]
    target = np.zeros((sizes[0], len(dealt)), np.int16)
    text = np.zeros((sizes[0], len(dealt)), np.int32)
    for j, lane in enumerate(dealt):
        at = 0
        for k in lane:
            n = edges[k + 1] - edges[k]
            target[at : at + n, j] = ids[edges[k] : edges[k + 1]]
            text[at : at + n, j] = k
            at += n
    before = np.empty_like(target)
    before[0], before[1:] = END, target[:-1]
    return target, before, text, sizes


def score_texts(net: Network, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of natural log probabilities of each text."""
    total = np.zeros(len(edges) - 1)
    # no more lanes than the longest text leaves work for, so the matrices are full
    target, before, text, sizes = _lay_out(ids, edges, min(SCORE_LANES, -(-len(ids) // max(1, int(np.diff(edges).max())))))
    last, cell = np.zeros((HIDDEN, target.shape[1]), np.float32), net.cell()
    for a in range(0, len(target), WINDOW):
        b = min(a + WINDOW, len(target))
        live = int(np.searchsorted(-sizes, -a, "left"))  # lanes longer than a
        prev = before[a:b, :live]
        inputs, keep = net.inputs(cell, net.w["E"][prev]), (prev != END).astype(np.float32)
        old, states, last = np.ones((HIDDEN + 1, live), np.float32), np.empty((b - a, HIDDEN, live), np.float32), last[:, :live]
        with np.errstate(over="ignore"):
            for t in range(b - a):
                np.multiply(last, keep[t], out=old[:HIDDEN])
                last = states[t]
                net.step(cell[2], inputs[t], old, last)
        real = (np.arange(a, b)[:, None] < sizes[:live]).ravel()
        lp = net.log_probs(states.transpose(0, 2, 1).reshape(-1, HIDDEN)[real], target[a:b, :live].ravel()[real])
        total += np.bincount(text[a:b, :live].ravel()[real], weights=lp, minlength=len(total))
    return total


def train_network(net: Network, ids: np.ndarray, edges: np.ndarray, rate: float = RATE) -> Network:
    """One pass of truncated back-propagation through time with Adam over the texts."""
    flat = net.flat()
    net, mean, square, gradient = Network.of(flat), *(np.zeros_like(flat) for _ in range(3))
    w, g = net.w, Network.of(gradient).w  # all are views of flat arrays
    target, before, _, sizes = _lay_out(ids, edges, max(1, min(LANES, len(ids) // (WINDOW * STEPS))))
    h = np.zeros((HIDDEN, target.shape[1]), np.float32)
    steps = -(-len(target) // WINDOW)
    for turn in range(steps):
        a, b = turn * WINDOW, min((turn + 1) * WINDOW, len(target))
        live = int(np.searchsorted(-sizes, -a, "left"))
        h, prev = h[:, :live], before[a:b, :live]
        x, cell = w["E"][prev.ravel()], net.cell()
        inputs = net.inputs(cell, x.reshape(b - a, live, EMBED))
        keep = (prev != END).astype(np.float32)
        old = np.ones((b - a, HIDDEN + 1, live), np.float32)
        new, gates, part, cand = (np.empty((b - a, k * HIDDEN, live), np.float32) for k in (1, 2, 1, 1))
        with np.errstate(over="ignore"):
            for t in range(b - a):
                np.multiply(h, keep[t], out=old[t, :HIDDEN])
                h = new[t]
                cand[t] = net.step(cell[2], inputs[t], old[t], h, gates[t], part[t])
        real = (np.arange(a, b)[:, None] < sizes[:live]).ravel()
        gradient[:] = 0
        d_out = _output_gradients(w, g, new.transpose(0, 2, 1).reshape(-1, HIDDEN), target[a:b, :live].ravel(), real)
        d_out = d_out.reshape(b - a, live, HIDDEN).transpose(0, 2, 1)
        # how each gate cell moves with the gradient of its state
        old, r, z = old[:, :HIDDEN], gates[:, :HIDDEN], gates[:, HIDDEN:]
        turned = 1 - z
        by = np.empty((b - a, 3, HIDDEN, live), np.float32)
        by_cand = turned * (1 - cand * cand)
        np.multiply(by_cand, r, out=by[:, 2])
        np.multiply(by[:, 2], part * (1 - r), out=by[:, 0])
        by[:, 0] *= np.float32(0.5)
        np.multiply(old - cand, z * turned, out=by[:, 1])
        du, ds, back = np.empty((b - a, 3, HIDDEN, live), np.float32), np.empty((b - a, HIDDEN, live), np.float32), np.zeros((HIDDEN, live), np.float32)
        for t in range(b - a - 1, -1, -1):
            d = np.add(d_out[t], back, out=ds[t])
            np.multiply(d, by[t], out=du[t])
            np.matmul(w["U"], du[t].reshape(3 * HIDDEN, live), out=back)
            back += d * z[t]
            back *= keep[t]
        dn, du = ds * by_cand, du.reshape(b - a, 3 * HIDDEN, live)
        g["U"][:] = np.matmul(old, du.transpose(0, 2, 1)).sum(axis=0)
        g["c"][:] = du[:, 2 * HIDDEN :].sum(axis=(0, 2))
        du[:, 2 * HIDDEN :] = dn
        dx = du.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
        g["W"][:], g["b"][:] = x.T @ dx, np.ones(len(dx), np.float32) @ dx
        _add_rows(g["E"], prev.ravel(), dx @ w["W"].T)
        _adam(flat, gradient, mean, square, turn + 1, rate * (1 - 0.9 * turn / steps))
    return net


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to out[at]."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def _adam(w: np.ndarray, g: np.ndarray, mean: np.ndarray, square: np.ndarray, turn: int, rate: float) -> None:
    """One update of the weights by clipped gradients, which are overwritten."""
    g *= np.float32(min(1.0, 1.0 / (np.sqrt(float(np.vdot(g, g))) + 1e-9)))
    mean *= np.float32(0.9)
    mean += np.float32(0.1) * g
    g *= g
    g *= np.float32(0.01)
    square *= np.float32(0.99)
    square += g
    np.sqrt(square, out=g)
    g *= np.float32((1 - 0.99**turn) ** -0.5)
    g += np.float32(1e-6)
    np.divide(mean, g, out=g)
    g *= np.float32(rate / (1 - 0.9**turn))
    w -= g


def _output_gradients(w: dict, g: dict, states: np.ndarray, goal: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Adds the gradients of the mean loss to g; returns those of the states."""
    scale = np.float32(1.0 / max(1, int(real.sum())))
    kept = np.flatnonzero(real)
    classes, inner, order, edges = _by_class(goal[kept])
    order = kept[order]
    s, k, at = states[order], np.arange(len(order)), int(edges[1])
    p = s @ w["V"]
    p += w["v"]
    np.exp(np.minimum(p, 60, out=p), out=p)
    p *= (scale / (p @ np.ones(CLASSES, np.float32) + np.float32(1e-30)))[:, None]
    p[k, classes] -= scale
    g["V"] += s.T @ p
    g["v"] += p.sum(axis=0)
    d = p @ w["V"].T
    q = _within(w, s, classes, edges)
    np.exp(np.minimum(q, 60, out=q), out=q)
    q *= (scale / (q @ np.ones(WITHIN, np.float32) + np.float32(1e-30)))[:, None]
    q[k[: len(q)], inner[at:]] -= scale
    used, deeper = np.flatnonzero(np.diff(edges)), np.empty((len(q), HIDDEN), np.float32)
    used = used[used > 0]
    for c, i, j in zip(used.tolist(), edges[used].tolist(), edges[used + 1].tolist(), strict=True):
        part = q[i - at : j - at]
        np.matmul(part.T, s[i:j], out=g["O"][c])
        np.matmul(part, w["O"][c], out=deeper[i - at : j - at])
    if len(used):
        g["o"][used] = np.add.reduceat(q, edges[used] - at, axis=0)
    d[at:] += deeper
    out = np.zeros_like(states)
    out[order] = d
    return out


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, found, _ in token_runs(batch.column("text"), 8 * K.CHUNK_BYTES):
            h, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(K.to_signed(h)), pa.array(n.astype(np.int64))], ["h", "c"])


def _most_frequent(table: DataFrame) -> DataFrame:
    """The words of the counts that HEAD words at most have, found by how many words have each count, and the SHORT most frequent ones in any case.

    No task sorts more than SHORT rows for each task before it; there are no more different counts than the square root of twice all tokens.
    """
    sizes = table.groupBy("c").agg(F.count("*").alias("n")).toArrow()
    c, n = sizes.column("c").to_numpy(), sizes.column("n").to_numpy()
    order = np.argsort(-c)
    held = c[order][np.cumsum(n[order]) <= HEAD]
    first = table.orderBy(F.desc("c"), "h").limit(SHORT + 1)  # the end may be among them
    return (table.where(F.col("c") >= int(held[-1])).unionByName(first) if len(held) else first).distinct()


def corpus_words(scratch: Scratch, docs: DataFrame) -> tuple[Words, DataFrame, np.ndarray]:
    """Counts of docs(text): what tasks need, the whole table (h, c), and the counts of the network's outputs."""
    table = scratch.save(docs.select("text").mapInArrow(_count_tokens, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _most_frequent(table).toArrow()
    h, c = K.to_unsigned(top.column("h").to_numpy()), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    words = h != END_HASH
    short, counts = h[words][:SHORT], np.full(CLASSES * WITHIN, -1.0)
    ends = int(c[~words].sum())
    counts[RARE] = total - ends - int(c[words][:SHORT].sum())
    counts[END] = ends
    ids = END + 1 + np.arange(len(short))
    counts[ids] = c[words][:SHORT]
    # the end is part of the short list, and always has a count of its own
    short, ids = np.append(short, END_HASH), np.append(ids, END)
    s, k = np.argsort(short), np.argsort(h)
    return Words(short[s], ids[s], h[k], c[k], int(total), int(distinct), int(counts[RARE]), int(distinct) - (len(short) - 1) - int(bool(ends))), table, counts


def _encode(words: Words):
    """Task: texts to their tokens' ids, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, edges in token_runs(batch.column("text"), K.CHUNK_BYTES):
                ids = words.ids(h).astype(np.int16)
                coded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), batch.column("size").slice(a, b - a), coded], ["key", "size", "ids"])

    return run


def _train_shard(flat: np.ndarray):
    """Task for one shard: the weights after training on it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("times").to_numpy())))
        parts, sizes = [], []
        for chunk in table.column("ids").chunks:
            for _, _, data, offsets in K.text_chunks(chunk):
                parts.append(data.view(np.int16))
                sizes.append(np.diff(offsets) // 2)
        ids, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        out = train_network(Network.of(flat), ids, edges).flat()
        return pa.table({"at": pa.array(np.arange(len(out)), pa.int32()), "x": pa.array(out.astype(np.float64) * len(ids)), "n": pa.array(np.full(len(out), float(len(ids))))})

    return run


def deal(scratch: Scratch, docs: DataFrame, words: Words) -> DataFrame:
    """(key, ids, times, round, shard): every row of docs(text) in one shard of one round, `times` rows of a text in each."""
    rows = docs.select(text_key("text").alias("key"), (F.length("text") + 1).cast("long").alias("size"), "text")
    coded = rows.mapInArrow(_encode(words), "key long, size long, ids binary").groupBy("key").agg(F.first("size").alias("size"), F.first("ids").alias("ids"), F.count("*").alias("n"))
    coded = scratch.save(coded, "coded")
    chars = coded.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0]
    slots = F.lit(ROUNDS * max(1, round(chars / ROUNDS / SHARD_CHARS)))
    each = coded.select("key", "ids", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", slots) - 1)).alias("j"))
    slot = F.pmod(F.pmod("key", slots) + F.col("j"), slots)
    times = F.floor(F.col("n") / slots) + F.when(F.col("j") < F.col("n") % slots, 1).otherwise(0)
    return each.select("key", "ids", times.alias("times"), (slot % ROUNDS).alias("round"), F.floor(slot / ROUNDS).alias("shard"))


def train(scratch: Scratch, docs: DataFrame, words: Words, counts: np.ndarray) -> Network:
    """The network after one pass over docs(text) in ROUNDS rounds."""
    net, dealt = Network.start(counts), deal(scratch, docs, words)
    for k in range(ROUNDS):
        weights = dealt.where(F.col("round") == k).groupBy("shard").applyInArrow(_train_shard(net.flat()), "at int, x double, n double")
        mean = weights.groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()  # as many rows as the network has weights
        if not mean.num_rows:
            continue  # so few rows that all are in the other rounds
        flat = np.zeros(len(net.flat()), np.float32)
        flat[mean.column("at").to_numpy()] = mean.column("x").to_numpy()
        net = Network.of(flat)
    scratch.drop("coded")
    return net


def _score(flat: np.ndarray, words: Words):
    """Task: texts to their scores, without the words beyond the head, which are listed."""

    names = ["doc_id", "n_tokens", "n_known", "base", "model", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.of(flat)
        base_of = np.log10(words.total + 0.1 * (words.distinct + 1))
        rest_of = np.log10(words.rest_total + 0.1 * (words.rest_distinct + 1))
        held, size = [], 0

        def scored() -> pa.RecordBatch:
            edges = np.concatenate([[0], np.cumsum(np.concatenate([x[1].to_numpy() for x in held]))])
            model = score_texts(net, np.concatenate([x[-1] for x in held]), edges) / np.log(10.0) + np.concatenate([x[4] for x in held])
            whole = [pa.concat_arrays([x[k] for x in held]) for k in (0, 1, 2, 3, 5)]
            return pa.RecordBatch.from_arrays([*whole[:4], pa.array(model), whole[4]], names)

        for batch in batches:
            for a, b, h, edges in token_runs(batch.column("text"), 8 * K.CHUNK_BYTES):
                n, rows = b - a, np.repeat(np.arange(b - a), np.diff(edges))
                ids, c = words.ids(h), words.count(h)
                here = c >= 0
                logs = np.where(here, np.log10(np.maximum(c, 0) + 0.1), 0.0)
                base = np.bincount(rows, weights=np.where(here, logs - base_of, 0), minlength=n)
                rest = np.bincount(rows, weights=np.where(here & (ids == RARE), logs - rest_of, 0), minlength=n)
                far = np.flatnonzero(~here)
                lists = K.list_array(K.to_signed(h[far]), np.searchsorted(rows[far], np.arange(n + 1)))
                held.append((batch.column("doc_id").slice(a, n), pa.array(np.diff(edges)), pa.array(np.bincount(rows[c > 0], minlength=n)), pa.array(base), rest, lists, ids.astype(np.int16)))
                size += len(h)
                if size >= SCORE_TOKENS:
                    yield scored()
                    held, size = [], 0
        if held:
            yield scored()

    return run


def score_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text)."""
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    taught = docs.where(~held_out(F.col("doc_id")))
    words, table, counts = corpus_words(scratch, taught)
    net = train(scratch, taught, words, counts)
    schema = "doc_id long, n_tokens long, n_known long, base double, model double, far array<long>"
    rows = docs.mapInArrow(_score(net.flat(), words), schema).withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.save(rows, "scored")
    far = rows.select("uid", F.explode("far").alias("h")).groupBy("uid", "h").agg(F.count("*").alias("tf"))
    logs = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    sums = far.join(table.hint("merge"), "h", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("far_known"), F.sum("tf").alias("far_n"), F.sum(F.col("tf") * logs).alias("far_logs"))
    base_of = float(np.log10(words.total + 0.1 * (words.distinct + 1)))
    rest_of = float(np.log10(words.rest_total + 0.1 * (words.rest_distinct + 1)))
    done = rows.drop("far").join(sums, "uid", "left")
    none = F.lit(0.0)
    return done.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("far_logs") - base_of * F.col("far_n"), none)).alias("base_score"),
        (F.col("model") + F.coalesce(F.col("far_logs") - rest_of * F.col("far_n"), none)).alias("score"),
    )
