"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 1).

Statistics are taken from whole texts, in batches. Trees are grown level by level from histograms of binned
statistics (logistic loss, second-order gains, shrinkage) and flattened into arrays, so a batch is scored by
stepping all texts down all trees at once.

Training uses labelled documents whose crc32(doc_id as text) mod 5 is not 0, at most SAMPLE of them
(those with the smallest hashes of doc_id; a documented bound), whose statistics alone reach the driver.

Defined cases: null and empty texts have statistics 0 and get a score; without usable labels, or with labels of
one class only, every score is the share of label 1 (0.5 without any); labels that are null or other than
0 and 1 are not used, and a doc_id labelled several times counts with its highest label; a null doc_id is not
held out; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh

#: Most labelled rows that train the trees.
SAMPLE = 20_000
FOLDS = 5
CUT = 0.3
#: Bytes of text whose statistics are taken at a time (about 100 bytes of arrays each).
CHUNK = 1 << 18

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence sign, 7 symbol, 8 non-ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_KIND[[ord(c) for c in ".,;:!?"]] = 6
_KIND[[ord(c) for c in "#$%&*@^~|\\<>{}[]=+_/`"]] = 7
_KIND[128:] = 8

NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "distinct_words", "top_word", "same_as_last_word",
    "distinct_shingles", "lower", "upper", "digits", "blanks", "sentence_signs", "symbols", "non_ascii", "other_bytes", "repeated_bytes",
    "byte_entropy", "log_lines", "line_length", "distinct_lines", "repeated_line_bytes", "short_words", "lines_with_end", "words_with_symbol",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(NAMES)), np.float64)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), size)
    per = np.maximum(size, 1)
    kinds = np.bincount(row * 9 + _KIND[data], minlength=9 * n).reshape(n, 9) / per[:, None]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (row[1:] == row[:-1])
    hist = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) / per[:, None]
    entropy = -np.sum(np.where(hist > 0, hist * np.log2(np.where(hist > 0, hist, 1)), 0), axis=1)

    h, rows, starts, ends = K.word_hashes(data, offsets, True)
    words = np.bincount(rows, minlength=n)
    pw, length = np.maximum(words, 1), ends - starts
    mean = np.bincount(rows, weights=length, minlength=n) / pw
    square = np.bincount(rows, weights=length.astype(float) ** 2, minlength=n) / pw
    longest, top, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(longest, rows, length)
    order = np.lexsort((h, rows))
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        at = np.flatnonzero(new)
        np.maximum.at(top, rows[order][at], np.diff(np.append(at, len(order))))
        distinct = np.bincount(rows[order][at], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    values, edges = K.distinct_by_row(*(grams := K.shingle_sets(data, offsets)), n)
    shingles = np.bincount(grams[0], minlength=n)
    marked = np.concatenate([[0], np.cumsum(_KIND[data] == 7)])

    line_end = np.flatnonzero(data == 10) + 1
    line_start = np.union1d(offsets[:-1][size > 0], line_end[line_end < len(data)])
    line_stop = np.append(line_start[1:], len(data))
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_hash = K.span_hash(K.prefix_hash(data), line_start, np.maximum(line_start, line_stop - (data[line_stop - 1] == 10)))
    lines = np.bincount(line_row, minlength=n)
    pl = np.maximum(lines, 1)
    order = np.lexsort((line_hash, line_row))
    repeat = np.zeros(len(order), bool)
    repeat[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    twice = order[repeat]
    tail = data[np.maximum(line_start, line_stop - 1 - (data[line_stop - 1] == 10))]
    columns = (
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean**2, 0)), longest, distinct / pw, top / pw, np.bincount(rows, weights=again, minlength=n) / pw,
        np.diff(edges) / np.maximum(shingles, 1), kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 6], kinds[:, 7], kinds[:, 8], kinds[:, 0], np.bincount(row, weights=same, minlength=n) / per,
        entropy, np.log1p(lines), size / pl, 1 - np.bincount(line_row[twice], minlength=n) / pl, np.bincount(line_row[twice], weights=(line_stop - line_start)[twice], minlength=n) / per,
        np.bincount(rows, weights=length <= 3, minlength=n) / pw, np.bincount(line_row, weights=np.isin(tail, np.frombuffer(b".!?", np.uint8)), minlength=n) / pl,
        np.bincount(rows, weights=marked[ends] > marked[starts], minlength=n) / pw,
    )
    return np.where(size[:, None] > 0, np.stack(columns, axis=1), 0.0)


@dataclass
class Trees:
    """Boosted trees in flat arrays of shape (tree, node); node 0 is the root and leaves point to themselves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray  # left child; the right one follows it
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                first = self.child[trees, node]
                right = part[rows, self.feature[trees, node]] > self.limit[trees, node]
                node = np.where(first < 0, node, first + right)
            total[a : a + 4096] += self.value[trees, node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting with logistic loss."""
    share = float(np.mean(y)) if len(y) else 0.5
    width = 2 ** (depth + 1) - 1
    if not len(y) or not 0 < share < 1:
        none = np.zeros((0, width))
        return Trees(30.0 if share == 1 else -30.0 if share == 0 else 0.0, none.astype(np.int64), none, none.astype(np.int64), none, depth)
    base = float(np.log(share / (1 - share)))
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # x <= edges[k] <=> code <= k
    limits = np.full((f, bins), np.inf)
    for j, e in enumerate(edges):
        limits[j, : len(e)] = e
    feature, limit = np.zeros((trees, width), np.int64), np.full((trees, width), np.inf)
    child, value = np.full((trees, width), -1, np.int64), np.zeros((trees, width))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, level, count = np.zeros(len(y), np.int64), [0], 1
        for d in range(depth + 1):
            slot = np.full(width, -1)
            slot[level] = np.arange(len(level))
            mine = slot[node]
            live = np.flatnonzero(mine >= 0)
            sums_g, sums_h = (np.bincount(mine[live], weights=w[live], minlength=len(level)) for w in (g, h))
            value[t, level] = -rate * sums_g / (sums_h + ridge)
            if d == depth:
                break
            best, where = np.zeros(len(level)), np.full((len(level), 2), -1)
            for j in range(f):
                cell = mine[live] * bins + code[live, j]
                gl, hl = (np.bincount(cell, weights=w[live], minlength=bins * len(level)).reshape(-1, bins).cumsum(axis=1) for w in (g, h))
                gr, hr = sums_g[:, None] - gl, sums_h[:, None] - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (sums_g**2 / (sums_h + ridge))[:, None], 0.0)
                k = gain.argmax(axis=1)
                top = gain[np.arange(len(level)), k]
                better = top > best + 1e-9
                best[better], where[better, 0], where[better, 1] = top[better], j, k[better]
            following = []
            for s, nd in enumerate(level):
                j, k = where[s]
                if j < 0:
                    continue
                feature[t, nd], limit[t, nd], child[t, nd] = j, limits[j, k], count
                following += [count, count + 1]
                count += 2
            if not following:
                break
            moving = np.flatnonzero(child[t, node] >= 0)
            nd = node[moving]
            node[moving] = child[t, nd] + (x[moving, feature[t, nd]] > limit[t, nd])
            level = following
        margin += value[t, node]
    return Trees(base, feature, limit, child, value, depth)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.text_chunks(batch.column("text"), CHUNK):
            x = statistics(data, offsets)
            lists = K.list_array(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("y").slice(a, b - a), lists], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from docs(doc_id, text) and labels(doc_id, quality)."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("q"))
    usable = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("q").cast("double").alias("y"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` rows are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "y", "text")
    # one row for each chosen id, so at most `sample` rows reach the driver
    got = rows.mapInArrow(_with_statistics, "id long, y double, x array<double>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(y), len(NAMES)) if len(y) else np.zeros((0, len(NAMES)))
    order = np.lexsort((y, *x.T)) if len(y) else np.zeros(0, np.int64)  # the same trees whatever the order of arrival
    return fit(x[order], y[order])


def score(model: Trees, text: Column) -> Column:
    """Score of a text, 0 to 1 (higher: label 1 likelier). Only the text is sent to Python."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [model.score(statistics(data, offsets)) for _, _, data, offsets in K.text_chunks(texts, CHUNK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(train(docs, labels), F.col("text")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    name = fresh(docs, "score")
    return docs.withColumn(name, score(train(docs, labels), F.col("text"))).where(F.col(name) >= cut).drop(name)
