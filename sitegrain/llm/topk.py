"""Exact top-k search by distributed histogram selection (operator 3).

Components become floor(256 * x). Queries go out in blocks of BLOCK vectors (a bounded broadcast). For each
block every task scores its vectors against all queries of the block by matrix products and counts the
scores in BINS bins a query; only bins from the task's own k-th value up are sent, so at most k rows a query
and task. The summed histograms give the bin of each query's k-th value; the bin is then cut into BINS bins
again, until bins are single scores. A last pass keeps what is above the k-th value and, of those equal to
it, the smallest ids that are still wanted. Ties so end by the smaller id.

Products are taken in doubles where that is exact (sums below 2**53) and in 64-bit integers otherwise;
vectors whose scores could pass 2**62 are refused with an error.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows
with a null id; shorter vectors are filled up with zeros; rows repeated with the same id are candidates as
often as they occur, though never for their own id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 2048
BINS = 2048
#: Scores held at a time.
CELLS = 1 << 21


def _matrix(column: pa.Array, dim: int, exact: bool) -> np.ndarray:
    """Rows of quantised components, filled up with zeros to `dim`."""
    n = len(column)
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, dim), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    out[np.repeat(np.arange(n), length), at] = flat
    return out.astype(np.float64) if exact else out


def _scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores[query, row], usable[query, row]) of slices of the batches."""
    step = max(1, CELLS // max(1, len(queries)))
    exact = queries.dtype == np.float64
    for batch in batches:
        for a in range(0, len(batch), step):
            part = batch.slice(a, step)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            scores = queries @ _matrix(part.column("q"), queries.shape[1], exact).T
            yield ids, scores.astype(np.int64), own[:, None] != ids[None, :]


def _histogram(queries: np.ndarray, own: np.ndarray, low: np.ndarray, span: np.ndarray, want: np.ndarray):
    """Task: counts (query, bin, n) of the scores in [low, low + span), the top bins only."""
    width = -(-span // BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(own), BINS), np.int64)
        for _, scores, usable in _scores(batches, queries, own):
            above = scores - low[:, None]
            q, _ = np.nonzero(inside := usable & (above >= 0) & (above < span[:, None]))
            b = above // width[:, None]
            counts += np.bincount(q * BINS + b[inside], minlength=counts.size).reshape(counts.shape)
        top = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts  # what the task has in higher bins
        q, b = np.nonzero((counts > 0) & (top < want[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["query", "bin", "n"])

    return run


def _keep(queries: np.ndarray, own: np.ndarray, kth: np.ndarray, ties: np.ndarray):
    """Task: (query, vec_id, score) above the k-th score, and the smallest ids of those equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(own)
        for ids, scores, usable in _scores(batches, queries, own):
            q, c = np.nonzero(usable & (scores > kth[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[c]), pa.array(scores[q, c])], ["query", "vec_id", "score"])
            q, c = np.nonzero(usable & (scores == kth[:, None]))
            edges = np.searchsorted(q, np.arange(len(own) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                best[i] = np.sort(np.concatenate([best[i], ids[c[edges[i] : edges[i + 1]]]]))[: ties[i]]
        q = np.repeat(np.arange(len(own)), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.concatenate(best) if best else np.zeros(0, np.int64)), pa.array(kth[q])], ["query", "vec_id", "score"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding); queries have vec_id divisible by `every`."""
    x = F.col("embedding")
    sound = x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound)
    rows = rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256)).alias("q"))
    size, most = rows.agg(F.max(F.size("q")), F.max(F.greatest(F.lit(0), F.array_max(F.transform("q", F.abs))))).first()
    dim, most = max(1, size or 0), most or 0
    bound = dim * most * most
    if bound >= 2**62:
        raise ValueError("embedding components are too large for 64-bit scores")
    exact = bound < 2**53
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    # blocks of queries, by ranges of the query ids
    total = asked.count()
    blocks = max(1, -(-total // (BLOCK * 3 // 4)))
    cuts = asked.select(F.percentile_approx("vec_id", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []))
    scratch, parts = Scratch(spark, "topk"), 0
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        block = asked
        if lo is not None:
            block = block.where(F.col("vec_id") > lo)
        if hi is not None:
            block = block.where(F.col("vec_id") <= hi)
        # written at once: the plan of the result stays one scan, whatever the number of blocks
        scratch.save(_block(spark, rows, block.toArrow(), dim, bound, exact, k), f"found/block={parts}")
        parts += 1
    out = spark.read.schema("query_id long, vec_id long, score long").parquet(*[f"{scratch.root}/found/block={n}" for n in range(parts)])
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(spark: SparkSession, rows: DataFrame, block: pa.Table, dim: int, bound: int, exact: bool, k: int) -> DataFrame:
    names = block.column("vec_id").to_numpy()
    names, first = np.unique(names, return_index=True)
    queries = _matrix(block.column("q").combine_chunks(), dim, exact)[first] if len(names) else np.zeros((0, dim))
    n = len(names)
    low, span = np.full(n, -bound), np.full(n, 2 * bound + 1)
    want = np.full(n, k)
    kth, ties = np.full(n, -bound - 1), np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        # all that a query has is in its range at first; later the k-th value is known to be in it
        counted = rows.mapInArrow(_histogram(queries[live], names[live], low[live], span[live], want[live]), "query int, bin int, n long")
        sums = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        running = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))
        need = spark.createDataFrame([(i, int(want[j])) for i, j in enumerate(live)], "query int, want int")
        hit = sums.withColumn("top", running).join(F.broadcast(need), "query").where("top >= want and top - n < want").toPandas()
        done = []
        seen = set()
        for q, b, c, top in zip(hit["query"], hit["bin"], hit["n"], hit["top"], strict=True):
            j = live[q]
            seen.add(int(q))
            want[j] -= top - c
            width = -(-span[j] // BINS)
            low[j] += b * width
            span[j] = min(width, span[j] - b * width)
            if width == 1:
                kth[j], ties[j] = low[j], want[j]
                done.append(int(q))
        # a query with fewer than k candidates keeps them all: its k-th value stays below every score
        live = np.array([j for i, j in enumerate(live) if i in seen and i not in done], np.int64)
    kept = rows.mapInArrow(_keep(queries, names, kth, ties), "query int, vec_id long, score long")
    named = spark.createDataFrame(pa.table({"query": pa.array(np.arange(n), pa.int32()), "query_id": pa.array(names, pa.int64())}).to_pandas(), "query int, query_id long")
    return kept.join(F.broadcast(named), "query").select("query_id", "vec_id", "score")
