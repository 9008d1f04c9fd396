"""Document fingerprints: bottom-k sketches of 5-word shingle hashes (operator 2).

A sketch holds the K_SIZE smallest distinct 48-bit shingle hashes of a text, ascending, so sketches of the
parts of a text set merge by uniting them and cutting back. As a string it is base64 of six bytes for each
hash, big-endian. From two sketches: resemblance is the share of the K_SIZE smallest of their union that
both hold; containment divides the shared hashes below both cut-offs by those of the first; the
number of distinct shingles is (K_SIZE - 1) / the largest hash as a share of the range. Sketches that are
not full hold every shingle, and their figures are exact (but for hash collisions).

Words are those between the six ASCII blanks, with A-Z lower-cased; a text of fewer words is one shingle.

Defined cases: null text is empty and has the empty sketch; two empty sketches are alike (1), an empty and
a non-empty one are not (0); rows are ordered by doc_id, then text, nulls first, so repeated doc_ids follow
each other; a single row is followed by itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

K_SIZE = 256
BITS = 48


def sketches(texts: list[str], k: int = K_SIZE) -> list[np.ndarray]:
    """The sketch of each text."""
    out: list[np.ndarray] = []
    column = pa.array(texts, pa.large_string())
    for a, b, data, offsets in K.text_chunks(column):
        rows, grams = K.shingle_sets(data, offsets)
        values, edges = K.distinct_by_row(rows, K.mix64(grams) >> np.uint64(64 - BITS), b - a)
        out += [values[edges[i] : min(edges[i] + k, edges[i + 1])] for i in range(b - a)]
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K_SIZE) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K_SIZE) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    union = merge(a, b, k)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, union[-1], "right") / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K_SIZE) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    limit = min(a[-1] if len(a) == k else np.uint64(2**BITS), b[-1] if len(b) == k else np.uint64(2**BITS))
    own = a[a <= limit]
    return float(len(np.intersect1d(own, b, assume_unique=True)) / len(own)) if len(own) else 0.0


def distinct_shingles(a: np.ndarray, k: int = K_SIZE) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**BITS)


def _with_next(k: int):
    """Task: rows in order, each bucket ending with the row that follows it, to fingerprints."""

    def emit(rows: list[tuple[int | None, str, bool]]) -> pa.RecordBatch | None:
        """rows: (doc_id, text, only a follower); the last row waits for its follower."""
        texts, edited = [r[1] for r in rows], []
        for (_, text, tail), (_, nxt, _) in zip(rows[:-1], rows[1:], strict=True):
            cut = len(text) // 4
            edited.append(text if tail else text[: len(text) - cut] + nxt[:cut])
        own, changed = sketches(texts, k), sketches(edited, k)
        out = []
        for i, (doc, text, tail) in enumerate(rows[:-1]):
            if not tail:
                out.append((doc, len(text), hashlib.sha256(edited[i].encode()).hexdigest(), to_text(own[i]), to_text(changed[i]), resemblance(own[i], changed[i], k), resemblance(own[i], own[i + 1], k)))
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, bool]] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                held.append(row)
                size += len(row[1])
                if size > 1 << 20 and len(held) > 1:
                    if (out := emit(held)) is not None:
                        yield out
                    held, size = held[-1:], 0
        if len(held) > 1 and (out := emit(held)) is not None:
            yield out

    return run


def fingerprint_table(spark: SparkSession, docs: DataFrame, k: int = K_SIZE) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts; see the module.

    The order by doc_id is cut into ranges at approximate quantiles; the first row of each range (and the first
    of all, for the last) also goes to the range before it, so no window spans the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 50 * parts).alias("q")).first()["q"] or []
    points = sorted(set(points))
    part = F.lit(0) if not points else F.when(F.col("doc_id").isNull(), 0).otherwise(_rank(F.col("doc_id"), points))
    rows = rows.withColumn("part", part.cast("int")).withColumn("tail", F.lit(False))
    heads = rows.groupBy("part").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"))).alias("m")).collect()  # a number for each range
    heads = sorted((r["part"], r["m"]["d"]) for r in heads)
    if not heads:
        none = rows.mapInArrow(_with_next(k), _SCHEMA)
        return none
    follow = [(d, heads[i - 1][0]) for i, (_, d) in enumerate(heads)]  # i = 0: the last range
    table = spark.createDataFrame(follow, "d long, to int")
    extra = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).join(F.broadcast(table), "d")
    extra = extra.groupBy("d", "to").agg(F.min_by(F.struct("doc_id", "text"), F.col("text")).alias("x"))
    extra = extra.select("x.doc_id", "x.text", F.col("to").alias("part"), F.lit(True).alias("tail"))
    both = rows.unionByName(extra).repartition(parts, "part").sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "text")
    return both.select("doc_id", "text", "tail").mapInArrow(_with_next(k), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rank(value, points: list[int]):
    """Number of sorted points that are at most value, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(points[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(points))
