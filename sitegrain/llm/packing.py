"""Best-fit packing of documents into fixed token sequences (operator 5).

A document's ids are those of the tokenizer file, without special tokens, and then id 0. A document of
more than `capacity` ids is cut into pieces of `capacity`; its first piece may be shorter.

Best-fit decreasing runs over the counts of each length, at most `capacity` numbers, so the driver holds no
document. A segment tree over remaining capacities gives the tightest open bin that fits in logarithmic
time; bins of equal remaining capacity stand together, and equal lengths fill them run by run, exactly as
one by one. The plan is a short list of runs for each length (bounded by capacity, not by the corpus). Each
piece finds its place by its number among the pieces of its length, which are counted in salted buckets.

Defined cases: null and empty texts are one piece, the id 0; repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns are ignored. The string of a special token in
a text is read as the tokenizer's default does.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import pretokens
from .common import Scratch

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [str(x.content).encode() for x in t.get_added_tokens_decoder().values()]

    def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ids, n = data.tobytes(), [], []
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        for k in range(0, len(spans), 20_000):
            for e in t.encode_batch([raw[p:q].decode() for p, q in spans[k : k + 20_000]], add_special_tokens=False):
                x = e.ids
                ids += x
                n.append(len(x))
        return np.array(ids, np.int32), np.array(n, np.int64)

    return t, special, pretokens.Cache(encode)


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    """The tokenizer's ids of each text, unsigned 32-bit."""
    t, special, cache = _tokenizer(path)
    raw, n = data.tobytes(), len(offsets) - 1
    if len(data):
        starts, ends, rows = pretokens.split(data, offsets)
        ids, counts = pretokens.gather(cache.edges, cache.ids, slots) if len(slots := cache.look_up(data, starts, ends)) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        edges = np.concatenate([[0], np.cumsum(np.bincount(rows, weights=counts, minlength=n).astype(np.int64))])
        ids = ids.astype("<u4")
        out = [ids[edges[i] : edges[i + 1]] for i in range(n)]
    else:
        out = [np.zeros(0, "<u4")] * n
    if any(s in raw for s in special):
        for i in range(n):
            text = raw[offsets[i] : offsets[i + 1]]
            if any(s in text for s in special):
                out[i] = np.array(t.encode(text.decode(), add_special_tokens=False).ids, "<u4")
    return out


def _pieces(path: str, capacity: int):
    """Task: texts to (doc_id, piece, start, length, ids_crc32)."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                out = []
                for doc, ids in zip(names[a:b], token_ids(data, offsets, path), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    for k, (p, q) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        out.append((doc, k, p, q - p, zlib.crc32(ids[p:q].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return run


class _Capacities:
    """Segment tree over remaining capacities 0..n: how many open runs of bins each has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, at: int, by: int) -> None:
        i = at + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least `least` that has an open bin."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length, runs (first item, first bin, items per bin, offset in the bin); and the number of bins."""
    tree, groups, bins = _Capacities(capacity), {}, 0
    plan: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, item, runs = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = groups[room].pop()
                tree.add(room, -1)
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((item, first, per, capacity - room))
                put(room - per * length, first, full)
                item, left, first, n = item + full * per, left - full * per, first + full, n - full
            if n and 0 < left < per:
                runs.append((item, first, left, capacity - room))
                put(room - left * length, first, 1)
                item, left, first, n = item + left, 0, first + 1, n - 1
            put(room, first, n)
        plan[length] = runs
    return plan, bins


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of docs(doc_id, text); see the module."""
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = rows.mapInArrow(_pieces(path or public_tokenizers.path(TOKENIZER), capacity), schema)
    pieces = scratch.save(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    sums = scratch.save(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = best_fit_decreasing(counts, capacity)
    runs = spark.createDataFrame([(n, r) for n, r in plan.items()], "length long, runs array<struct<item:long,bin:long,per:long,at:long>>")
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    placed = pieces.withColumn("k", F.row_number().over(own) - 1).join(before, ["length", "salt"]).join(F.broadcast(runs), "length")
    item = F.col("k") + F.col("before")
    placed = placed.withColumn("item", item).withColumn("r", F.element_at(F.filter("runs", lambda r: r["item"] <= F.col("item")), -1))
    step = F.col("item") - F.col("r.item")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("r.bin") + F.floor(step / F.col("r.per"))).alias("sequence_id"),
        (F.col("r.at") + F.pmod(step, F.col("r.per")) * F.col("length")).alias("offset"),
    )
