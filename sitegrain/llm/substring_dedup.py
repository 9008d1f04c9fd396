"""Substring dedup over a log-structured fingerprint index (operator 7).

Words are runs of anything but the six ASCII blanks. Each 35-word window is represented by
its smallest inner 8-word hash (leftmost on ties), so equal windows always pick the same
fingerprint at the same distance. The corpus arrives in batches. A batch's fingerprints are
pre-aggregated and written as an immutable run, bucketed and sorted by fingerprint; the run is
merge-joined with every older run, which finds the fingerprints that occur in more than one
place, and runs of like size are compacted into one. Fingerprints found twice name candidate
windows; these are verified by the hash of all their 35 words (96 bits) before anything is removed.

Equal texts are one text that occurs several times: their windows are looked up once.

Defined cases: null text has no words; texts shorter than a window lose nothing; a repeated row
counts as another copy; an empty table gives an empty result; columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Packed, Scratch, in_bitmap, key_bitmap, maybe_among, text_key

GRAM = 8
BATCHES = 3


class FingerprintIndex:
    """Sorted immutable runs of (fp, lo, hi): the smallest and largest place hash of a fingerprint.

    hi is null where all occurrences seen by the run are one place.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int):
        self.spark, self.scratch, self.buckets = spark, scratch, buckets
        self.runs: list[tuple[int, str]] = []  # (number of batches in it, table)

    def _write(self, rows: DataFrame, batches: int) -> str:
        name = f"sitegrain_run_{uuid.uuid4().hex[:12]}"
        rows = rows.select("fp", "lo", F.when(F.col("hi") != F.col("lo"), F.col("hi")).alias("hi"))
        (rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.root}/{name}")
         .bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name))
        self.runs.append((batches, name))
        return name

    def add(self, places: DataFrame) -> list[DataFrame]:
        """Adds a batch places(fp, key, pos); returns tables of the fingerprints now known at two places or more."""
        loc = F.xxhash64("key", "pos")
        run = places.groupBy("fp").agg(F.min(loc).alias("lo"), F.max(loc).alias("hi"))
        older = [self.spark.table(t) for _, t in self.runs]
        new = self.spark.table(self._write(run, 1))
        found = [new.where("hi is not null").select("fp")]
        for old in older:
            o = old.select("fp", F.col("lo").alias("olo"))
            found.append(new.join(o.hint("merge"), "fp").where("lo <> olo").select("fp"))
        return found

    def compact(self) -> None:
        """Merges the newest runs while they hold as many batches as the one before them."""
        while len(self.runs) > 1 and self.runs[-1][0] >= self.runs[-2][0]:
            (n, a), (m, b) = self.runs.pop(), self.runs.pop()
            both = self.spark.table(a).union(self.spark.table(b))
            merged = both.groupBy("fp").agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi"))
            self._write(merged, n + m)
            for name in (a, b):
                self.drop_table(name)

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def close(self) -> None:
        for _, name in self.runs:
            self.drop_table(name)
        self.runs = []


def _places(window: int):
    """Task: texts to (fp, key, pos): the places of the windows' fingerprints."""
    schema = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])
    gram = min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in K.text_chunks(batch.column("text")):
                h, rows, _, _ = K.word_hashes(data, offsets, False)
                if len(h) < window:
                    continue
                g = K.gram_hashes(h, gram)
                at = K.sliding_argmin(g, window - gram + 1)
                at = np.unique(at[rows[: len(at)] == rows[window - 1 :]])
                first = np.searchsorted(rows, rows[at])
                key, pos = keys[a + rows[at]], (at - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(K.to_signed(g[at])), pa.array(key), pa.array(pos)], schema=schema)

    return run


def _candidate_windows(window: int):
    """Task: texts with the positions of suspect fingerprints to the hashes of the windows they stand for."""
    schema = pa.schema([("w", pa.int64()), ("v", pa.int32()), ("key", pa.int64()), ("start", pa.int32())])
    gram = min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            wanted, edges = batch.column("places").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column("places").value_lengths().to_numpy(zero_copy_only=False))])
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                h, rows, _, _ = K.word_hashes(data, offsets, False)
                if len(h) < window:
                    continue
                at = K.sliding_argmin(K.gram_hashes(h, gram), window - gram + 1)
                first = np.searchsorted(rows, np.arange(b - a))
                suspect = np.zeros(len(h), bool)
                suspect[wanted[edges[a] : edges[b]] + np.repeat(first, np.diff(edges[a : b + 1]))] = True
                start = np.flatnonzero(suspect[at] & (rows[: len(at)] == rows[window - 1 :]))
                w = K.gram_hashes(h, window)[start]
                v = (K.gram_hashes(h, window, np.uint64(0xC2B2AE3D27D4EB4F))[start] >> np.uint64(33)).astype(np.int32)
                key, pos = keys[a + rows[start]], (start - first[rows[start]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(K.to_signed(w)), pa.array(v), pa.array(key), pa.array(pos)], schema=schema)

    return run


def _cut(window: int, texts: bool, skip: Packed | None = None):
    """Task: texts with their repeated windows to the words kept; keys in `skip` are left out, and all else is without repeats."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept_text", pa.string())] if texts else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skip:
                batch = batch.filter(pa.array(~in_bitmap(skip.value, batch.column("key").to_numpy())))
            ids = batch.column("doc_id")
            copies, lists = (None, None) if skip else (batch.column("copied").to_pylist(), batch.column("starts"))
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                starts, ends, rows = K.word_spans(data, offsets)
                edge = np.searchsorted(rows, np.arange(b - a + 1))
                raw, out = data.tobytes(), []
                for i in range(b - a):
                    s, e, hit = starts[edge[i] : edge[i + 1]], ends[edge[i] : edge[i + 1]], lists[a + i].as_py() if lists is not None else None
                    n = len(s)
                    gone = np.zeros(n + 1, np.int32)
                    if n >= window and copies and copies[a + i]:
                        keep = []
                    else:
                        if hit:
                            np.add.at(gone, hit, 1)
                            np.add.at(gone, np.array(hit) + window, -1)
                        keep = np.flatnonzero(np.cumsum(gone[:n]) == 0)
                    text = b" ".join([raw[p:q] for p, q in zip(s[keep].tolist(), e[keep].tolist(), strict=True)]) if len(keep) else b""
                    out.append((n, n - len(keep), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")))
                n, removed, digest, kept = zip(*out, strict=True)
                columns = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept)] if texts else []), schema=schema)

    return run


def dedup(spark: SparkSession, docs: DataFrame, window: int = 35, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of docs(doc_id, text); see the module."""
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", text_key("text").alias("key"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index, postings, found = FingerprintIndex(spark, scratch, buckets), [], []
    for n in range(batches):
        batch = keyed.where(F.pmod("key", F.lit(batches)) == n)  # copies of a text arrive together
        rows = batch.select("key", "text").mapInArrow(_places(window), "fp long, key long, pos int")
        rows = scratch.save(rows, f"postings-{n}")
        postings.append(rows)
        found += [scratch.save(f, f"found-{n}-{k}") for k, f in enumerate(index.add(rows))]
        if n < batches - 1:
            index.compact()
    all_postings, twice = postings[0], found[0]
    for p in postings[1:]:
        all_postings = all_postings.union(p)
    for f in found[1:]:
        twice = twice.union(f)
    twice = scratch.save(twice.distinct(), "twice")
    index.close()
    suspects = all_postings.join(twice.hint("merge"), "fp", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("places"))
    suspects = scratch.save(suspects, "suspects")
    scratch.drop("twice", *[f"postings-{n}" for n in range(batches)])
    # one row for each suspect text, its copies apart; other texts are not moved
    none, sought = F.lit(-(2**63)), maybe_among(key_bitmap(suspects.select("key")))
    some = keyed.where(sought("key")).withColumn("id", F.coalesce("doc_id", none))
    chosen = some.groupBy("key").agg(F.min("id").alias("id"))
    named = scratch.save(suspects.join(chosen.hint("merge"), "key"), "named")
    one = some.join(named.hint("merge"), ["key", "id"])
    windows = one.select("key", "places", "text").mapInArrow(_candidate_windows(window), "w long, v int, key long, start int")
    windows = scratch.save(windows, "windows")
    loc = F.xxhash64("key", "start")
    again = scratch.save(windows.groupBy("w", "v").agg(F.min(loc).alias("lo"), F.max(loc).alias("hi")).where("lo <> hi").select("w", "v"), "again")
    marks = windows.join(again.hint("merge"), ["w", "v"], "left_semi").groupBy("key").agg(F.collect_set("start").alias("starts"))
    copied = keyed.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    marks = scratch.save(marks.join(copied, "key", "full_outer"), "marks")
    scratch.drop("suspects", "named", "windows", "again", *[f"found-{n}-{k}" for n in range(batches) for k in range(n + 1)])
    bits = key_bitmap(marks.select("key"))
    moved = keyed.where(maybe_among(bits)("key")).join(marks.hint("merge"), "key", "left")
    moved = moved.select("doc_id", "key", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    # texts without repeats are not moved
    return moved.mapInArrow(_cut(window, texts), schema).union(keyed.mapInArrow(_cut(window, texts, bits), schema))
