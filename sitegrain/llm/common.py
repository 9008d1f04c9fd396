"""Shared Spark helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a task of a written table sends to Python at a time.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Bits of a bitmap of keys (16 MB, whatever the corpus).
BITMAP_BITS = 1 << 27


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh local one only where that is unset and Spark runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sitegrain-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/sitegrain/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(BATCH_CONF)
        conf.set(BATCH_CONF, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(BATCH_CONF, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Packed:
    """An array of 64-bit integers that is broadcast packed, so that one with few entries takes few bytes on every executor; `value` unpacks it once a task."""

    def __init__(self, spark: SparkSession, array: np.ndarray):
        self.sent: Broadcast = spark.sparkContext.broadcast(zlib.compress(array.astype(np.int64).tobytes(), 1))
        self._array: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "_array": None}

    @property
    def value(self) -> np.ndarray:
        if self._array is None:
            self._array = np.frombuffer(zlib.decompress(self.sent.value), np.int64)
        return self._array


def key_bitmap(keys: DataFrame) -> Packed:
    """A bitmap of BITMAP_BITS bits in 64-bit words: the only column of `keys`, 64-bit, modulo its length."""
    spark = keys.sparkSession
    cells = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(BITMAP_BITS)).alias("cell"))
    words = cells.groupBy(F.expr("cell div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 AS int)))").alias("bits")).toArrow()
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return Packed(spark, bits)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = np.mod(keys, BITMAP_BITS)
    return (bits[cell >> 6] >> (cell & 63)) & 1 == 1


def maybe_among(bitmap: Packed) -> Callable[[Column | str], Column]:
    """A test of 64-bit keys against a key_bitmap: false only for keys that are not in it.

    An exact join after it moves few other rows; with very many keys it lets all pass, and the join moves them all.
    """

    @F.arrow_udf("boolean")
    def among(x: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bitmap.value, x.to_numpy(zero_copy_only=False)))

    return among


def merged_spans(spans: Column) -> Column:
    """Array of (a, b) spans joined where they touch or overlap, in order."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["b"], F.lit(-1))),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )


def text_key(text: str | Column) -> Column:
    """64-bit key of a text (null as empty); two of n texts share one by chance n*n/2**65."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """Connected components of links(a, b): (node, component), component the smallest node reached.

    Alternates large-star and small-star steps, whose rounds grow with the logarithm of the
    number of nodes, and writes each round to the shared folder. Only nodes with links are returned.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    turn = 0
    state = None
    while True:
        turn += 1
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select("v", "u", "m")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.save(nxt, f"{name}-{turn}")
        summary = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}-{turn - 1}")
        edges = new
        if summary == state:
            break
        state = summary
    scratch.drop(*[f"{name}-{k}" for k in range(turn)])
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
