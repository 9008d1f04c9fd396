"""Merkle manifest of a table of documents (operator 12).

A leaf is the SHA-256 of a row's doc_id, source, lang, n_chars and text; runs of `fanout` consecutive nodes are hashed into
parents, first within each source (leaves in order of doc_id) up to one subroot, then over the subroots in order of source up
to one root. A proof lists a leaf's siblings, level by level.

Leaves are dealt out by ranges of (source, doc_id, leaf) and numbered by row_number within each part, plus the number of the
source's rows in the parts before; no window spans a source. Every level is a table of its own: indices divided by the fanout
give the parents, whose children are gathered as sorted arrays of at most `fanout` digests. Proofs are made from the root down:
one join for each level appends the run that a node stands in to the path of its parent, so that a path is built once for all
rows below a node. Each level is written to the shared folder; the number of levels is the logarithm of the largest source.

Defined cases: a null field is hashed as `-`; null sources come first, null doc_ids too; rows of one doc_id are ordered by
their leaf, and equal rows have equal leaves but places of their own; a lone leaf is its source's subroot, and a lone subroot the
root, with nothing in between; without siblings a proof is the digest of the empty string; an empty table gives an empty result;
other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at:int,run:array<string>>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**values: Column) -> Column:
    """Digest of a row's fields; `values` replaces columns."""

    def field(name: str) -> Column:
        value = values.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[field(f) for f in FIELDS])


def number(scratch: Scratch, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with i, the place (from 0) by `order` within the group g, and n, the group's size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("g"), *order]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumn("part", F.shiftright("place", 33)), f"{name}-dealt")
    sizes = dealt.groupBy("g", "part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy("g")
    sizes = sizes.withColumn("n", F.sum("size").over(whole)).withColumn("before", F.sum("size").over(whole.orderBy("part")) - F.col("size")).drop("size")
    own = F.row_number().over(Window.partitionBy("g", "part").orderBy("place")) - 1
    return dealt.withColumn("i", own).join(sizes, ["g", "part"]).withColumn("i", F.col("i") + F.col("before")).drop("place", "part", "before")


def climb(scratch: Scratch, level: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Levels of nodes (g, i, n, digest), the given one first; all above it also have kids, the digests below."""
    levels = [level]
    most = level.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].where("n > 1").select("g", "n", "digest", "i", F.expr(f"i div {fanout}").alias("up"))
        up = below.groupBy("g", "up").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("kids"))
        up = up.select("g", F.col("up").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.transform("kids", lambda x: x["digest"]).alias("kids"))
        levels.append(scratch.save(up.withColumn("digest", digest(F.array_join("kids", ""))), f"{name}-{len(levels)}"))
        most = -(-most // fanout)
    return levels


def descend(scratch: Scratch, levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """The lowest level with path, the (place, run) of each level from the node up, and what `tops` holds besides (g, path).

    tops: a row for each group, with the path above its last node.
    """
    told = [c for c in tops.columns if c not in ("g", "path")]
    above = None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        here = nodes.where("n = 1").join(tops, "g")
        if above is not None:
            up = above.select("g", F.col("i").alias("up"), F.col("kids").alias("run"), F.col("path").alias("above"), *told)
            step = F.array(F.struct(F.expr(f"cast(i % {fanout} AS int)").alias("at"), F.col("run")))
            joined = nodes.where("n > 1").withColumn("up", F.expr(f"i div {fanout}")).join(up, ["g", "up"])
            here = here.unionByName(joined.withColumn("path", F.concat(step, "above")).drop("up", "run", "above"))
        above = scratch.save(here, f"{name}-path-{k}") if k else here
    return above


def siblings(path: Column) -> Column:
    """All digests beside the path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda step: F.filter(step["run"], lambda _, j: j != step["at"])))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the runs of its path lead to."""
    return F.aggregate(path, start, lambda below, step: digest(F.array_join(F.transform(step["run"], lambda d, j: F.when(j == step["at"], below).otherwise(d)), "")))


def build(spark: SparkSession, docs: DataFrame, fanout: int = FANOUT, **more: Column) -> DataFrame:
    """A row for each of docs: doc_id, source, leaf, path, subroot, root; `more` names further columns made from a row's own."""
    scratch = Scratch(spark, "manifest")
    group = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null first, else by bytes
    rows = docs.select(*FIELDS).select(F.col("doc_id"), group.alias("g"), leaf().alias("digest"), *[c.alias(k) for k, c in more.items()])
    rows = scratch.save(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    leaves = scratch.save(number(scratch, rows, [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("salt")], "leaves").drop("salt"), "leaves-0")
    levels = climb(scratch, leaves, fanout, "leaves")
    subroots = None
    for level in levels:
        tops = level.where("n = 1").select("g", "digest")
        subroots = tops if subroots is None else subroots.unionByName(tops)
    sources = number(scratch, subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest"), [F.col("source")], "sources")
    upper = climb(scratch, scratch.save(sources, "sources-0"), fanout, "sources")
    root = upper[-1].select("g", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = descend(scratch, upper, root, fanout, "sources").select(F.col("source").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    paths = descend(scratch, levels, scratch.save(tops, "tops"), fanout, "leaves")
    scratch.drop("leaves", "leaves-dealt", "sources-dealt")
    source = F.when(F.col("g") != "", F.substr("g", F.lit(2)))
    return paths.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), "path", "subroot", "root", *more)


def verified_table(spark: SparkSession, docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of docs, checked against texts of which those of a fifth of the doc_ids are lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    forged = F.when(tampered & F.col("text").isNotNull(), leaf(text=F.translate("text", UPPER, LOWER)))
    rows = build(spark, docs, fanout, forged=forged)
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(F.array_join(siblings(F.col("path")), "")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
