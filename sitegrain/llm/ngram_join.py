"""N-gram Jaccard join by prefix trees (operator 4).

A document's set holds its distinct 5-word shingles (A-Z lower-cased; a shorter text is one
shingle; no words, no set). Sets link when 100 * |intersection| >= 75 * |union|. The result is one
row per document with its component's smallest doc_id.

1. Each text becomes an ordered set: shingles by rising corpus frequency, then by hash. Frequencies
   are counted over all texts, in a table of SLOTS counters that shingles share by their hash, so its size is
   fixed; they steer the order, never the result. Equal sets are one node, named by the hash of the set.
2. Two linked sets must share a shingle among the first |x| - ceil(0.75 |x|) + 1 of each. Shingles
   that only one node has there are dropped.
3. Nodes that share their most frequent such shingles are put into tries, in blocks of bounded size
   that all hold the group's smallest node. A probe walks the trie depth first, sharing the overlap of
   common beginnings, and leaves a subtree when the remaining lengths cannot reach the threshold.
   This links nearly all of a family of copies without writing its pairs.
4. What is left are node pairs of different components that share a prefix shingle. Their shared prefix
   shingles and the places of the last one bound the overlap; pairs that can still reach the threshold are
   verified by the same trie walk. A pair that shares crowded shingles, which more than CROWD nodes have, is written
   for the first of them only, as far as that is among the first EARLY of both, and then verified without
   the count of what is shared. So no link between different components is lost.

Defined cases: null text is empty; documents without words are alone; repeated rows and equal texts
share a component; null doc_id gives a row with its component's smallest non-null doc_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Packed, Scratch, components, fresh, in_bitmap, key_bitmap, maybe_among, text_key

WORDS = 5
PERCENT = 75
#: Counters of the shingle order (16 MB, whatever the corpus); a shingle's is named by its leading bits, as bitmaps of keys use the last ones.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: Counters in one row of a task's counts.
SLOT_BLOCK = 1 << 12
#: Nodes in one trie, and shingles of all of them (a longer set is a block of its own, with the group's smallest node).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: A shingle that more nodes of different components share is crowded, and pairs look back at so many crowded ones before it.
CROWD, EARLY = 64, 16
#: Shingles in one batch of sets sent to the tries.
BATCH_SHINGLES = 1 << 18
#: Stands for a null doc_id in joins.
NONE = -(2**63)


def _prefix_len(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Order:
    """The global shingle order: by rising count of the shingle's slot, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts if counts.max() < 1 << 40 else np.minimum(counts, (1 << 40) - 1)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ordered distinct shingles of each text end to end, their offsets, and the node of each text."""
        n = len(offsets) - 1
        values, edges = K.distinct_by_row(*K.shingle_sets(data, offsets, WORDS), n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix64(values))])
        node = K.mix64(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(np.uint64))
        rows = np.repeat(np.arange(n), np.diff(edges))
        by_count = (rows << 40) + self.counts[_slot(values)]  # values of a row are in hash order already
        return values[np.argsort(by_count, kind="stable")], edges, K.to_signed(node)


def _digest(order_sent: Packed, percent: int):
    """Task: texts to (doc_id, key, node, n, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(order_sent.value)
        for batch in batches:
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                values, edges, node = order.sets(data, offsets)
                n = np.diff(edges)
                p = np.where(n > 0, _prefix_len(n, percent), 0)
                at = np.repeat(edges[:-1] - np.concatenate([[0], np.cumsum(p)[:-1]]), p) + np.arange(p.sum())
                prefix = K.list_array(K.to_signed(values[at]), np.concatenate([[0], np.cumsum(p)]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(node), pa.array(n.astype(np.int64)), prefix], ["doc_id", "key", "node", "n", "prefix"])

    return run


def _maybe_shared(bitmap: Packed, skip: Packed | None = None):
    """Task: (node, n, prefix) to one row for each prefix shingle whose bit is set; nodes in `skip` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skip:
                batch = batch.filter(pa.array(~in_bitmap(skip.value, batch.column("node").to_numpy())))
            tokens, length = batch.column("prefix").flatten().to_numpy(), batch.column("prefix").value_lengths().to_numpy()
            at = np.flatnonzero(in_bitmap(bitmap.value, tokens))
            row = np.repeat(np.arange(len(batch)), length)[at]
            pos = at - np.concatenate([[0], np.cumsum(length)])[row]
            node, n = batch.column("node").to_numpy()[row], batch.column("n").to_numpy()[row]
            for k in range(0, len(at), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(n[part]), pa.array(pos[part].astype(np.int32)), pa.array(tokens[at[part]])], ["node", "n", "pos", "token"])

    return run


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts to (block, counts) of all their shingles: SLOT_BLOCK counters in a row, in as few bytes each as the block's largest needs."""
    counts = np.zeros(SLOTS, np.uint64)
    for batch in batches:
        for _, _, data, offsets in K.text_chunks(batch.column("text")):
            np.add.at(counts, _slot(K.shingle_sets(data, offsets, WORDS)[1]), np.uint64(1))
    blocks = counts.reshape(-1, SLOT_BLOCK)
    for k in np.flatnonzero(blocks.any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(blocks[k])])], ["block", "counts"])


def _pack(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // SLOT_BLOCK}")


def _sum_block(table: pa.Table) -> pa.Table:
    """Task for one block: the sums of its counters."""
    counts = np.zeros(SLOT_BLOCK, np.uint64)
    for packed in table.column("counts"):
        counts += _unpack(packed.as_py())
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([_pack(counts)])})


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """The counts of the shingles of all texts of docs(text), by slot; SLOTS sums reach the driver, packed."""
    scratch, schema = Scratch(docs.sparkSession, "slots"), "block int, counts binary"
    sums = scratch.save(docs.select("text").mapInArrow(_slot_counts, schema).groupBy("block").applyInArrow(_sum_block, schema), "counts")
    counts = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.int64)
    for batch in sums.toArrow().to_batches():
        for k, packed in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            counts[k] = _unpack(packed.as_py())
    scratch.drop("counts")
    return counts.ravel()


def _blocks_of_sets(order_sent: Packed):
    """Task: (want, text) to (block, node, tokens): a row for each block that wants the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(order_sent.value)
        for batch in batches:
            named, want = batch.column("node").to_numpy(), batch.column("want")
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                values, edges, node = order.sets(data, offsets)
                lists = want.slice(a, b - a)
                flat = lists.flatten()
                rows = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                sure = node[rows] == named[a + rows]
                rows, flat = rows[sure], flat.filter(pa.array(sure))
                sets = K.list_array(K.to_signed(values), edges)
                held = np.concatenate([[0], np.cumsum(np.diff(edges)[rows])])
                k = 0
                while k < len(rows):
                    e = max(k + 1, int(np.searchsorted(held, held[k] + BATCH_SHINGLES, "right")) - 1)
                    part = slice(k, e)
                    yield pa.RecordBatch.from_arrays([flat.field(0).slice(k, e - k), flat.field(1).slice(k, e - k), pa.array(node[rows[part]]), sets.take(pa.array(rows[part]))], ["block", "probe", "node", "tokens"])
                    k = e

    return run


class Trie:
    """Ordered sets in a prefix tree whose runs of single children are one tree node.

    Tree node k holds tokens run[k] and its subtree is tree nodes k..end[k]-1; `most` and `least` are the
    largest and smallest set size in the subtree, and `owners[k]` the sets that end there.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        keys = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.run: list[np.ndarray] = []
        self.end: list[int] = []
        self.most: list[int] = []
        self.least: list[int] = []
        self.depth: list[int] = []
        self.owners: list[list[int]] = []
        todo: list[tuple[list[int], int, int]] = [(keys, 0, 0)]
        while todo:
            group, at, closing = todo.pop()
            if closing:  # the subtree of tree node closing-1 is complete
                self.end[closing - 1] = len(self.run)
                continue
            first, last = self.sets[group[0]], self.sets[group[-1]]
            top = min(len(self.sets[i]) for i in group)
            stop = at
            if len(group) == 1:
                stop = len(first)
            else:
                n = min(len(first), len(last))
                differ = np.flatnonzero(first[at:n] != last[at:n])
                stop = min(top, at + (int(differ[0]) if len(differ) else n - at))
            k = len(self.run)
            self.run.append(np.sort(first[at:stop]))
            self.end.append(0)
            self.depth.append(stop)
            sizes = [len(self.sets[i]) for i in group]
            self.most.append(max(sizes))
            self.least.append(min(sizes))
            self.owners.append([i for i in group if len(self.sets[i]) == stop])
            todo.append(([], 0, k + 1))
            rest = [i for i in group if len(self.sets[i]) > stop]
            heads: dict[int, list[int]] = {}
            for i in rest:
                heads.setdefault(int(self.sets[i][stop]), []).append(i)
            todo += [(g, stop, 0) for g in reversed(heads.values())]

    def search(self, x: np.ndarray, percent: int) -> list[int]:
        """Numbers of the sets that link with x (x itself among them, if it is in the tree)."""
        size, sorted_x, found = len(x), np.sort(x), []
        stack: list[tuple[int, int]] = []  # (end of subtree, overlap at its top)
        k = 0
        while k < len(self.run):
            while stack and stack[-1][0] <= k:
                stack.pop()
            above = stack[-1][1] if stack else 0
            run = self.run[k]
            i = np.searchsorted(sorted_x, run)
            i[i == size] = 0
            here = above + int((sorted_x[i] == run).sum()) if size else above
            # most that any set below can share with x, and least union that needs
            below = self.most[k] - self.depth[k]
            reach = here + min(below, size - here)
            need = -(-percent * (size + max(self.least[k], self.depth[k])) // (100 + percent))
            if reach < need:
                k = self.end[k]
                continue
            for j in self.owners[k]:
                if 100 * here >= percent * (size + len(self.sets[j]) - here):
                    found.append(j)
            stack.append((self.end[k], here))
            k += 1
        return found


def _link_block(percent: int):
    """Task for one block: spanning links of its linked sets.

    Rows with probe true are looked up; without any, every set is. A set that an earlier lookup already
    tied to the probe's component needs no second link.
    """

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        _, keep = np.unique(nodes, return_index=True)
        probes = table.column("probe").to_numpy(zero_copy_only=False)
        asked = {int(n) for n in nodes[probes]} if probes.any() else {int(n) for n in nodes}
        tokens = table.column("tokens").combine_chunks()
        names = nodes[keep].tolist()
        sets = [tokens[int(i)].values.to_numpy() for i in keep]
        trie, parent = Trie(sets), list(range(len(sets)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        a, b = [], []
        for i, name in enumerate(names):
            if name not in asked:
                continue
            for j in trie.search(sets[i], percent):
                if root(i) != root(j):
                    parent[root(i)] = root(j)
                    a.append(names[i])
                    b.append(names[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rows_of(spark: SparkSession, scratch: Scratch, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node, n) of each row of docs(doc_id, text), and (node, component), component the smallest node reached, of nodes with links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = Packed(spark, shingle_counts(docs))
    digest = docs.select("doc_id", text_key("text").alias("key"), "text").mapInArrow(_digest(order, percent), "doc_id long, key long, node long, n long, prefix array<long>")
    digest = scratch.save(digest, "digest")
    none = F.lit(NONE)
    full = digest.where("n > 0").withColumn("holder", F.coalesce("doc_id", none))
    holders = scratch.save(full.groupBy("node").agg(F.min("holder").alias("holder"), F.count("*").alias("copies")), "holders")
    # one row for each node; only rows that may be copies are joined
    bits = key_bitmap(holders.where("copies > 1").select("node"))
    copied, full = maybe_among(bits), full.select("node", "holder", "n", "prefix")
    one = full.where(copied("node")).join(holders.hint("merge"), ["node", "holder"], "left_semi")
    tokens = full.where(~copied("node")).union(one.select(*full.columns)).select(F.explode("prefix").alias("token"))
    shared = scratch.save(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    # most prefix shingles are not shared: a bitmap of fixed size drops nearly all of them before the exact join
    words, schema = key_bitmap(shared.select("token")), "node long, n long, pos int, token long"
    maybe = full.select("node", "n", "prefix").mapInArrow(_maybe_shared(words, bits), schema)
    maybe = maybe.union(one.select("node", "n", "prefix").mapInArrow(_maybe_shared(words), schema))
    near = maybe.join(shared.hint("merge"), "token").dropDuplicates(["token", "node"])
    near = near.withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1)  # shared ones before it
    near = scratch.save(near, "near")
    scratch.drop("shared")

    # tries of the nodes that share their most common prefix shingles, if they share many of them
    own = Window.partitionBy("node")
    many = near.withColumn("held", F.count("*").over(own)).where(F.col("held") * 10 >= 3 * (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    top = scratch.save(many.withColumn("r", F.row_number().over(own.orderBy(F.desc("df"), "token"))).where("r <= 2").select("token", "node", "n"), "top")
    groups = top.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("node").alias("center")).where("m > 1")
    groups = scratch.save(groups.select("token", "center", _parts("m", "size").alias("parts")), "groups")
    member = top.join(groups.hint("merge"), "token")
    placed = member.select("node", F.xxhash64("token", F.pmod(F.xxhash64("node", "token"), F.col("parts"))).alias("block"), F.lit(False).alias("probe"))
    centers = groups.select(F.col("center").alias("node"), "token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    centers = centers.select("node", F.xxhash64("token", "part").alias("block"), F.lit(False).alias("probe"))
    links = _verify(scratch, docs, holders, placed.union(centers), order, percent, "family")
    family = scratch.save(components(scratch, links, "family-cc"), "family")
    scratch.drop("top", "groups")

    # pairs of different components that share prefix shingles
    tagged = near.select("token", "node", "n", "pos", "before").join(family.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    tagged = scratch.save(tagged, "tagged")
    mixed = scratch.save(tagged.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "mixed")
    open_ = scratch.save(tagged.join(mixed.hint("merge"), "token", "left_semi"), "open")
    scratch.drop("near", "tagged", "mixed")
    crowded = open_.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("token", F.lit(True).alias("hot"))
    to_here = Window.partitionBy("node").orderBy("pos")
    seen = open_.join(crowded.hint("merge"), "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("nth", F.sum(F.col("hot").cast("int")).over(to_here))
    seen = seen.withColumn("early", F.collect_list(F.when(F.col("hot") & (F.col("nth") <= EARLY), F.col("token"))).over(to_here.rowsBetween(Window.unboundedPreceding, -1)))
    seen = scratch.save(seen.drop("nth"), "seen")
    x, y = (seen.select("token", *[F.col(c).alias(f"{k}_{c}") for c in ("node", "n", "pos", "before", "component", "hot", "early")]) for k in "ab")
    # all that two sets share before a shared shingle is shared by prefixes too; behind it, the shorter rest is the bound
    reach = F.least("a_before", "b_before") + 1 + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1
    met = x.join(y.hint("merge"), "token").where(((100 + percent) * reach >= percent * (F.col("a_n") + F.col("b_n"))) & (F.col("a_component") != F.col("b_component")) & (100 * F.col("a_n") >= percent * F.col("b_n")) & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))))
    met = met.where(~F.col("a_hot") | ~F.arrays_overlap("a_early", "b_early"))
    pairs = met.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.count("*").alias("c"), F.bool_or("a_hot").alias("hot"), F.first("a_n").alias("na"), F.first("b_n").alias("nb"), F.max("a_pos").alias("ia"), F.max("b_pos").alias("ib"))
    # what may still be shared: all after the last shared prefix shingle, and no more than lies behind the longer prefix
    after = F.least(F.col("na") - 1 - F.col("ia"), F.col("nb") - 1 - F.col("ib"), F.ceil(F.col("nb") * percent / 100) - 1)
    pairs = pairs.where(F.col("hot") | ((100 + percent) * (F.col("c") + after) >= percent * (F.col("na") + F.col("nb")))).select("a", "b", "nb")
    pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "nb").groupBy("a", "b").agg(F.max("nb").alias("nb")), "pairs")
    parts = scratch.save(pairs.groupBy("a").agg(F.count("*").alias("m"), F.sum("nb").alias("size")).select("a", _parts("m", "size").alias("parts")), "parts")
    numbered = pairs.join(parts.hint("merge"), "a").withColumn("block", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))))
    asked = numbered.select(F.col("a").alias("node"), "block", F.lit(True).alias("probe")).distinct()
    rest = numbered.select(F.col("b").alias("node"), "block", F.lit(False).alias("probe"))
    more = _verify(scratch, docs, holders, asked.union(rest), order, percent, "rest")
    whole = scratch.save(components(scratch, links.union(more), "all-cc"), "all")
    scratch.drop("open", "seen", "pairs", "parts", "family", "holders")
    return digest.select("doc_id", "key", "node", "n"), whole


def _parts(count: str, size: str) -> Column:
    """How many blocks a group of `count` nodes with `size` shingles is cut into."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("long")


def component_table(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text); see the module."""
    scratch = Scratch(spark, "ngram")
    rows, whole = _rows_of(spark, scratch, docs, percent)
    # the smallest doc_id of each node, then of each component: copies are counted as one before they meet
    nodes = scratch.save(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(whole.hint("merge"), "node", "left"), "nodes")
    first = scratch.save(nodes.where("component is not null").groupBy("component").agg(F.min("low").alias("first")), "first")
    named = nodes.where("component is not null").join(first.hint("merge"), "component").select("node", F.col("first").alias("component_id"))
    named = scratch.save(named.union(nodes.where("component is null").select("node", "low")), "named")
    full = rows.where("n > 0").join(named.hint("merge"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of docs, one for each component: that with the smallest doc_id, null being the largest, and then the smallest text hash.

    Of repeated rows with one doc_id and one text any one stays. Documents without words are no near copies of anything
    and stay. Rows are told apart by (doc_id, text), so rows that share a doc_id alone are judged each by its own text.
    """
    scratch = Scratch(spark, "keep")
    rows, whole = _rows_of(spark, scratch, docs, percent)
    seen = rows.where("n > 0").groupBy("node", "doc_id", "key").agg(F.count("*").alias("times"))
    seen = seen.join(whole.hint("merge"), "node", "left").select("doc_id", "key", "times", F.coalesce("component", "node").alias("component"))
    seen = scratch.save(seen.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")), "seen")
    first = scratch.save(seen.groupBy("component").agg(F.min("place").alias("first")), "first")
    acts = seen.join(first.hint("merge"), "component").select("doc_id", "key", "times", (F.col("place") != F.col("first")).alias("gone"))
    acts = scratch.save(acts.where("gone or times > 1").select(F.coalesce("doc_id", F.lit(NONE)).alias("id"), "key", "gone"), "acts")
    # only rows that may be touched are moved
    key, doc, gone = (fresh(docs, n) for n in ("row_key", "row_doc", "row_gone"))
    touched, marked = maybe_among(key_bitmap(acts.select("key"))), docs.withColumn(key, text_key("text"))
    named = acts.select(F.col("key").alias(key), F.col("id").alias(doc), F.col("gone").alias(gone)).hint("merge")
    moved = marked.where(touched(F.col(key))).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))).join(named, [key, doc], "left")
    names = docs.columns
    once = moved.where(F.col(gone) == F.lit(False)).dropDuplicates([key, doc])
    still = moved.where(F.col(gone).isNull()).unionByName(once)
    return marked.where(~touched(F.col(key))).drop(key).unionByName(still.drop(key, doc, gone)).select(*[F.col(f"`{n}`") for n in names])


def _verify(scratch: Scratch, docs: DataFrame, holders: DataFrame, placed: DataFrame, order: Packed, percent: int, name: str) -> DataFrame:
    """Links found by the tries of placed(node, block, probe)."""
    want = placed.groupBy("node").agg(F.collect_set(F.struct("block", "probe")).alias("want"))
    want = scratch.save(want.join(holders.select("node", "holder").hint("merge"), "node"), f"{name}-want")
    wanted = maybe_among(key_bitmap(want.select("holder")))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("holder"), "text").where(wanted("holder"))
    texts = keyed.join(want.hint("merge"), "holder").select("node", "want", "text")
    sets = texts.mapInArrow(_blocks_of_sets(order), "block long, probe boolean, node long, tokens array<long>")
    links = scratch.save(sets.groupBy("block").applyInArrow(_link_block(percent), "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-want")
    return links
