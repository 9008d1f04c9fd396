"""Suffix-array dedup of repeated byte strings (operator 8).

Every `size`-byte string of a text contains one anchor, the place of its smallest inner 32-byte
hash (leftmost on ties); equal strings have their anchors at the same distance. So two equal
strings always meet in the group of their anchor's hash, and it is enough to look at the text
around each anchor: at most size-32 bytes before it and size bytes from it on.

In each group the suffixes that begin at the anchors are put in a suffix array with the common
prefix lengths of neighbours. A stack scan builds the tree of common-prefix intervals. Within an
interval whose suffixes share r bytes, the texts before the anchors are compared as well: an
occurrence whose longest left match in the interval is l bytes is covered from l bytes before to
r bytes after the anchor if l + r >= size. Intervals whose members all agree on the left extend
as far as the context reaches; where they differ, each class of equal left extension is a
maximal repeat, and all its occurrences are reported, not only neighbours.

Groups are built over distinct contexts; equal contexts are one class with many occurrences,
and equal texts are one text with several copies. A group of more than HOT distinct contexts
is not gathered: its strings are compared by hash in an ordinary aggregation instead.

Repeats of PASSAGE_BYTES that hold at least PASSAGE_WORDS whole words are called passages; they are found in the same way, by
anchors of their own.

Defined cases: null text is empty; texts shorter than `size` lose nothing; a repeated row counts
as another copy; null doc_ids are ids like others; an empty table gives an empty result; dedup ignores other
columns, cut keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Packed, Scratch, fresh, in_bitmap, key_bitmap, maybe_among, merged_spans, text_key

GRAM = 32
#: Rows of contexts whose suffix arrays are built at a time, groups kept whole.
STEP = 4096
#: Most distinct contexts of one anchor hash that a task gathers (about 16 MB).
HOT = 20_000
#: What is called a passage: any 51 words of ordinary prose have as many bytes.
PASSAGE_BYTES, PASSAGE_WORDS = 160, 51


def _anchors(size: int, reach: int):
    """Task: texts to (fp, key, pos, lead, tail, ctx), one row for each anchor of a size-byte string, with up to reach bytes around it."""
    schema = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("tail", pa.int32()), ("ctx", pa.int64())])
    gram = min(GRAM, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.text_chunks(batch.column("text")):
                n = len(data)
                if n < size:
                    continue
                prefix, at = K.prefix_hash(data), np.arange(n - gram + 1)
                g = K.span_hash(prefix, at, at + gram)
                rows = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(offsets))
                at = K.sliding_argmin(g, size - gram + 1)[rows[: n - size + 1] == rows[size - 1 :]]
                if not len(at):
                    continue
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                row = rows[at]
                begin, end = np.maximum(offsets[row], at - (reach - gram)), np.minimum(offsets[row + 1], at + reach)
                lead, tail, pos = at - begin, end - at, (at - offsets[row]).astype(np.int32)
                ctx = K.mix64(K.span_hash(prefix, begin, end) + (lead * 65536 + tail).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(K.to_signed(g[at])), pa.array(keys[a + row]), pa.array(pos), pa.array(lead.astype(np.int32)), pa.array(tail.astype(np.int32)), pa.array(K.to_signed(ctx))], schema=schema)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts with wanted contexts to one row (fp, ctx, hot, lead, around) for each."""
    for batch in batches:
        want = batch.column("want")
        rows = np.repeat(np.arange(len(batch)), want.value_lengths().to_numpy(zero_copy_only=False))
        w = want.flatten()
        fp, ctx, hot, pos, lead, tail = (w.field(k) for k in range(6))
        texts = batch.column("text")
        texts = texts.cast(pa.binary())
        p, before, after = (x.to_numpy(zero_copy_only=False) for x in (pos, lead, tail))
        last, raw = -1, b""
        for k in range(0, len(rows), 5000):
            part, out = slice(k, k + 5000), []
            for r, q, x, y in zip(rows[part].tolist(), p[part].tolist(), before[part].tolist(), after[part].tolist(), strict=True):
                if r != last:
                    last, raw = r, texts[r].as_py()
                out.append(raw[q - x : q + y])
            yield pa.RecordBatch.from_arrays([x.slice(k, 5000) for x in (fp, ctx, hot, lead)] + [pa.array(out, pa.binary())], ["fp", "ctx", "hot", "lead", "around"])


def common_prefix_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, first, last) of each common-prefix interval of a suffix array.

    lcp[i] is the common prefix length of suffixes i and i+1.
    """
    out, stack = [], [(-1, 0)]
    for i, x in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack[-1][0] > x:
            length, first = stack.pop()
            out.append((length, first, i))
        if x > stack[-1][0]:
            stack.append((x, first))
    return out


def _matrix(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes + 1 from each start on (step 1) or backwards (step -1), padded with 0; UTF-8 never holds 255."""
    k = np.arange(width)
    inside = k < lengths[:, None]
    at = np.where(inside, starts[:, None] + step * k, 0)
    return np.where(inside, raw[at] + np.uint8(1), np.uint8(0))


def _common(m: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = m[a] != m[b]
    raw = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(raw, np.minimum(lengths[a], lengths[b]))


def covered_ranges(fp: np.ndarray, lead: np.ndarray, around: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows, and for each size (bytes before, bytes after the anchor) of all that repeats of their contexts; 0, 0 for nothing.

    Rows of one fp stand together; contexts of one fp differ from each other.
    """
    n, reach, gram = len(fp), max(sizes), min(GRAM, *sizes)
    where = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(around.buffers()[2], np.uint8)
    anchor, tail = where[:-1] + lead, np.diff(where) - lead
    right = _matrix(raw, anchor, tail, reach, 1)
    left = _matrix(raw, anchor - 1, lead, max(1, reach - gram), -1)
    group = np.cumsum(np.concatenate([[0], fp[1:] != fp[:-1]]))
    order = np.argsort(np.ascontiguousarray(right).view(f"S{reach}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]  # the suffix array of each group
    lcp = _common(right, order[:-1], order[1:], tail)
    edges = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]]))
    members = np.diff(edges)
    two = edges[:-1][members == 2]
    a, b, r = order[two], order[two + 1], lcp[two]
    l = _common(left, a, b, lead)
    found = [(np.concatenate([a, b]), np.concatenate([l, l]), np.concatenate([r, r]))]
    for e, m in zip(edges[:-1][members > 2].tolist(), members[members > 2].tolist(), strict=True):
        rows = order[e : e + m]
        by_left = np.argsort(np.ascontiguousarray(left[rows]).view(f"S{left.shape[1]}").ravel(), kind="stable")
        rank = np.empty(m, np.int64)
        rank[by_left] = np.arange(m)
        next_left = _common(left, rows[by_left[:-1]], rows[by_left[1:]], lead)
        for r, i, j in common_prefix_intervals(lcp[e : e + m - 1]):
            if r < gram:
                continue
            ranks = np.sort(rank[i : j + 1])
            shared = np.minimum.reduceat(next_left, ranks[:-1]) if ranks[-1] == m - 1 else np.minimum.reduceat(next_left, ranks)[:-1]
            longest = np.zeros(len(ranks), np.int64)
            longest[:-1] = shared
            longest[1:] = np.maximum(longest[1:], shared)
            ok = longest + r >= min(sizes)
            if ok.any():
                found.append((rows[by_left[ranks[ok]]], longest[ok], np.full(int(ok.sum()), r)))
    # all ranges of a row hold its anchor, so their union is one range
    row, before, after = (np.concatenate(x) for x in zip(*found, strict=True))
    out = []
    for size in sizes:
        ok = before + after >= size
        most_before, most_after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.maximum.at(most_before, row[ok], before[ok])
        np.maximum.at(most_after, row[ok], after[ok])
        out.append((most_before, most_after))
    row = np.flatnonzero(np.any([x[1] for x in out], axis=0))
    return row, [(x[row], y[row]) for x, y in out]


def _grouped(sizes: tuple[int, ...]):
    """Task: contexts sorted by fp to the covered ranges (fp, ctx, size, before, after)."""
    schema = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("size", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])

    def ranges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        fp, ctx = rows.column("fp").to_numpy(), rows.column("ctx").to_numpy()
        new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])])  # a repeated row brings a context twice
        if not new.all():
            rows = rows.filter(pa.array(new)).combine_chunks()
        fp, ctx, lead = (rows.column(c).to_numpy() for c in ("fp", "ctx", "lead"))
        row, found = covered_ranges(fp, lead.astype(np.int64), rows.column("around").chunk(0), sizes)
        for size, (before, after) in zip(sizes, found, strict=True):
            at = np.flatnonzero(after)
            yield pa.RecordBatch.from_arrays([pa.array(fp[row[at]]), pa.array(ctx[row[at]]), pa.array(np.full(len(at), size, np.int32)), pa.array(before[at].astype(np.int32)), pa.array(after[at].astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            fp = batch.column("fp").to_numpy()
            last = int(np.argmax(fp == fp[-1]))  # the last group may go on in the next batch
            a = 0
            if held and held[-1].column("fp")[-1].as_py() != fp[0]:
                yield from ranges(pa.Table.from_batches(held))
                held = []
            while a < last:  # whole groups, about STEP rows at a time
                b = last if a + STEP >= last else a + STEP + int(np.argmax(fp[a + STEP :] != fp[a + STEP - 1]))
                yield from ranges(pa.Table.from_batches([*held, batch.slice(a, b - a)]))
                held, a = [], b
            held.append(batch.slice(last))
        if held:
            yield from ranges(pa.Table.from_batches(held))

    return run


def _hot_strings(sizes: tuple[int, ...]):
    """Task: contexts of hot groups to the hash of each of their strings around the anchor."""
    schema = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("size", pa.int32()), ("before", pa.int32()), ("w", pa.int64())])
    gram = min(GRAM, *sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ctxs = batch.column("fp").to_numpy(), batch.column("ctx").to_numpy()
            lead = batch.column("lead").to_numpy()
            for i in range(len(batch)):
                data = np.frombuffer(batch.column("around")[i].as_py(), np.uint8)
                prefix = K.prefix_hash(data)
                for size in sizes:
                    start = np.arange(max(0, int(lead[i]) - size + gram), min(int(lead[i]), len(data) - size) + 1)
                    before = (lead[i] - start).astype(np.int32)
                    w = K.mix64(K.span_hash(prefix, start, start + size) + before.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), fps[i])), pa.array(np.full(len(w), ctxs[i])), pa.array(np.full(len(w), size, np.int32)), pa.array(before), pa.array(K.to_signed(w))], schema=schema)

    return run


def _spans(raw: bytes, copied: bool, listed: list | None, size: int, least_words: int = 0) -> list[tuple[int, int]]:
    """The repeated spans of a text, in order and apart, that hold at least `least_words` whole words."""
    spans = ([(0, len(raw))] if len(raw) >= size else []) if copied else [(x["a"], x["b"]) for x in listed or ()]
    if spans and least_words:
        starts, ends, _ = K.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        spans = [(a, b) for a, b in spans if np.searchsorted(ends, b, "right") - np.searchsorted(starts, a) >= least_words]
    return spans


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for p, q in spans:
        kept.append(raw[at:p])
        at = q
    kept.append(raw[at:])
    return b"".join(kept)


def _digest(size: int, short: int, skip: Packed | None = None):
    """Task: (doc_id, key, text[, copied, ranges, passages]) to the digest; keys in `skip` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skip:
                batch = batch.filter(pa.array(~in_bitmap(skip.value, batch.column("key").to_numpy())))
            marks = [batch.column(c) if c in batch.schema.names else None for c in ("copied", "ranges", "passages")]
            raws = batch.column("text").cast(pa.binary())
            for a in range(0, len(batch), 500):
                out = []
                for i in range(a, min(a + 500, len(batch))):
                    raw, (twice, ranges, passages) = raws[i].as_py() or b"", (x[i].as_py() if x is not None else None for x in marks)
                    spans = _spans(raw, twice, ranges, size)
                    long = _spans(raw, twice, passages, short, PASSAGE_WORDS)
                    out.append((len(raw), sum(q - p for p, q in spans), len(spans), hashlib.sha256(_without(raw, spans)).hexdigest(), len(long), sum(q - p for p, q in long)))
                names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")
                columns = {c: pa.array(x, pa.string() if c == "kept_sha256" else pa.int64()) for c, x in zip(names, zip(*out, strict=True), strict=True)}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, len(out))} | columns)

    return run


def repeats(scratch: Scratch, keyed: DataFrame, sizes: tuple[int, ...], hot: int = HOT) -> DataFrame:
    """(key, ranges, copied) of the texts keyed(key, doc_id, text) that hold a repeated string; ranges: a list of spans for each size."""
    none, short, reach = F.lit(-(2**63)), min(sizes), max(sizes)
    anchors = scratch.save(keyed.select("key", "text").mapInArrow(_anchors(short, reach), "fp long, key long, pos int, lead int, tail int, ctx long"), "anchors")
    loc = F.xxhash64("key", "pos")
    twice = scratch.save(anchors.groupBy("fp").agg(F.min(loc).alias("lo"), F.max(loc).alias("hi")).where("lo <> hi").select("fp"), "twice")
    places = scratch.save(anchors.join(twice.hint("merge"), "fp", "left_semi"), "places")
    scratch.drop("anchors", "twice")
    classes = scratch.save(places.groupBy("fp", "ctx").agg(F.min(loc).alias("lo"), F.max(loc).alias("hi"), F.min_by(F.struct("key", "pos"), loc).alias("at"), F.first("lead").alias("lead"), F.first("tail").alias("tail")), "classes")
    whole = classes.where("lo <> hi").select("fp", "ctx", F.explode(F.lit(list(sizes))).alias("size"), F.col("lead").alias("before"), F.col("tail").alias("after")).where("before + after >= size")
    several = scratch.save(classes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", (F.col("n") > hot).alias("hot")), "several")
    wanted = classes.join(several.hint("merge"), "fp").groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("fp", "ctx", "hot", F.col("at.pos").alias("pos"), "lead", "tail")).alias("want"))
    wanted = scratch.save(wanted, "wanted")
    sought = maybe_among(key_bitmap(wanted.select("key")))
    some = keyed.where(sought("key"))
    chosen = some.groupBy("key").agg(F.min(F.coalesce("doc_id", none)).alias("chosen"))
    fetch = scratch.save(wanted.join(chosen.hint("merge"), "key"), "fetch")
    texts = some.join(fetch.hint("merge"), "key").where(F.col("chosen") == F.coalesce("doc_id", none))
    around = texts.select("want", "text").mapInArrow(_contexts, "fp long, ctx long, hot boolean, lead int, around binary")
    around = scratch.save(around, "around")
    scratch.drop("wanted", "several", "fetch")
    cool = around.where("not hot").drop("hot").repartition("fp").sortWithinPartitions("fp", "ctx")
    ranges = cool.mapInArrow(_grouped(sizes), "fp long, ctx long, size int, before int, after int")
    strings = around.where("hot").drop("hot").mapInArrow(_hot_strings(sizes), "fp long, ctx long, size int, before int, w long")
    same = scratch.save(strings.groupBy("fp", "size", "w").agg(F.min("ctx").alias("x"), F.max("ctx").alias("y")).where("x <> y").select("fp", "size", "w"), "same")
    hot_ranges = strings.join(same.hint("merge"), ["fp", "size", "w"], "left_semi").select("fp", "ctx", "size", "before", (F.col("size") - F.col("before")).cast("int").alias("after"))
    ranges = whole.union(ranges).union(hot_ranges).groupBy("fp", "ctx", "size").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    ranges = scratch.save(ranges, "ranges")
    spans = places.select("fp", "ctx", "key", "pos").join(ranges.hint("merge"), ["fp", "ctx"]).select("key", "size", F.struct((F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b")).alias("span"))
    lists = [merged_spans(F.collect_set(F.when(F.col("size") == s, F.col("span")))).alias(f"ranges_{k}") for k, s in enumerate(sizes)]
    copied = keyed.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    out = scratch.save(spans.groupBy("key").agg(*lists).join(copied, "key", "full_outer"), "marks")
    scratch.drop("around", "places", "classes", "ranges", "same")
    return out


def _marks(spark: SparkSession, docs: DataFrame, sizes: tuple[int, ...], hot: int) -> DataFrame:
    """(key, copied, ranges_0, ...): for the key of each text with repeats, whether it has copies, and the spans of each size."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", text_key("text").alias("key"), "text")
    return repeats(Scratch(spark, "suffix"), keyed, sizes, hot)


def dedup(spark: SparkSession, docs: DataFrame, size: int = 400, hot: int = HOT, short: int = PASSAGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes) of docs(doc_id, text); see the module.

    The last two columns count passages, which stay: repeats of `short` bytes or more with PASSAGE_WORDS words or more.
    """
    short = min(short, size)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    long, passages = (_marks(spark, docs, (n,), hot) for n in (size, short))
    passages = passages.select("key", F.col("copied").alias("again"), F.col("ranges_0").alias("passages"))
    marks = long.join(passages, "key", "full_outer").select("key", F.coalesce("copied", "again").alias("copied"), F.col("ranges_0").alias("ranges"), "passages")
    marks = Scratch(spark, "suffix-marks").save(marks, "marks")
    bits, schema = key_bitmap(marks.select("key")), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"
    moved = docs.where(maybe_among(bits)("key")).join(marks.hint("merge"), "key", "left")
    moved = moved.select("doc_id", "key", "text", "copied", "ranges", "passages")
    # texts without repeats are not moved
    return moved.mapInArrow(_digest(size, short), schema).union(docs.mapInArrow(_digest(size, short, bits), schema))


def cut(spark: SparkSession, docs: DataFrame, size: int = PASSAGE_BYTES, words: int = PASSAGE_WORDS, hot: int = HOT) -> DataFrame:
    """docs with repeats of at least `size` bytes and `words` whole words cut out of their texts (code points cut in two go whole)."""
    marks = _marks(spark, docs, (size,), hot)
    touched = maybe_among(key_bitmap(marks.select("key")))
    key, copied, ranges = (fresh(docs, n) for n in ("text_key", "copied", "ranges"))
    marks = marks.select(F.col("key").alias(key), F.col("copied").alias(copied), F.col("ranges_0").alias(ranges))
    rows = docs.withColumn(key, text_key("text"))

    @F.arrow_udf("string")
    def rest(texts: pa.Array, twice: pa.Array, listed: pa.Array) -> pa.Array:
        out = []
        for text, again, spans in zip(texts, twice, listed, strict=True):
            text = text.as_py()
            raw = (text or "").encode() if again.as_py() or spans.is_valid else b""
            found = _spans(raw, again.as_py(), spans.as_py(), size, words) if raw else []
            out.append(_without(raw, found).decode("utf-8", "ignore") if found else text)
        return pa.array(out, pa.string())

    # texts without repeats are not moved
    moved = rows.where(touched(key)).join(marks.hint("merge"), key, "left").withColumn("text", rest("text", F.col(copied), F.col(ranges)))
    return rows.where(~touched(key)).drop(key).unionByName(moved.drop(key, copied, ranges))
