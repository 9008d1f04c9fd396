"""The Merkle manifest against lists of hashes, one level at a time."""

import hashlib
import zlib

from pyspark.sql import functions as F

from sitegrain.llm import manifest

from .conftest import LOW

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def walk(levels, at, start, fanout):
    """Siblings from a node up, and what `start` in its place leads to."""
    proof = []
    for level in levels[:-1]:
        low = at // fanout * fanout
        run = level[low : low + fanout]
        proof += [d for i, d in enumerate(run) if low + i != at]
        start, at = H(*[start if low + i == at else d for i, d in enumerate(run)]), at // fanout
    return proof, start


def plain(rows, fanout=16):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = climb([leaf_of(*r) for r in sources[s]], fanout)
    top = climb([trees[s][-1][0] for s in names], fanout)
    out = []
    for at, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            start = own = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                start = leaf_of(r[0], r[1].translate(LOW), *r[2:])
            low, folded = walk(trees[s], i, start, fanout)
            high, folded = walk(top, at, folded, fanout)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, `g` string"


def run(spark, rows, fanout=16):
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA).repartition(3)
    got = manifest.verified_table(spark, docs, fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def rows_of(n, sources):
    return [(i * 3 % n, f"Text {i} É" if i % 11 else None, "de" if i % 3 else None, sources[i % len(sources)], i if i % 7 else None) for i in range(n)]


def test_manifest_is_the_plain_tree(spark):
    hot = [(10_000 + i, f"Hot {i}", "en", "hot", i) for i in range(300)]
    odd = [(None, "No Id", "en", None, 1), (None, "No Id", "en", None, 1), (5, "A", None, "É", 1), (5, "A", None, "É", 1), (5, "B", None, "É", 1), (1, "Lone", "x", "lone", 1), (2, "", "x", "", 0)]
    rows = rows_of(60, ["s1", "s2", "Z", None, "hot"]) + hot + odd + [(7, "same", "en", "copies", 4)] * 40
    got = run(spark, rows)
    assert got == plain(rows) and 0 < sum(not r[-1] for r in got) < len(got)


def test_small_fanout_and_lone_roots(spark):
    rows = rows_of(9, ["a", "b", "c"])
    assert run(spark, rows, 2) == plain(rows, 2)
    for rows in ([(1, "Only", None, None, None)], [(5, "A", None, "s", 1), (6, "b", None, "s", 1)], rows_of(17, ["one"])):
        assert run(spark, rows) == plain(rows)
    assert run(spark, [(1, "Only", None, None, None)])[0][4] == H("")


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_changed_row_is_found(spark):
    """The general interface: paths of one table hold for its own rows only."""
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows_of(40, ["a", "b"])], SCHEMA)
    paths = manifest.build(spark, docs, 4, text_now=F.when(F.col("doc_id") == 3, "changed").otherwise(F.col("text")), lang_now=F.col("lang"), chars_now=F.col("n_chars"))
    now = manifest.leaf(text=F.col("text_now"), lang=F.col("lang_now"), n_chars=F.col("chars_now"))
    bad = paths.where(manifest.fold(now, F.col("path")) != F.col("root"))
    assert [r["doc_id"] for r in bad.collect()] == [3]
