"""Places in long texts as arrays of (a, b) spans, from 0, end exclusive; all as Column expressions.

Places are sums of the lengths of the pieces between matches, so that no Python is needed to find them. Sums are taken
GROUP pieces at a time, as an array that grows by one element is copied each time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bind

SPANS = "array<struct<a:int,b:int>>"
GROUP = 256
#: Fixed value: a block of a text has 4096 characters, given as a power of two.
BLOCK = 12


def none() -> Column:
    return F.array().cast(SPANS)


def _running(values: Column, length) -> Column:
    """Array of the sum of `length` before each of the values, and of them all."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + length(x))))


def places(text: Column, pattern: str) -> Column:
    """The spans of all matches of the pattern, in order."""

    def find(x: Column) -> Column:
        return F.arrays_zip(F.split(x, pattern, -1).alias("p"), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("m"))

    size = lambda z: F.length(z["p"]) + F.coalesce(F.length(z["m"]), F.lit(0))

    def groups(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / GROUP).cast("int")), lambda g: F.slice(z, g * GROUP + 1, F.lit(GROUP)))

    def spans(parts: Column) -> Column:
        ends = F.transform(parts, lambda g: _running(g, size))
        return bind(ends, lambda e: bind(_running(e, lambda x: F.element_at(x, -1)), lambda before: F.flatten(F.transform(
            F.arrays_zip(parts.alias("g"), e.alias("e"), F.slice(before, F.lit(1), F.size(e)).alias("s")),
            lambda x: F.transform(F.filter(x["g"], lambda z: z["m"].isNotNull()), lambda z, i: F.struct(
                (x["s"] + F.get(x["e"], i) + F.length(z["p"])).cast("int").alias("a"), (x["s"] + F.get(x["e"], i + 1)).cast("int").alias("b"))),
        ))))

    return F.when(text.rlike(pattern), bind(bind(find(text), groups), spans)).otherwise(none())


def around(spans: Column, before: int, after: int, length: Column) -> Column:
    """Each span with so many characters before and after, inside the text."""
    return bind(length, lambda n: F.transform(spans, lambda s: F.struct(F.greatest(s["a"] - before, F.lit(0)).alias("a"), F.least(s["b"] + after, n).alias("b"))))


def joined(spans: Column, gap: int, most: int | None = None) -> Column:
    """The stretches that the spans make where they are at most `gap` apart; the first `most`, if it is given."""
    open_ = F.struct(none().alias("out"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    full = lambda acc: F.lit(False) if most is None else F.size(acc["out"]) >= most
    close = lambda acc: F.when(acc["a"].isNull() | full(acc), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))

    def step(acc: Column, s: Column) -> Column:
        near = s["a"] <= acc["b"] + gap
        return F.when(F.coalesce(near, F.lit(False)), F.struct(acc["out"].alias("out"), acc["a"].alias("a"), F.greatest(acc["b"], s["b"]).alias("b"))).otherwise(
            F.struct(close(acc).alias("out"), s["a"].alias("a"), s["b"].alias("b")))

    return F.aggregate(F.array_sort(spans), open_, step, close)


def blocks(text: Column) -> Column:
    """A text in blocks of 4096 characters: a place in the text itself would be sought from its beginning each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK}}}"), F.lit(0))


def part(blocks: Column, a: Column, b: Column) -> Column:
    """What stands from a to b in a text that is given in blocks."""
    first = F.shiftright(a, BLOCK)
    return F.substring(F.array_join(F.slice(blocks, first + 1, F.shiftright(b, BLOCK) - first + 1), ""), a.bitwiseAND((1 << BLOCK) - 1) + 1, b - a)


def cut(text: Column, spans: Column) -> Column:
    """The texts of the spans."""
    return bind(blocks(text), lambda x: F.transform(spans, lambda s: part(x, s["a"], s["b"])))


def firsts(blocks: Column, signs: str) -> Column:
    """The place in the text of each block's first sign, null where a block has none."""
    return bind(F.transform(blocks, lambda x: F.length(F.regexp_extract(x, rf"\A[^{signs}]*+", 0))), lambda n: F.transform(
        F.arrays_zip(blocks.alias("x"), n.alias("n")), lambda z, k: F.when(z["n"] < F.length(z["x"]), F.shiftleft(k, BLOCK) + z["n"])))


def next_place(blocks: Column, firsts: Column, signs: str, at: Column) -> Column:
    """The place of the next of the signs from a place on, null without one."""
    k = F.shiftright(at, BLOCK)
    near = bind(F.substring(F.coalesce(F.get(blocks, k), F.lit("")), at.bitwiseAND((1 << BLOCK) - 1) + 1, 1 << BLOCK), lambda x: bind(
        F.length(F.regexp_extract(x, rf"\A[^{signs}]*+", 0)), lambda n: F.when(n < F.length(x), at + n)))
    return F.coalesce(near, F.array_min(F.slice(firsts, k + 2, F.size(firsts))))


def distinct(lines: Column) -> Column:
    """Lines in order, each once whatever its case."""
    same = F.sort_array(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("line"))))
    first = bind(same, lambda x: F.filter(x, lambda r, j: ~r["low"].eqNullSafe(F.get(x, j - 1)["low"])))
    return F.transform(F.sort_array(F.transform(first, lambda r: F.struct(r["i"].alias("i"), r["line"].alias("line")))), lambda r: r["line"])
