"""Long pages cut to a size: what tells most first, then the beginning and the end."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markup as M
from . import spans as S
from . import urls as U
from .shell import ADDRESS
from .text import contains_any

#: What tells of people, and the marks and bounds of a cut page.
PEOPLE = (
    "founder", "co-founder", "owner", "chairman", "chief executive", "managing director", "group chief executive", "president", "principal solicitor", "director", "lead guide",
    "leadership", "executive team",
)
SIGNALS = (r"(?is)<h[1-4][^>]*>.*?</h[1-4]>", "(?i)(?:" + "|".join(PEOPLE) + ")", ADDRESS)
BEFORE, AFTER, FOUND, GAP, STRETCHES = 900, 1600, 24, 256, 8
LINES, FIRST_LINES, MARKS = 24, 12, 96
OPENING, CLOSING = "<section data-signal='1'><h2>重点正文片段</h2>", "</section>"
KEPT_MIDDLE, CUT = "\n<!-- 页面内容过长已截断，已保留中部重点片段 -->\n", "\n<!-- 页面内容过长已截断 -->\n"


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _plain_lines(values: pd.Series) -> pd.Series:
    """Lines of each of a page's stretches, whose tags are line ends by now: entities read, blanks squeezed, of two characters or more."""

    def lines(text: str) -> list[str]:
        squeezed = (" ".join(line.split()) for line in html.unescape(text).splitlines())
        return [line for line in squeezed if len(line) > 1]

    return values.map(lambda some: [lines(x) for x in some] if some is not None else [])


plain_lines = _plain_lines.asNondeterministic()


def stretches(page: Column) -> Column:
    """Texts around the first headings, people's titles and addresses, 24 in all, joined where they are near; the first 8."""

    def pick(x: Column) -> Column:
        found = F.slice(F.concat(*[F.slice(S.places(x, p), 1, FOUND) for p in SIGNALS]), 1, FOUND)
        return S.cut(x, S.joined(S.around(found, BEFORE, AFTER, F.length(x)), GAP, STRETCHES))

    return U.bind(page, pick)


def signal_lines(lines: Column) -> Column:
    """Lines that name people or addresses with one line before and two after, in order and once, 24 at most; else the first 12."""
    told = F.transform(lines, lambda x: x.rlike(ADDRESS) | contains_any(F.lower(x), PEOPLE))

    def near(hits: Column) -> Column:
        hit = lambda i: F.coalesce(F.get(hits, i), F.lit(False))
        return F.filter(lines, lambda _, i: hit(i + 1) | hit(i) | F.when(i > 0, hit(i - 1)).otherwise(False) | F.when(i > 1, hit(i - 2)).otherwise(False))

    return U.bind(U.bind(told, near), lambda x: F.when(F.size(x) > 0, F.slice(F.array_distinct(x), 1, LINES)).otherwise(F.slice(F.array_distinct(lines), 1, FIRST_LINES)))


def _summary(lines: Column) -> Column:
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), M.escaped(x), F.lit("</p>"))), "")
    return F.when(F.size(lines) > 0, F.concat(F.lit(OPENING), body, F.lit(CLOSING))).otherwise("")


def middle(lines: Column, budget: int) -> Column:
    """The summary of the stretches' lines, as many stretches as it takes to fill the budget."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("text"))

    def step(acc: Column, some: Column) -> Column:
        more = F.array_union(acc["lines"], signal_lines(some))
        return F.when(F.length(acc["text"]) >= budget, acc).otherwise(U.bind(more, lambda x: F.struct(x.alias("lines"), _summary(x).alias("text"))))

    return F.substring(F.aggregate(lines, start, step, lambda acc: acc["text"]), 1, max(budget, 0))


def truncated(pages: DataFrame, most: int = 250_000) -> DataFrame:
    """pages(html) with html of at most `most` characters; shorter pages stay as they are, null too.

    A longer one begins with what its stretches tell of people and addresses, then come a third of `most` from its beginning and
    one from its end.
    """
    third = max(most // 3, 1)
    pieces = F.transform(stretches(F.col("html")), lambda x: F.regexp_replace(x, "<[^>]+>", "\n"))
    rows = pages.withColumn("__pieces", F.when(F.length("html") > most, pieces)).withColumn("__lines", plain_lines("__pieces"))
    told = middle(F.col("__lines"), max(most - 2 * third - MARKS, 0))
    head, tail = F.substring("html", 1, third), F.right("html", F.lit(third))
    whole = U.bind(told, lambda x: F.concat(F.when(x != "", F.concat(x, F.lit(KEPT_MIDDLE))).otherwise(""), head, F.lit(CUT), tail))
    # the pieces are named twice, so that Spark does not move them into the function's argument, where it cannot evaluate them
    return rows.withColumn("html", F.when(F.col("__pieces").isNotNull(), F.substring(whole, 1, most)).otherwise(F.col("html"))).drop("__pieces", "__lines")
