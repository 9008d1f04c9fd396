"""What a page's text gives a reader with little room: noise lines dropped, windows around telling lines, pages fitted to a budget.

Texts are arrays of lines inside one row; all rules are array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import contains_any
from .urls import bind

#: Words of lines that may name a representative.
HINTS = (
    "about", "accountant", "bio", "board", "chief", "co-founder", "contact", "director", "executive", "founder", "general partner", "impressum", "imprint",
    "leadership", "management", "officer", "our story", "owner", "partner", "people", "president", "principal", "profile", "referral", "solicitor",
    "team", "vice-chancellor", "who we are",
)
#: Phrases of lines that are dropped.
NOISE = (
    "analytics purposes", "accept all cookies", "already working at", "candidate connect login", "career site by teamtailor", "cookie policy",
    "cookie preferences", "decline all non-necessary cookies", "employee login", "log in as employee", "log in to connect", "manage cookies",
    "select which cookies you accept", "strictly necessary", "this website uses cookies", "withdraw and manage your consent",
)
#: Section marks.
TELLING, BEGINNING, WHOLE, ENDING, BREAK = "--- 重点片段 ---", "--- 页面开头 ---", "--- 完整正文 ---", "--- 末尾上下文 ---", "---"
HEAD, TAIL, WINDOWS, BUDGET = 24, 16, 8, 180_000
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _strip(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def lines(content: Column) -> Column:
    """Stripped lines that are neither empty nor noise; null is empty."""
    found = F.transform(F.split(F.coalesce(content, F.lit("")), LINE_END), _strip)
    return F.filter(found, lambda x: (x != "") & ~contains_any(F.lower(x), NOISE))


def windows(found: Column) -> Column:
    """The first WINDOWS ranges (lo, hi) of lines from 2 before to 7 after a telling line, joined where at most 2 apart."""
    n = F.size(found)
    hits = F.filter(F.transform(found, lambda x, i: F.when(contains_any(F.lower(x), HINTS), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc: Column, i: Column) -> Column:
        lo, hi, last = F.greatest(F.lit(0), i - 2), F.least(n, i + 8), F.try_element_at(acc, F.lit(-1))
        new = F.concat(acc, F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], hi).alias("hi"))))
        full = F.size(acc) > WINDOWS  # what follows is not kept
        return F.when(full, acc).when((F.size(acc) > 0) & (lo <= last["hi"] + 2), joined).otherwise(new)

    return F.slice(F.aggregate(hits, none, step), 1, WINDOWS)


def _sections(found: Column, at: Column) -> tuple[Column, Column]:
    """The lines of the windows, each once, with breaks between the windows; and all lines of the windows."""
    parts = F.transform(at, lambda w: F.slice(found, w["lo"] + 1, w["hi"] - w["lo"]))
    fresh = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(BREAK))).otherwise(F.array().cast("array<string>")), F.array_except(p, F.flatten(F.slice(parts, 1, i)))))
    return F.flatten(fresh), F.flatten(parts)


def _mark(name: str) -> Column:
    return F.array(F.lit(name))


def prioritized(content: Column) -> Column:
    """The text with telling lines first, then the head, then what else there is; as it is if there is nothing telling."""
    text = _strip(F.coalesce(content, F.lit("")))

    def arranged(found: Column) -> Column:
        def with_windows(at: Column) -> Column:
            telling, seen = _sections(found, at)
            head = F.slice(found, 1, HEAD)
            whole = F.concat(_mark(TELLING), telling, _mark(BEGINNING), F.array_except(head, seen), _mark(WHOLE), F.array_except(found, F.concat(seen, head)))
            return F.when(F.size(at) == 0, F.array_join(found, "\n")).otherwise(F.array_join(whole, "\n"))

        return F.when(F.size(found) == 0, text).otherwise(bind(windows(found), with_windows))

    return F.when(text == "", "").otherwise(bind(lines(content), arranged))


def abbreviated(content: Column) -> Column:
    """Telling lines, head and tail alone."""

    def arranged(found: Column) -> Column:
        def with_windows(at: Column) -> Column:
            telling, seen = _sections(found, at)
            head = F.slice(found, 1, HEAD)
            tail = F.slice(found, F.greatest(F.size(found) - TAIL, F.lit(0)) + 1, TAIL)
            none = F.array().cast("array<string>")
            return F.array_join(F.concat(
                F.when(F.size(at) > 0, F.concat(_mark(TELLING), telling)).otherwise(none), _mark(BEGINNING), F.array_except(head, seen),
                F.when(F.size(found) > TAIL, F.concat(_mark(ENDING), F.array_except(tail, F.concat(seen, head)))).otherwise(none),
            ), "\n")

        return F.when(F.size(found) == 0, _strip(F.coalesce(content, F.lit("")))).otherwise(bind(windows(found), with_windows))

    return bind(lines(content), arranged)


def page_priority(url: Column, content: Column) -> Column:
    """6 for each telling word in the address, 2 for each in the text, less 4 for each noise phrase in the address."""
    u, c = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    count = lambda value, parts, weight: sum((F.when(F.contains(value, F.lit(p)), weight).otherwise(0) for p in parts), F.lit(0))
    return count(u, HINTS, 6) + count(c, HINTS, 2) - count(u, NOISE, 4)


def fit_budget(pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """pages(site, pos, url, content), from the last one on abbreviated until a site's texts have at most `budget` characters.

    A page is abbreviated if the savings of those before it don't suffice, so one window
    over the site's pages decides.
    """
    site = Window.partitionBy("site")
    rows = pages.withColumn("short", abbreviated(F.col("content"))).withColumn("total", F.sum(F.length("content")).over(site)).withColumn("n", F.count("*").over(site))
    rows = rows.withColumn("rank", F.row_number().over(site.orderBy("pos")) - 1)
    # the last page is the first to go
    rows = rows.withColumn("turn", F.col("n") - F.col("rank")).withColumn("saved", F.greatest(F.length("content") - F.length("short"), F.lit(0)))
    before = F.coalesce(F.sum("saved").over(site.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (F.col("total") - before > budget) & (F.col("saved") > 0)
    return rows.withColumn("before", before).withColumn("content", F.when(cut, F.col("short")).otherwise(F.col("content"))).select("site", "pos", "url", "content")


def prepared(pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(site, pos, url, content): pages(site, pos, url, content) by falling priority, rewritten and fitted to the budget."""
    order = Window.partitionBy("site").orderBy(F.desc("priority"), "pos")
    rows = pages.withColumn("priority", page_priority(F.col("url"), F.col("content"))).withColumn("pos", F.row_number().over(order) - 1)
    return fit_budget(rows.select("site", "pos", "url", prioritized(F.col("content")).alias("content")), budget)
