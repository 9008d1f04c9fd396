"""Company-name rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# Names and beginnings that are no company, beginnings that are cut, and phrases that are no name.
INVALID_NAMES = ("account suspended", "local index")
INVALID_STARTS = ("access denied", "hold tight", "index of ", "just a moment")
CUT_STARTS = ("welcome to ", "about ")
GENERIC = ("company leadership", "contact us", "privacy policy", "terms and conditions", "cookie policy")
REGISTRATION = r"(?i)\b((?:limited|ltd|llp|plc|inc|corp|corporation|company|group|kg|gmbh))\b[\s,.:;-]*\d{6,}$"
EDGE = r"^[ ,.\-]+|[ ,.\-]+$"


def _invalid(value: Column) -> Column:
    low, out = F.lower(value), F.lower(value).isin(*INVALID_NAMES)
    for s in INVALID_STARTS:
        out = out | F.startswith(low, F.lit(s))
    return out


def clean(value: Column) -> Column:
    """A decoded candidate without tags, trading names and registration numbers."""

    def trading(v: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(v, r"(?i)\(\s*trading as\s+(.+?)\s*\)$", 1), EDGE, "")
        after = F.regexp_replace(F.regexp_extract(v, r"(?is)^.*?\btrading as\b(.*)$", 1), EDGE, "")
        return F.when(v.rlike(r"(?i)\(\s*trading as\s+(.+?)\s*\)$"), inner).when(after != "", after).otherwise(v)

    def checked(v: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(v, REGISTRATION, "$1"), EDGE, "")
        return U.bind(cut, lambda c: F.when(_invalid(v) | _invalid(c), "").otherwise(c))

    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(value, "<[^>]+>", " ")), r"\s+", " "))
    return U.bind(U.bind(plain, trading), checked)


def normalized(cleaned: Column) -> Column:
    """A clean() name without greetings and slogans; '' for generic phrases."""

    def greeting(start: str):
        return lambda v: F.when(F.startswith(F.lower(v), F.lit(start)), F.regexp_replace(F.substring(v, len(start) + 1, 1_000_000), r"^[ :\-|]+|[ :\-|]+$", "")).otherwise(v)

    def first_part(v: Column) -> Column:
        part = F.filter(F.transform(F.split(v, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
        return F.when(F.contains(v, F.lit(" | ")), F.coalesce(F.get(part, F.lit(0)), v)).otherwise(v)

    def head(v: Column) -> Column:
        h = F.trim(F.split_part(v, F.lit(" - "), F.lit(1)))
        return F.when(F.contains(v, F.lit(" - ")) & h.rlike(r"\S\s+\S"), h).otherwise(v)

    v = cleaned
    for step in (*[greeting(s) for s in CUT_STARTS], first_part, head):
        v = U.bind(v, step)
    return U.bind(v, lambda x: F.when(F.lower(x).isin(*GENERIC), "").otherwise(x))


def site_token(website: Column) -> Column:
    return F.regexp_replace(F.split_part(U.registrable_domain(website), F.lit("."), F.lit(1)), "[^a-z0-9]+", "")


def page_weight(url: Column) -> Column:
    low = F.lower(U.text(url))
    return F.when(low.rlike("imprint|impressum|privacy|about|contact"), 4).otherwise(0) + F.when(F.endswith(low, F.lit("/")) | U.path(low).isin("", "/"), 2).otherwise(0)


def score(name: Column, token: Column, base: Column) -> Column:
    """Score of a normalized() candidate."""
    squashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return F.when(name == "", -100).otherwise(
        base + F.when((token != "") & F.contains(squashed, token), 20).otherwise(0) - F.when(~F.trim(name).rlike(r"\S\s+\S") & (token == ""), 8).otherwise(0))
