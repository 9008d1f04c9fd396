"""What a script-only page still tells: head lines, signal lines and their scores, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .text import contains_any

#: Roles, company forms, head fields and scores of signal lines.
ROLES = (
    "ceo", "chief executive", "contact", "director", "founder", "geschaftsfuhrer", "geschaftsfuhrender", "impressum", "imprint", "legal",
    "managing director", "owner", "partner", "president",
)
COMPANIES = (" inc", " llc", " ltd", " ag", " bv", " corp", " gmbh", " limited")
HEAD_FIELDS = ("author", "description", "og:title", "og:description", "twitter:title", "twitter:description")
# An address begins where a run of its characters does, or where the last match ended; so a long run without @ is read once.
ADDRESS = r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?\d[\d()./\-\s]{5,}\d)"
PERSON = r"^[A-Z][A-Za-z.-]+(?: [A-Z][A-Za-z.-]+){1,3}$"
KINDS = (("general", 0), ("person", 20), ("role", 12), ("company", 10))


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def plain(value: Column) -> Column:
    """Lower case without accents or other than ASCII characters."""
    return F.lower(F.when(F.length(_text(value)) == F.octet_length(_text(value)), _text(value)).otherwise(U.ascii_fold(_text(value))))


def looks_like_person(value: Column) -> Column:
    """Two to four capitalised words of at most 80 characters."""
    text = F.regexp_replace(_text(value), r"\s+", " ")
    return _text(value).rlike("^[A-Z]") & (F.length(text) <= 80) & text.rlike(PERSON)


def has_role(value: Column) -> Column:
    return contains_any(plain(value), ROLES)


def has_company(value: Column) -> Column:
    return contains_any(F.concat(F.lit(" "), plain(value), F.lit(" ")), COMPANIES)


def signal_score(value: Column) -> Column:
    """Points of a line that may name a contact; 0 for addresses of pages, code, and lines outside 3 to 180 characters."""
    text = _text(value)
    odd = ~F.length(text).between(3, 180) | text.rlike("^https?://") | contains_any(text, ("{", "function(", "=>"))

    def points(low: Column) -> Column:
        tests = (
            (F.contains(text, F.lit("@")) & text.rlike(ADDRESS), 90), (text.rlike(PHONE), 36), (contains_any(low, ROLES), 48), (contains_any(F.concat(F.lit(" "), low, F.lit(" ")), COMPANIES), 38),
            (looks_like_person(text), 58), (F.contains(low, F.lit("mailto:")), 12), (F.contains(text, F.lit(" ")) & text.rlike("[A-Za-z].*[A-Za-z]"), 4),
        )
        return sum((F.when(test, n).otherwise(0) for test, n in tests), F.lit(0))

    return F.when(odd, 0).otherwise(U.bind(plain(text), points))


def buckets(value: Column, score: Column | None = None) -> Column:
    """Array of (kind, score) of all kinds of line that a line is; its signal score may be given."""
    score = signal_score(value) if score is None else score
    tests = {"general": F.lit(True), "person": looks_like_person(value), "role": has_role(value), "company": has_company(value)}
    return F.filter(F.array(*[F.when(tests[k], F.struct(F.lit(k).alias("kind"), (score + n).alias("score"))) for k, n in KINDS]), lambda x: x.isNotNull())


def asset_key(url: Column) -> Column:
    """Host and path of a script's address."""
    return F.concat(F.lower(U.netloc(url)), U.path(url))


def head_lines(page: Column) -> Column:
    """Title and the telling meta fields, blanks squeezed, each once whatever its case."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    page = F.coalesce(page, F.lit(""))
    title = F.array(squeeze(F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    metas = F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    key = lambda m: F.lower(F.trim(F.when(attribute(m, "property") != "", attribute(m, "property")).otherwise(attribute(m, "name"))))
    lines = F.concat(title, F.transform(F.filter(metas, lambda m: key(m).isin(*HEAD_FIELDS)), lambda m: squeeze(attribute(m, "content"))))
    return U.bind(F.filter(lines, lambda x: x != ""), lambda kept: F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1))
