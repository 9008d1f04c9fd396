"""Evidence in the scripts of script-only pages: windows, fragments, mailboxes and the lines worth showing, all in the row of a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import emails as E
from . import shell as SH
from . import spans as S
from . import urls as U
from .text import contains_any

#: Words that lead to a contact, and those that speak for or against showing a mailbox of another host.
ANCHORS = "(?iu)" + U.anywhere((
    "mailto:", "tel:", "impressum", "imprint", "contact", "gmbh", "geschäft", "director", "founder", "ceo", "leadership", "management", "partner", "owner", "phone", "president", "telefon", "telephone",
))
KEEP = (
    "contact", "director", "email", "founder", "geschaftsfuhrer", "geschaftsfuhrender", "impressum", "kontakt", "legal", "mail", "mailto", "managing director",
    "owner", "partner", "phone", "president", "representative", "telefon",
)
DROP = ("aufsicht", "authority", "beispiel", "compliance", "datenschutz", "example", "placeholder", "privacy", "regulator", "regierung", "terms")
#: Strings in scripts, as they are told apart there.
DOUBLE_QUOTED = r'"((?:\\.|[^"\\]){3,180})"'
SINGLE_QUOTED = r"'((?:\\\\.|[^'\\\\]){3,180})'"
QUOTES = r"""'"\n"""
NAMES = r"[A-Z][A-Za-z.-]+(?: [A-Z][A-Za-z.-]+){1,3}"
#: Bounds of windows, fragments and lines.
AROUND, GAP = 600, 200
BEFORE, AFTER, SHORTEST, LONGEST = 120, 160, 12, 180
#: How much of a script goes into a recovered page. What is told of scripts by themselves is whole.
ANCHORED, WINDOWS, PLAIN, FRAGMENTS = 80, 24, 200_000, 40
CAPS = (("email", 20), ("person", 20), ("role", 24), ("company", 20), ("general", 120))
LINES = 120

squeezed = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
stripped = lambda x: F.regexp_replace(squeezed(x), r"\A[.,;]+|[.,;]+\z", "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unquoted(values: pd.Series) -> pd.Series:
    """The escapes of script strings read, blanks squeezed: each byte that is no escape stands for itself, as Latin-1."""

    def read(x: str) -> str:
        plain = x.strip().replace("\\/", "/").encode("utf-8", "ignore").decode("unicode_escape", "ignore")
        return " ".join(plain.split()).strip(".,;")

    return values.map(lambda some: [read(x) for x in some] if some is not None else [])


#: Not deterministic by name alone: so no filter on what is made of it is evaluated before it.
unquoted = _unquoted.asNondeterministic()


def windows(text: Column, brief: bool = False) -> Column:
    """The stretches of a script around its addresses and telling words, one below the other; without any, all of it. Brief: the first of them, or its beginning."""

    def pick(x: Column) -> Column:
        addresses, anchors = F.when(F.contains(x, F.lit("@")), S.places(x, SH.ADDRESS)).otherwise(S.none()), S.places(x, ANCHORS)
        first = lambda a: F.slice(anchors, F.lit(1), F.greatest(F.lit(ANCHORED) - F.size(a), F.lit(1))) if brief else anchors
        some = U.bind(addresses, lambda a: F.concat(a, first(a)))
        kept = S.joined(S.around(some, AROUND, AROUND, F.length(x)), GAP, WINDOWS if brief else None)
        return U.bind(kept, lambda k: F.when(F.size(k) == 0, F.substring(x, 1, PLAIN) if brief else x).otherwise(F.array_join(S.cut(x, k), "\n")))

    return U.bind(F.coalesce(text, F.lit("")), pick)


def fragments(text: Column, brief: bool = False) -> Column:
    """Pieces of 12 to 180 characters around telling words, signs blanked; the first 40 where brief."""
    around = S.around(S.places(text, ANCHORS), BEFORE, AFTER, F.length(text))
    clean = F.transform(S.cut(text, around), lambda x: stripped(F.regexp_replace(x, r"[{}\[\](),:+*/]", " ")))
    pieces = F.filter(clean, lambda x: F.length(x).between(SHORTEST, LONGEST))
    return F.slice(pieces, 1, FRAGMENTS) if brief else pieces


def quoted_around(blocks: Column, firsts: Column, length: Column, span: Column) -> Column:
    """What stands with a span between the nearest quotes or line ends: at most 120 characters before, and after where there is no sign more."""
    left = U.bind(S.part(blocks, F.greatest(span["a"] - BEFORE, F.lit(0)), span["a"]), lambda x: F.when(x.rlike("""["'\\n]"""), F.regexp_extract(x, """(?s)["'\\n][^"'\\n]*\\z""", 0)).otherwise(x))
    right = F.coalesce(S.next_place(blocks, firsts, QUOTES, span["b"]), F.least(span["b"] + BEFORE, length))
    return F.concat(left, U.bind(right, lambda b: S.part(blocks, span["a"], b)))


def mailbox(value: Column) -> Column:
    """The address that a match stands for, '' if it is no mailbox."""
    return U.bind(E.normalized(value), lambda x: F.when(E.valid(x), x["email"]).otherwise(""))


def keeps(site_domain: Column, email: Column, context: Column) -> Column:
    """Whether a mailbox is shown: one of the site always, others where their context speaks for a contact."""

    def other(x: Column) -> Column:
        domain, low = x["domain"], x["low"]
        told = F.contains(low, F.lit("mailto")) | SH.looks_like_person(context) | SH.has_role(context) | SH.has_company(context)
        return (domain != "") & ~contains_any(domain, DROP) & ~contains_any(low, DROP) & contains_any(low, KEEP) & told

    about = F.struct(U.registrable_domain(E.domain(email)).alias("domain"), SH.plain(squeezed(context)).alias("low"))
    return E.matches_site(site_domain, email) | U.bind(about, other)


def cleared(site_domain: Column, line: Column) -> Column:
    """A line without the mailboxes that are not shown."""

    def take_out(acc: Column, match: Column) -> Column:
        unwanted = U.bind(mailbox(match), lambda e: (e != "") & ~keeps(site_domain, e, acc))
        return F.when(unwanted, F.replace(acc, match, F.lit(" "))).otherwise(acc)

    without = F.when(F.contains(line, F.lit("@")), F.aggregate(F.regexp_extract_all(line, F.lit(SH.ADDRESS), F.lit(0)), line, take_out)).otherwise(line)
    return F.regexp_replace(squeezed(without), r"\A[ ,;]+|[ ,;]+\z", "")


def scored_emails(site_domain: Column, text: Column) -> Column:
    """Array of (score, line) of the mailboxes in a text that are shown."""

    def shown(x: Column) -> Column:
        found = F.transform(S.places(text, SH.ADDRESS), lambda s: F.struct(mailbox(S.part(x["blocks"], s["a"], s["b"])).alias("email"), s["a"].alias("a"), s["b"].alias("b")))
        context = lambda s: quoted_around(x["blocks"], x["firsts"], x["length"], s)
        kept = F.filter(found, lambda s: (s["email"] != "") & U.bind(context(s), lambda c: keeps(site_domain, s["email"], c)))
        return F.transform(kept, lambda s: F.struct(F.when(E.matches_site(site_domain, s["email"]), 90).otherwise(48).alias("score"), F.lower(s["email"]).alias("line")))

    return U.bind(U.bind(S.blocks(text), lambda b: F.struct(b.alias("blocks"), S.firsts(b, QUOTES).alias("firsts"), F.length(text).alias("length"))), shown)


def scored_names(text: Column) -> Column:
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(NAMES), F.lit(0)), SH.looks_like_person), lambda x: F.struct(F.lit(78).alias("score"), x.alias("line")))


def routed(lines: Column) -> Column:
    """Array of (kind, score, line) of all kinds that each of the lines is; lines without points are none."""
    scores = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), SH.signal_score(x).alias("score"))), lambda r: r["score"] > 0)
    rows = F.transform(scores, lambda r: F.struct(r["line"].alias("line"), SH.buckets(r["line"], r["score"]).alias("kinds")))
    return F.flatten(F.transform(rows, lambda r: F.transform(r["kinds"], lambda k: F.struct(k["kind"].alias("kind"), k["score"].alias("score"), r["line"].alias("line")))))


def best(kinds: dict[str, Column], brief: bool = False) -> Column:
    """The lines of each kind's array of (score, line) by score, then shortness, then text, all in one list without repeats. Brief: so many of each kind and in all."""

    def top(rows: Column, most: int) -> Column:
        keyed = F.transform(rows, lambda r: F.struct((-r["score"]).alias("s"), F.length(r["line"]).alias("n"), r["line"].alias("line")))
        return F.transform(F.slice(F.sort_array(keyed), 1, most) if brief else F.sort_array(keyed), lambda r: r["line"])

    lines = S.distinct(F.concat(*[top(kinds[kind], most) for kind, most in CAPS]))
    return F.slice(lines, 1, LINES) if brief else lines
