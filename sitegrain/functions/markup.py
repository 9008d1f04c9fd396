"""Tags of HTML pages as Column expressions: attributes, script sources, the children of the body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bind, one_of

#: The rest of a tag, with quoted signs in it.
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
HIDDEN = r"(?is)<!--.*?-->|<(script|style|template|textarea|title|noscript)\b[^>]*>.*?</\1\s*>"
#: Elements that have no content, and those that end an open paragraph.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, trimmed; null if it has none."""
    value = lambda quoted: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*{quoted}""", 1)
    double, single, bare = value('"([^"]*)"'), value("'([^']*)'"), value("""([^\\s"'>]+)""")
    return F.when(tag.rlike(rf"(?is)\s{name}\s*="), F.trim(F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")), bare)))


def tags(page: Column, name: str) -> Column:
    """All start tags of a name."""
    return F.regexp_extract_all(page, F.lit(rf"(?is)<{name}(?=[\s/>]){REST}>"), F.lit(0))


def script_sources(page: Column) -> Column:
    """The sources of all scripts that name one, in order; empty ones too."""
    return F.filter(F.transform(tags(page, "script"), lambda t: attribute(t, "src")), lambda s: s.isNotNull())


def body(page: Column) -> Column:
    """What follows the body tag, else the head, else all but the elements of a head; without scripts, styles and comments."""
    shown = F.regexp_replace(page, HIDDEN, "")

    def part(x: Column) -> Column:
        after = lambda pattern: F.regexp_replace(x, rf"(?is)\A.*?{pattern}", "")
        start, head = rf"<body(?=[\s/>]){REST}>", r"</head\s*>"
        bare = F.regexp_replace(x, rf"(?is)<(?:!doctype|/?html|/?head|meta|link|base)\b{REST}>", "")
        return F.when(x.rlike(f"(?is){start}"), after(start)).when(x.rlike(f"(?is){head}"), after(head)).otherwise(bare)

    return bind(shown, part)


def has_child(page: Column, ids) -> Column:
    """Whether a direct child of the body has one of the ids.

    A fold over the tags keeps the names of the open elements: an end tag closes down to its own start or is ignored, a block
    ends an open paragraph.
    """
    found = F.regexp_extract_all(body(page), F.lit(rf"(?is)<(/?[a-z][a-z0-9]*(?=[\s/>]){REST})>"), F.lit(1))
    name = lambda t: F.lower(F.regexp_extract(t, "^/?([A-Za-z0-9]+)", 1))
    items = F.transform(found, lambda t: F.struct(
        name(t).alias("name"), F.startswith(t, F.lit("/")).alias("end"), (one_of(name(t), VOID) | F.endswith(t, F.lit("/"))).alias("empty"), one_of(name(t), BLOCKS).alias("block"),
        F.coalesce(one_of(F.lower(attribute(t, "id")), ids), F.lit(False)).alias("named"),
    ))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(False).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = F.size(acc["open"]) - F.array_position(F.reverse(acc["open"]), x["name"]).cast("int")
        closed = F.when(F.array_contains(acc["open"], x["name"]), F.slice(acc["open"], F.lit(1), at)).otherwise(acc["open"])
        last = F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), F.lit(""))
        inside = F.when(x["block"] & (last == "p"), F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)).otherwise(acc["open"])
        opened = bind(inside, lambda i: F.struct(
            F.when(x["empty"], i).otherwise(F.concat(i, F.array(x["name"]))).alias("open"), (acc["found"] | (x["named"] & (F.size(i) == 0))).alias("found")))
        return F.when(acc["found"], acc).when(x["end"], F.struct(closed.alias("open"), acc["found"].alias("found"))).otherwise(opened)

    named = "|".join(ids)
    return F.when(page.rlike(rf"""(?i)\sid\s*=\s*["']?\s*(?:{named})\b"""), F.aggregate(items, start, step, lambda acc: acc["found"])).otherwise(False)


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text
