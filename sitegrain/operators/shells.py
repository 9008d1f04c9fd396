"""Script-only pages: what they are, which of them are one page, and what their scripts tell instead of them.

A script's lines are found once for each script, in its own row, and are whole by themselves; pages gather the best of at most ASSETS scripts. Only short arrays are
shuffled, neither pages nor scripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as EV
from ..functions import markup as M
from ..functions import shell as SH
from ..functions import spans as S
from ..functions import urls as U
from ..functions.text import unescape

#: The ids of containers that scripts fill, and the endings of scripts and data.
ROOTS = ("root", "app", "__next", "__nuxt", "svelte")
ENDINGS = r"\.(?:js|mjs|json)\z"
#: Scripts and head lines in a fingerprint, scripts that are read, and lines that are shown.
FINGERPRINTED, HEAD_LINES, ASSETS, SHOWN = 12, 3, 6, 180


def is_shell(page: Column) -> Column:
    """Whether scripts from elsewhere fill the page: a container is a child of the body, or named as React and others name it."""
    low = F.lower(page)
    named = F.contains(low, F.lit("data-reactroot")) | F.contains(low, F.lit('id="root"')) | F.contains(low, F.lit("id='root'"))
    return U.bind(F.coalesce(page, F.lit("")), lambda p: (F.size(M.script_sources(p)) > 0) & (M.has_child(p, ROOTS) | F.coalesce(named, F.lit(False))))


def assets(url: Column, page: Column, most: int) -> Column:
    """The first `most` distinct scripts and data of the page's own registrable domain, as absolute addresses."""

    def own(domain: Column) -> Column:
        all_ = F.transform(F.filter(M.script_sources(F.coalesce(page, F.lit(""))), lambda s: s != ""), lambda s: U.resolve(url, s))
        data = lambda a: U.bind(F.lower(F.trim(U.path(a))), lambda p: p.rlike(ENDINGS) | F.contains(p, F.lit("/assets/")))
        return F.filter(F.array_distinct(all_), lambda a: (domain != "") & (F.trim(U.netloc(a)) != "") & (U.registrable_domain(F.lower(F.trim(U.netloc(a)))) == domain) & data(a))

    return F.slice(U.bind(U.registrable_domain(url), own), 1, most)


def fingerprint(url: Column, page: Column) -> Column:
    """SHA-1 of the first scripts and head lines of a script-only page; '' for other pages and for those that have neither."""
    parts = F.concat(F.transform(assets(url, page, FINGERPRINTED), U.asset_key), F.slice(SH.head_lines(page), 1, HEAD_LINES))
    known = (F.trim(F.coalesce(url, F.lit(""))) != "") & (F.coalesce(page, F.lit("")) != "")
    whole = U.bind(F.filter(parts, lambda x: x != ""), lambda x: F.when(F.size(x) > 0, F.sha1(F.array_join(x, "\n"))).otherwise(""))
    return F.when(known & is_shell(page), whole).otherwise("")


def with_fingerprint(pages: DataFrame) -> DataFrame:
    """pages(url, html) with their fingerprint."""
    return pages.withColumn("fingerprint", fingerprint(F.trim(F.coalesce("url", F.lit(""))), F.col("html")))


def signal_lines(scripts: DataFrame, brief: bool = False) -> DataFrame:
    """(url, lines): all that scripts(url, text) tell of contacts, best first. Of other hosts' mailboxes only those are shown that speak for a contact.

    Brief: within the fixed bounds of what a recovered page shows of a script.
    """
    rows = scripts.select("url", U.registrable_domain("url").alias("domain"), EV.windows(F.col("text"), brief).alias("text"))
    strings = lambda pattern: EV.unquoted(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    rows = rows.select(
        "url", "domain", EV.scored_emails(F.col("domain"), F.col("text")).alias("email"), EV.scored_names(F.col("text")).alias("person"),
        EV.fragments(F.col("text"), brief).alias("pieces"), strings(EV.DOUBLE_QUOTED).alias("double"), strings(EV.SINGLE_QUOTED).alias("single"),
    )
    lines = F.transform(F.concat("pieces", "double", "single"), lambda x: EV.cleared(F.col("domain"), x))
    rows = rows.select("url", "email", "person", EV.routed(lines).alias("routed"))
    of = lambda kind: F.transform(F.filter("routed", lambda r: r["kind"] == kind), lambda r: F.struct(r["score"].alias("score"), r["line"].alias("line")))
    kinds = {"email": F.col("email"), "person": F.concat("person", of("person"))} | {k: of(k) for k in ("role", "company", "general")}
    return rows.select("url", EV.best(kinds, brief).alias("lines"))


def evidence(pages: DataFrame, scripts: DataFrame) -> DataFrame:
    """(page_id, url, lines) of the script-only pages(page_id, url, html): head lines, then what each of their scripts(url, text) tells.

    Pages are told apart by page_id; a script that is given more than once counts once, with its greatest text.
    """
    shells = pages.where(is_shell(F.col("html"))).select("page_id", F.col("url").alias("page"), SH.head_lines(F.col("html")).alias("head"), assets(F.col("url"), F.col("html"), ASSETS).alias("assets"))
    told = signal_lines(scripts.where("url is not null and trim(text) <> ''").groupBy("url").agg(F.max("text").alias("text")), brief=True)
    parts = shells.select("page_id", F.posexplode("assets").alias("pos", "url")).join(told, "url")
    parts = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "lines"))).alias("parts"))  # ASSETS at most
    # the joined lines are named twice, so that Spark does not move them into the decoder's argument, where it cannot evaluate them
    plain = F.when(F.col("joined") != "", F.split(unescape("joined"), "\n")).otherwise(F.array().cast("array<string>"))
    rows = shells.withColumn("joined", F.array_join("head", "\n")).withColumn("head", plain).join(parts, "page_id", "left")
    telling = F.filter("parts", lambda x: F.size(x["lines"]) > 0)  # a filter of rows would be moved below the lines and make them once more
    shown = F.flatten(F.transform(telling, lambda x: F.concat(F.array(F.concat(F.lit("Source Asset: "), x["url"])), x["lines"])))
    return rows.select("page_id", F.col("page").alias("url"), S.distinct(F.concat("head", F.coalesce(shown, F.array().cast("array<string>")))).alias("lines"))


def rendered(url: Column, lines: Column) -> Column:
    """The lines as a page; null where there are none."""
    body = F.array_join(F.transform(F.slice(lines, 1, SHOWN), lambda x: F.concat(F.lit("<p>"), M.escaped(x), F.lit("</p>"))), "")
    head = F.concat(F.lit("<html><body><section data-shell='1'><h1>Recovered shell evidence for "), M.escaped(url), F.lit("</h1>"))
    return F.when(F.size(lines) > 0, F.concat(head, body, F.lit("</section></body></html>")))


def recovered(pages: DataFrame, scripts: DataFrame) -> DataFrame:
    """pages(page_id, url, html) whose script-only ones show the evidence in their scripts, where there is any."""
    told = evidence(pages, scripts).select("page_id", rendered(F.col("url"), F.col("lines")).alias("shown"))
    return pages.join(told, "page_id", "left").withColumn("html", F.coalesce("shown", "html")).drop("shown")
