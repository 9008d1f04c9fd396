"""Ordered lists of page addresses per site: unions, differences, aliases, coverage, and what of them teaches path words.

A list is a table (site, pos, url). Every operator keeps the order by pos and numbers its result's places from 0 anew. Rows
with a null or blank url are left out. Joins are on (site, url) or (site, key), so a site's list is never one group; only the
numbering orders the rows of a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.scoring import phrase_score

#: Weights of words in addresses of pages that share one script shell.
SHELL_PHRASES = (
    ("impressum", 120), ("imprint", 118), ("legal-notice", 110), ("legal", 100), ("contact-us", 94), ("contact", 90), ("about-us", 82), ("about", 76),
    ("company", 70), ("our-team", 58), ("team", 52), ("people", 48), ("executive-team", 18), ("leadership", 12), ("management", 8),
)
#: Families of e-mail pages, and pages of representatives, that are enough to end the search.
FAMILY_TARGET, REP_TARGET = 6, 5


def _clean(pages: DataFrame) -> DataFrame:
    return pages.withColumn("url", F.trim(F.coalesce("url", F.lit("")))).where("url <> ''")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy(*order)).cast("long") - 1)


def merge(lists: list[DataFrame], limit: int | None = None, key=lambda url: url) -> DataFrame:
    """Ordered union of lists (site, pos, url): the first row of each key(url), at most `limit` for a site."""
    rows = None
    for n, pages in enumerate(lists):
        part = _clean(pages).select("site", F.lit(n).alias("source"), "pos", "url")
        rows = part if rows is None else rows.union(part)
    first = rows.groupBy("site", key(F.col("url")).alias("key")).agg(F.min(F.struct("source", "pos", "url")).alias("x"))
    out = _numbered(first.select("site", "x.*"), "source", "pos", "url").select("site", "pos", "url")
    return out.where(F.col("pos") < limit) if limit is not None else out


def exclude(pages: DataFrame, others: DataFrame, key=U.canonical) -> DataFrame:
    """Rows of pages(site, pos, url) whose key is not among the others' (site, url)."""
    gone = _clean(others).select("site", key(F.col("url")).alias("key")).distinct()
    return _numbered(_clean(pages).withColumn("key", key(F.col("url"))).join(gone, ["site", "key"], "left_anti"), "pos", "url").select("site", "pos", "url")


def promote(pages: DataFrame, priority: DataFrame) -> DataFrame:
    """pages(site, pos, url) with the first one equal to priority(site, url) in front, its other spellings dropped; nothing is added."""
    wanted = _clean(priority).select("site", U.canonical("url").alias("wanted")).dropDuplicates(["site"])
    rows = _clean(pages).withColumn("key", U.canonical("url")).join(wanted, "site", "left").withColumn("hit", F.col("key").eqNullSafe(F.col("wanted")))
    first = F.row_number().over(Window.partitionBy("site", "hit").orderBy("pos"))
    rows = rows.withColumn("n", first).where(~F.col("hit") | (F.col("n") == 1)).withColumn("later", ~F.col("hit"))
    return _numbered(rows, "later", "pos", "url").select("site", "pos", "url")


def latest(pages: DataFrame) -> DataFrame:
    """(site, url, html): of pages(site, seq, url, html) the last one of each url."""
    return pages.groupBy("site", "url").agg(F.max_by("html", "seq").alias("html"))


def select(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """(site, pos, url, html) of the rows of pages(site, pos, url) that were fetched(site, url, html)."""
    return _numbered(_clean(pages).select("site", "pos", "url").join(fetched.select("site", "url", "html"), ["site", "url"]), "pos", "url").select("site", "pos", "url", "html")


def email_rule_pages(primary: DataFrame, representative: DataFrame, fetched: DataFrame, overflow: DataFrame | None = None) -> DataFrame:
    """Pages that the e-mail rules read: e-mail pages, then those of representatives, each url once."""
    return select(merge([primary, *([overflow] if overflow is not None else []), representative]), fetched)


def without_reused(planned: DataFrame, homes: DataFrame) -> DataFrame:
    """planned(site, pos, url) without homepages(site, url, html) that are at hand already."""
    have = homes.where(F.coalesce(F.length("html"), F.lit(0)) > 0).select("site", "url").distinct()
    return _numbered(_clean(planned).join(have, ["site", "url"], "left_anti"), "pos", "url").select("site", "pos", "url")


def shell_key(url: Column) -> Column:
    """Sort key of the pages of one shell: most telling words, then least depth, then shortest."""
    low = F.lower(F.trim(url))
    bare = F.regexp_replace(F.regexp_replace(low, "/+$", ""), "^.*?://", "")
    path = F.regexp_replace(bare, "^[^/]*/", "")
    return F.struct((-phrase_score(low, SHELL_PHRASES)).alias("score"), (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"), F.length(low).alias("length"), low.alias("url"))


def shell_aliases(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """(site, url, canonical) of pages(site, url, fingerprint) that share a fingerprint with another; '' and null are none.

    The canonical page is the start(site, url) if it is among them, else that with the smallest shell_key.
    """
    rows = _clean(pages).where("fingerprint <> ''").dropDuplicates(["site", "url"])
    rows = rows.join(starts.select("site", F.col("url").alias("start")), "site", "left")
    groups = rows.groupBy("site", "fingerprint").agg(F.count("*").alias("n"), F.max(F.when(F.col("url") == F.col("start"), F.col("url"))).alias("home"), F.min_by("url", shell_key(F.col("url"))).alias("best")).where("n > 1")
    return rows.join(groups, ["site", "fingerprint"]).select("site", "url", F.coalesce("home", "best").alias("canonical"))


def canonicalize(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """pages(site, pos, url) with aliases(site, url, canonical) put in, each address once."""
    rows = _clean(pages).join(aliases, ["site", "url"], "left").withColumn("url", F.coalesce("canonical", "url"))
    return merge([rows.select("site", "pos", "url")])


def checked_evidence(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """answers(site, company_name, representative, evidence_url, evidence_quote), blanked where their evidence was not fetched.

    The address is that of pages(site, seq, url) with the same canonical form, the last of several.
    """
    known = _clean(pages).groupBy("site", U.canonical("url").alias("key")).agg(F.max_by("url", "seq").alias("found"))
    some = pages.select("site").distinct().withColumn("any", F.lit(True))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = answers.withColumn("key", U.canonical("evidence_url")).join(known, ["site", "key"], "left").join(some, "site", "left")
    name = F.when(F.col("found").isNotNull(), text("representative")).otherwise("")
    return rows.select(
        "site", F.when(F.col("any"), text("company_name")).otherwise("").alias("company_name"), name.alias("representative"),
        F.coalesce("found", F.lit("")).alias("evidence_url"), F.when(name != "", text("evidence_quote")).otherwise("").alias("evidence_quote"),
    )


def coverage(candidates: DataFrame, representative: DataFrame, email: DataFrame, strong: tuple[str, ...], rep_target: int = REP_TARGET) -> DataFrame:
    """(site, rep_pages, families, confident, enough): whether a site's selected pages are enough.

    candidates(site, url, family_key, is_person, tokens); confident: a selected page of a person, or with a strong word.
    """
    known = candidates.select("site", "url", "family_key", (F.col("is_person") | U.any_of(F.col("tokens"), strong)).alias("strong"))
    rep = _clean(representative).join(known, ["site", "url"], "left").groupBy("site").agg(F.count("*").alias("rep_pages"), F.coalesce(F.bool_or("strong"), F.lit(False)).alias("confident"))
    families = _clean(email).join(known, ["site", "url"]).groupBy("site").agg(F.countDistinct("family_key").alias("families"))
    rows = candidates.select("site").distinct().join(rep, "site", "left").join(families, "site", "left")
    rows = rows.select("site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rep_pages", "families")], F.coalesce("confident", F.lit(False)).alias("confident"))
    return rows.withColumn("enough", (F.col("rep_pages") >= rep_target) & (F.col("families") >= FAMILY_TARGET) & F.col("confident"))


def wants_overflow(representative: Column, same_domain: Column, overflow: Column, stop: int = 2) -> Column:
    """Whether the overflow e-mail pages are fetched: there are some, and the representative or addresses of the own domain are missing."""
    missing = F.trim(F.coalesce(representative, F.lit(""))) == ""
    return F.coalesce(overflow, F.lit(0)).cast("long").__gt__(0) & (missing | (F.coalesce(same_domain, F.lit(0)) < stop))


def feedback(results: DataFrame, sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """(site, kind, feature): path words that led to a result, each once for a site and kind.

    results(site, representative, evidence_url, emails); sources(site, url) of the addresses found; fetched(site, kind, url).
    Evidence counts only from fetched pages. Words that led nowhere are never reported.
    """
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    rep = results.where(text("representative") & text("evidence_url")).select("site", F.lit("representative").alias("kind"), F.col("evidence_url").alias("url"))
    mail = results.where(text("emails")).select("site").join(sources.select("site", "url"), "site").select("site", F.lit("email").alias("kind"), "url")
    kept = rep.union(mail).distinct().join(fetched.select("site", "kind", "url").distinct(), ["site", "kind", "url"], "left_semi")
    words = U.bind(U.path_tokens("url"), lambda t: U.learning_tokens(t, U.is_person_page(U.trim_family(t))))
    return kept.select("site", "kind", F.explode(words).alias("feature")).distinct()


#: Words of a page that names its people with some certainty.
STRONG_WORDS = (
    "board", "chair", "chairman", "chief", "director", "executive", "founder", "governance", "impressum", "imprint", "kontakt", "leadership",
    "management", "officers", "owner", "partner", "partners", "president", "principal", "solicitor", "team", "uber", "ueber",
)
