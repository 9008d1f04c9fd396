"""Contacts of sites from their pages: e-mail addresses, phones and company names.

Pages are pages(site, page_pos, url, html). HTML is turned into short rows at once, so no shuffle carries it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import companies as N
from ..functions import emails as E
from ..functions import phones as P
from ..functions import scoring as SC
from ..functions import urls as U
from ..functions.text import json_ld_names, unescape
from .candidates import first_of

DIRECTORY_EMAILS, DIRECTORY_DOMAINS = 8, 5


def split_emails(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, pos, email) normalised, without placeholders and repeats, and without at<role> next to <role>."""
    rows = rows.withColumn("found", E.normalized(F.coalesce("email", F.lit("")))).where(E.valid(F.col("found")))
    rows = rows.withColumn("email", F.col("found.email")).drop("found").where(~E.is_placeholder(F.col("email")))
    rows = first_of(rows, [*keys, "email"], ["pos"])
    base = F.when(E.local(F.col("email")).rlike("^at..*") & E.squash(F.substring(E.local(F.col("email")), 3, 300)).isin(*E.ROLES), F.substring("email", 3, 1000))
    # no role begins with "at" and another role, so <role> itself has no base and meets at<role> in one group
    rows = rows.withColumn("base", base)
    mates = Window.partitionBy(*keys, F.coalesce("base", "email"))
    return rows.withColumn("known", F.max(F.col("base").isNull()).over(mates)).where("base is null or not known").drop("known", "base")


def filter_emails(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, site_domain, pos, email) that belong to the site, best first in pos (from 1)."""
    rows = split_emails(rows, keys).withColumn("same", E.matches_site(F.col("site_domain"), F.col("email"))).withColumn("local_key", E.squash(E.local(F.col("email"))))
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("has_same", F.max("same").over(every))
    same_local = F.max("same").over(Window.partitionBy(*keys, "local_key"))
    rows = rows.withColumn("same_local", same_local & ~F.col("same"))
    free = F.col("site_domain") == ""
    rows = rows.where(free | F.col("same") | (~F.col("same_local") & E.keep_offsite(F.col("email"), F.col("has_same"))))
    # of one mailbox name at hosts that begin with each other, the shortest host stays
    group = Window.partitionBy(*keys, "local_key").orderBy(F.length(E.domain(F.col("email"))), "email")
    rows = rows.withColumn("winner", E.domain(F.first("email").over(group))).withColumn("rank", F.row_number().over(group))
    d, w = E.domain(F.col("email")), F.col("winner")
    rows = rows.where(free | (F.col("rank") == 1) | (F.col("local_key") == "") | ~(F.startswith(d, w) | F.startswith(w, d)))
    place = Window.partitionBy(*keys).orderBy(F.desc(E.priority(F.col("email"))), F.desc("same"), "pos")
    return rows.withColumn("pos", F.row_number().over(place)).select(*keys, "site_domain", "pos", "email", "same")


def page_emails(pages: DataFrame) -> DataFrame:
    """(site, page_pos, url, pos, email): what each page tells, without directory-like pages."""
    rows = pages.select("site", "page_pos", "url", U.registrable_domain("site").alias("site_domain"), unescape("html").alias("body"))
    rows = rows.withColumn("seen", E.find(F.col("body"))).withColumn("hidden", E.find(F.col("body"), keep_scripts=True)).drop("body")
    keys = ["site", "page_pos", "url"]
    listed = lambda c, part: F.transform(c, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("i"), x.alias("raw")))
    both = rows.select(*keys, "site_domain", F.inline(F.concat(listed("seen", 0), listed("hidden", 1)))).withColumn("found", E.normalized(F.coalesce("raw", F.lit(""))))
    both = both.where(E.valid(F.col("found"))).withColumn("email", F.col("found.email"))
    both = both.where((F.col("part") == 0) | E.matches_site(F.col("site_domain"), F.col("email")))
    order = F.struct("part", F.when(F.col("part") == 0, 0).otherwise(-E.priority(F.col("email"))).alias("p"), "i")
    clean = split_emails(both.select(*keys, "site_domain", order.alias("pos"), "email"), keys)
    clean = clean.withColumn("same", E.matches_site(F.col("site_domain"), F.col("email"))).withColumn("host", U.registrable_domain(E.domain(F.col("email"))))
    page = Window.partitionBy(*keys)  # no larger than what one page holds
    listing = ~F.max("same").over(page) & (F.count("*").over(page) >= DIRECTORY_EMAILS) & (F.size(F.collect_set("host").over(page)) >= DIRECTORY_DOMAINS)
    clean = clean.withColumn("listing", listing).where("not listing").drop("listing", "host", "same")
    kept = filter_emails(clean, keys)
    return kept.where(~E.is_typo(F.col("site_domain"), F.col("email"))).select(*keys, "pos", "email")


def site_emails(hits: DataFrame) -> DataFrame:
    """(site, pos, email) from page_emails: over all pages of a site, best first."""
    rows = hits.select("site", U.registrable_domain("site").alias("site_domain"), F.struct("page_pos", "pos").alias("pos"), "email")
    rows = filter_emails(rows, ["site"])
    rows = rows.where(~E.is_typo(F.col("site_domain"), F.col("email")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("pos")).cast("int")).select("site", "pos", "email")


def drop_extensions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, phone) without numbers that are another one with one to four digits more."""
    rows = rows.withColumn("sig", P.signature(F.col("phone")))
    # each number meets those that are its own beginning, one to four digits shorter
    cuts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.struct(n.alias("cut"), F.substring("sig", F.lit(1), F.length("sig") - n).alias("stem")))
    rows = rows.select("*", F.inline(cuts)).withColumn("met", F.max(F.col("cut") == 0).over(Window.partitionBy(*keys, "stem")) & (F.col("cut") > 0))
    rows = rows.withColumn("longer", F.max("met").over(Window.partitionBy(*keys, "sig"))).where("cut = 0 and not longer")
    return rows.drop("sig", "cut", "stem", "met", "longer")


def page_phones(pages: DataFrame) -> DataFrame:
    """(site, page_pos, url, pos, phone)."""
    rows = pages.select("site", "page_pos", "url", F.col("html"), unescape("html").alias("body"))
    rows = rows.select("site", "page_pos", "url", F.posexplode(P.candidates(F.col("html"), F.col("body"))).alias("pos", "raw"))
    rows = rows.withColumn("phone", P.normalized(F.col("raw"))).where("phone <> ''").drop("raw")
    rows = first_of(rows.withColumn("sig", P.signature(F.col("phone"))), ["site", "page_pos", "url", "sig"], ["pos"]).drop("sig")
    return drop_extensions(rows, ["site", "page_pos", "url"]).select("site", "page_pos", "url", "pos", "phone")


def site_phones(hits: DataFrame) -> DataFrame:
    """(site, pos, phone) from page_phones, the first spelling of each number, without extensions."""
    rows = first_of(hits.withColumn("sig", P.signature(F.col("phone"))), ["site", "sig"], ["page_pos", "pos"]).drop("sig")
    rows = drop_extensions(rows, ["site"])
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("page_pos", "pos")).cast("int")).select("site", "pos", "phone")


def company_candidates(pages: DataFrame) -> DataFrame:
    """(site, page_pos, k, base, raw): JSON-LD names 22, og:site_name 20, first h1 14, first title 10, other titles 8, and the page's weight."""
    html = F.coalesce("html", F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def attribute(tag, name):
        both = F.regexp_extract_all(tag, F.lit(rf"(?is)(?<![-\w:.]){name}\s*=\s*(['\"])(.*?)\1"), F.lit(2))
        return F.trim(F.coalesce(F.try_element_at(both, F.lit(-1)), F.lit("")))

    def meta(tag):
        key = F.lower(F.coalesce(F.nullif(attribute(tag, "property"), F.lit("")), attribute(tag, "name")))
        base = F.when(key == "og:site_name", 20).when(key.isin("application-name", "twitter:title", "og:title"), 8).otherwise(0)
        return F.struct(base.alias("base"), attribute(tag, "content").alias("raw"))

    ld = json_ld_names(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)))
    one = lambda base, v: F.array(F.struct(F.lit(base).alias("base"), v.alias("raw")))
    title, h1 = (F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1) for t in ("title", "h1"))
    none = F.array().cast("array<struct<base:int,raw:string>>")
    found = F.concat(
        F.transform(ld, lambda n: F.struct(F.lit(22).alias("base"), n.alias("raw"))),
        F.filter(F.transform(tags, meta), lambda m: (m["base"] > 0) & (m["raw"] != "")),
        F.when(title != "", one(10, title)).otherwise(none),
        F.when((h1 != "") & ~F.startswith(F.lower(F.trim(h1)), F.lit("recovered shell evidence for ")), one(14, h1)).otherwise(none),
    )
    rows = pages.select("site", "page_pos", N.page_weight(F.col("url")).alias("weight"), F.posexplode(found).alias("k", "x"))
    return rows.select("site", "page_pos", "k", (F.col("x.base") + F.col("weight")).alias("base"), F.col("x.raw").alias("raw"))


def company_names(candidates: DataFrame) -> DataFrame:
    """(site, company_name): the best candidate of each site whose name is not empty."""
    rows = candidates.withColumn("name", N.normalized(N.clean(unescape(F.coalesce("raw", F.lit(""))))))
    rows = rows.where("name <> ''").withColumn("score", N.score(F.col("name"), N.site_token(F.col("site")), F.col("base")))
    best = F.min_by("name", F.struct(-F.col("score"), F.length("raw"), F.lower("raw"), "page_pos", "k"))
    return rows.groupBy("site").agg(best.alias("company_name"))


def contacts(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(input_index, site, company_name, emails, phones), one row per site in sites(input_index, site)."""
    joined = lambda rows, c: rows.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "; ").alias(c + "s"))
    out = sites.join(company_names(company_candidates(pages)), "site", "left")
    out = out.join(joined(site_emails(page_emails(pages)), "email"), "site", "left").join(joined(site_phones(page_phones(pages)), "phone"), "site", "left")
    return out.select("input_index", "site", *[F.coalesce(c, F.lit("")).alias(c) for c in ("company_name", "emails", "phones")])


def ranked_biographies(people: DataFrame, limit: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """(site, place, name, score, *keep): people(site, pos, name, title, departments) by falling title score, then name, then pos; at most `limit` for a site."""
    rows = people.select("site", "pos", "name", SC.biography_score("title", "departments").alias("score"), *keep)
    order = Window.partitionBy("site").orderBy(F.desc("score"), F.lower(F.coalesce("name", F.lit(""))), "pos")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)
    return rows.select("site", "place", "name", "score", *keep)
