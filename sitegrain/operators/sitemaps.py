"""Sitemaps of sites, followed level by level under the limits of a site.

A walk goes breadth first: a sitemap is read where it is first met, by level and then by its place under the sitemaps above it, and
never again; so cycles end. Each level is one join with the indexes' entries, and pages are one join with all sitemaps that were read. Entries are parsed
once and checkpointed, as are the levels; places are carried as short arrays, texts are not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import decoding as D
from ..functions import urls as U
from . import candidates

#: Levels below the first sitemaps, and pages that are looked at for each that is wanted, and in all.
DEPTH, LOOKED_AT, MOST = 3, 4, 400
# What stands before the first element is never read twice, so that a file that is no index is not searched to its end.
INDEX = r"(?is)\A\s*+(?>(?:<\?.*?\?>|<!--.*?-->|<!doctype[^>]*+>)\s*+)*+<(?:\w+:)?sitemapindex\b"
ENTRY = r"(?is)<(?:\w+:)?{0}\b[^>]*>.*?</(?:\w+:)?{0}\s*>"
LOC = r"(?is)<(?!image:|video:)(?:\w+:)?loc\s*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc\s*>"


def scan_limit(limit: int) -> int:
    return min(max(LOOKED_AT * limit, limit), MOST)


def texts(files: DataFrame) -> DataFrame:
    """(url, xml) of fetched files(url, content, content_type): packed ones unpacked, by the first character set that fits."""
    return files.select("url", D.unpacked("url", "content", "content_type").alias("xml"))


def entries(files: DataFrame) -> DataFrame:
    """(url, is_index, pos, loc) of sitemap documents files(url, xml), each loc of a file once; of several of one address the greatest text counts."""
    rows = files.where("url is not null").groupBy("url").agg(F.max(F.coalesce("xml", F.lit(""))).alias("xml"))
    index = F.col("xml").rlike(INDEX)
    inside = lambda name: F.regexp_extract_all("xml", F.lit(ENTRY.format(name)), F.lit(0))
    plain = lambda x: F.replace(F.trim(F.regexp_extract(x, LOC, 1)), F.lit("&amp;"), F.lit("&"))
    found = F.transform(F.when(F.col("is_index"), inside("sitemap")).otherwise(inside("url")), plain)
    # all that needs the text is told before its entries are rows of their own; beside them it would be told again for each
    rows = rows.withColumn("is_index", index).select("url", "is_index", F.array_distinct(found).alias("found"))
    return rows.select("url", "is_index", F.posexplode("found").alias("pos", "loc")).where("loc <> ''")


def roots(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, pos, url): the sitemaps that the robots.txt files robots(site, txt) of sites(site, start) name, else /sitemap.xml."""
    named = robots.select("site", F.posexplode(F.regexp_extract_all(F.coalesce("txt", F.lit("")), F.lit(r"(?im)^Sitemap:[^\S\n]*(\S.*)$"), F.lit(1))).alias("pos", "url"))
    named = named.select("site", "pos", F.trim("url").alias("url")).join(sites.select("site").distinct(), "site", "left_semi")
    bare = sites.join(named.select("site").distinct(), "site", "left_anti")
    return named.unionByName(bare.select("site", F.lit(0).alias("pos"), U.resolve("start", F.lit("/sitemap.xml")).alias("url")))


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site", "url").agg(F.min("place").alias("place"))


def of_site(start: Column | str, url: Column | str) -> Column:
    """Whether an address is of the start's host, below it or above it."""
    a, b = F.lower(F.trim(U.netloc(url))), F.lower(F.trim(U.netloc(start)))
    return U.bind(F.struct(a.alias("a"), b.alias("b")), lambda x: (x["a"] != "") & ((x["a"] == x["b"]) | F.endswith(x["a"], F.concat(F.lit("."), x["b"])) | F.endswith(x["b"], F.concat(F.lit("."), x["a"]))))


def walk(files: DataFrame, sites: DataFrame, first: DataFrame, limit: int, depth: int = DEPTH) -> DataFrame:
    """(site, pos, url): the first pages, scan_limit(limit) of a site, of the sitemaps files(url, xml) from first(site, pos, url) on, for sites(site, start).

    Pages are supported addresses of the site's host, each once; sitemaps that were read are no pages.
    """
    listed = cut(entries(files))
    level = _first(first.select("site", "url", F.array(F.col("pos").cast("int")).alias("place")))
    read = [level.withColumn("level", F.lit(0))]
    seen = level.select("site", "url")
    for k in range(depth):  # only the indexes' entries are followed; pages are joined once, when all sitemaps are known
        met = level.join(listed.where("is_index"), "url").select("site", F.col("loc").alias("url"), F.concat("place", F.array("pos")).alias("place"))
        level = cut(_first(met).join(seen, ["site", "url"], "left_anti"))
        read.append(level.withColumn("level", F.lit(k + 1)))
        seen = seen.unionByName(level.select("site", "url"))
    pages = reduce(DataFrame.unionByName, read).join(listed.where("not is_index"), "url")
    rows = _first(pages.select("site", F.col("loc").alias("url"), F.struct("level", F.concat("place", F.array("pos")).alias("place")).alias("place")))
    # each address of a site is tested once; one test of both columns stays above the join
    rows = rows.join(sites.select("site", "start").dropDuplicates(["site"]), "site").where(F.when(of_site("start", "url"), U.is_supported("url")))
    rows = rows.join(seen, ["site", "url"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))
    return rows.withColumn("pos", rank).where(F.col("pos") <= scan_limit(limit)).select("site", F.col("pos").cast("int").alias("pos"), "url")


def discovered(files: DataFrame, sites: DataFrame, robots: DataFrame, limit: int) -> DataFrame:
    """(site, start_url, pos, url): of the pages in a site's sitemaps the `limit` most telling ones."""
    found = walk(files, sites, roots(sites, robots), limit)
    return candidates.discover(found.join(sites.select("site", F.col("start").alias("start_url")).dropDuplicates(["site"]), "site"), limit)
