"""Links of pages: same site, same organisation, first-party scripts, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .candidates import first_of

HREF = r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""
SCRIPT = r"""(?i)<script[^>]+src=["']([^"']+)["']"""
LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"


def anchors(pages: DataFrame, *keys: str) -> DataFrame:
    """(*keys, url, pos, link): absolute addresses of the links of pages(*keys, url, html)."""
    rows = pages.select(*keys, "url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("pos", "href"))
    rows = rows.withColumn("href", F.trim("href")).where("href <> ''").where(~F.col("href").rlike("^(?:#|javascript:|mailto:|tel:)"))
    return rows.select(*keys, "url", "pos", U.resolve("url", "href").alias("link"))


def _limited(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    rows = first_of(rows, [*keys, "url", "link"], ["pos"])
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("pos")))
    return rows.where(F.col("pos") <= limit).select(*keys, "url", F.col("pos").cast("int").alias("pos"), "link")


def same_site(pages: DataFrame, limit: int = 80, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, url, pos, link): supported links to the page's host, its sub-domains and parents; `keys` tell pages of one url apart."""
    a, b = F.lower(U.netloc("link")), F.lower(U.netloc("url"))
    near = (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))
    rows = anchors(pages, *keys).where(near).withColumn("link", U.normalize_discovery("link")).where(U.is_supported("link"))
    return _limited(rows, limit, *keys)


def same_organisation(pages: DataFrame, limit: int = 2) -> DataFrame:
    """(url, pos, link): links to other hosts of the same registrable domain that look related."""
    a, b = F.lower(U.netloc("link")), F.lower(U.netloc("url"))
    rows = anchors(pages).where((a != "") & (a != b) & (U.registrable_domain(a) == U.registrable_domain(b)))
    rows = rows.withColumn("link", U.normalize_discovery("link")).where(U.is_related_seed("link") & U.is_supported("link"))
    return _limited(rows, limit)


def first_party_assets(pages: DataFrame, limit: int = 6) -> DataFrame:
    """(url, pos, link): scripts and data of the page's own registrable domain."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(SCRIPT), F.lit(1))).alias("pos", "src"))
    rows = rows.select("url", "pos", U.resolve("url", "src").alias("link")).where(U.registrable_domain(U.netloc("link")) == U.registrable_domain(U.netloc("url")))
    low = F.lower(U.path("link"))
    return _limited(rows.where(low.rlike(r"\.(?:js|mjs|json)$") | F.contains(low, F.lit("/assets/"))), limit)


def sitemap_pages(files: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(site, url): page addresses of sitemaps, followed down `depth` levels.

    files(url, xml) holds sitemap documents, roots(site, url) where to begin. Each level is one join; a sitemap
    seen before is not followed again.
    """
    is_index = F.col("xml").rlike(r"(?i)<sitemapindex\b")
    entries = files.select("url", is_index.alias("is_index"), F.explode(F.regexp_extract_all("xml", F.lit(LOC), F.lit(1))).alias("loc"))
    level, seen, out = roots.select("site", "url").distinct(), roots.select("site", "url").distinct(), None
    for _ in range(depth + 1):
        found = level.join(entries, "url")
        pages = found.where("not is_index").select("site", F.col("loc").alias("url"))
        out = pages if out is None else out.union(pages)
        level = found.where("is_index").select("site", F.col("loc").alias("url")).distinct().join(seen, ["site", "url"], "left_anti")
        seen = seen.union(level)
    return out.where((U.host_key("url") == F.lower("site")) & U.is_supported("url")).distinct()


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(site, url): Sitemap lines of robots.txt texts files(site, txt)."""
    return files.select("site", F.explode(F.regexp_extract_all("txt", F.lit(r"(?im)^Sitemap:\s*(.+)$"), F.lit(1))).alias("url")).select("site", F.trim("url").alias("url"))


def subdomain_probes(links: DataFrame, limit: int = 4) -> DataFrame:
    """(site, pos, url): the first `limit` distinct addresses of links(site, start, pos, url) that lie in start's registrable domain and name a page worth a look."""
    near = (U.netloc("url") != "") & (U.registrable_domain(F.lower(U.netloc("url"))) == U.registrable_domain("start"))
    rows = links.where(near & U.any_of(U.hint_tokens("url"), U.SCAN_WORDS)).groupBy("site", "url").agg(F.min("pos").alias("pos"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("pos", "url"))).where(F.col("k") <= limit)
    return rows.select("site", (F.col("k") - 1).cast("long").alias("pos"), "url")
