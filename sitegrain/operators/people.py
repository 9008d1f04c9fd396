"""People of a site from an outside directory, shown as a page of the site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import contains_any
from . import contacts

#: Words in the addresses of people's pages, and how pages name the directory's project.
PATHS = ("our-people", "/people", "leadership", "team", "executive")
PROJECT = r"(?i)media\.umbraco\.io/([a-z0-9_-]+)/"


def sources(pages: DataFrame) -> DataFrame:
    """(site, url, project) of the sites of pages(site, pos, url, html) that have both: the first page of people, and the project that the first page to do so names."""
    rows = pages.select("site", "pos", F.coalesce("url", F.lit("")).alias("url"), F.regexp_extract(F.coalesce("html", F.lit("")), PROJECT, 1).alias("project"))
    first = lambda c, test: F.min_by(F.when(test, F.col(c)), F.when(test, F.struct("pos", "url")))
    found = rows.groupBy("site").agg(first("url", contains_any(F.lower("url"), PATHS)).alias("url"), first("project", F.col("project") != "").alias("project"))
    return found.where("url is not null and project is not null")


def people_pages(people: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, url, html): a page of each of sites(site, url, website) that lists its people(site, pos, name, url, title, departments, location, email).

    People without a name or title are left out; the best ranked stay, as contacts.ranked_biographies has them, in its order.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = people.select("site", "pos", *[text(c).alias(c) for c in ("name", "url", "title", "location", "email")], F.filter(F.transform("departments", lambda d: F.trim(d)), lambda d: d != "").alias("departments"))
    rows = rows.where("name <> '' and title <> ''")
    ranked = contacts.ranked_biographies(rows, keep=("title", "departments", "url", "location", "email"))
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"<p>{label}: "), value, F.lit("</p>"))).otherwise("")
    website = F.col("website")
    known = ranked.join(sites.select("site", F.col("url").alias("page"), "website"), "site")
    origin = F.coalesce(F.nullif(U.origin(F.trim("website")), F.lit("")), F.regexp_replace("website", "/+$", ""))
    card = F.concat(
        F.lit("<article><h2>"), F.col("name"), F.lit("</h2>"), line("Title", F.col("title")), line("Department", F.array_join(F.coalesce("departments", F.array().cast("array<string>")), "; ")),
        line("Location", F.col("location")), line("Profile URL", F.when(F.col("url") == "", origin).otherwise(U.resolve(origin, F.col("url")))), line("Email", F.col("email")), F.lit("</article>"),
    )
    cards = known.groupBy("site", "page", "website").agg(F.array_sort(F.collect_list(F.struct("place", card.alias("card")))).alias("cards"))  # so many as are ranked, at most
    body = F.array_join(F.transform("cards", lambda x: x["card"]), "")
    return cards.select("site", F.col("page").alias("url"), F.concat(F.lit("<main><h1>Public People API Results</h1><p>Homepage: "), website, F.lit("</p>"), body, F.lit("</main>")).alias("html"))
