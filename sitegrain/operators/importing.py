"""Website lists: profile of sheet columns, choice of the website column, normalisation and ordered dedupe.

A sheet is sheet(sheet, row_idx, cells array<string>); row_idx counts from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .candidates import first_of

PROFILE_ROWS, FALLBACK_ROWS, SAMPLES = 120, 50, 5
#: Rows that are numbered or hashed together.
BLOCK_ROWS = 10_000
# Names of a website column, and what parts of a header tell for or against it.
HEADERS = ("website", "url", "domain", "homepage")
HEADER_HINTS = {
    "website": 40, "company website": 60, "official website": 60, "company url": 55, "homepage": 45, "home page": 45, "domain": 35, "company domain": 40,
    "web": 10, "url": 8, "site": 6,
    "linkedin": -120, "facebook": -120, "instagram": -120, "twitter": -120, "x.com": -120, "youtube": -120, "tiktok": -120, "social": -100,
    "email": -140, "e-mail": -140, "mail": -110, "phone": -90, "mobile": -90, "address": -90, "note": -80, "remark": -80, "comment": -80,
}
# What a picker's vote adds by its confidence.
VOTES = {"high": 90.0, "medium": 60.0, "low": 30.0}
OTHER_VOTE = 45.0


def dedupe(rows: DataFrame) -> DataFrame:
    """(input_index, raw_website, website, dedupe_key) of rows(input_index, raw): websites only, the first of each key."""
    rows = rows.withColumn("website", U.normalize_website("raw")).where("website <> ''").withColumn("dedupe_key", U.dedupe_key("website"))
    return first_of(rows, ["dedupe_key"], ["input_index"]).select(F.col("input_index").cast("int").alias("input_index"), F.trim("raw").alias("raw_website"), "website", "dedupe_key")


def header_score(header: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    out = F.lit(0.0)
    for hint, value in HEADER_HINTS.items():
        out = out + F.when(F.contains(low, F.lit(hint)), float(value)).otherwise(0.0)
    return out


def looks_like_note(value: Column) -> Column:
    v = F.trim(value)
    return (F.length(v) >= 24) & F.contains(v, F.lit(" ")) & (U.normalize_website(v) == "") & ~U.looks_like_email(v)


def header_rows(sheet: DataFrame) -> DataFrame:
    """(sheet, has_header): whether row 0 is a header."""
    cells = F.filter(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    first = sheet.where("row_idx = 0").withColumn("c", cells)
    named = F.exists("c", lambda c: F.lower(c).isin(*HEADERS))
    typed = F.exists("c", lambda c: U.looks_like_email(c) | (U.normalize_website(c) != ""))
    labels = F.size(F.filter("c", lambda c: F.length(c) <= 60))
    need = F.greatest(F.when(F.size("c") == 1, 1).otherwise(2), F.floor((F.size("c") + 1) / 2).cast("int"))
    return first.select("sheet", (named | ((F.size("c") > 0) & ~typed & (labels >= need))).alias("has_header"))


def profile(sheet: DataFrame) -> DataFrame:
    """One row per sheet and column: header, counters, samples and local_score, over the first 120 data rows."""
    rows = sheet.join(header_rows(sheet), "sheet")
    cells = rows.select("sheet", "row_idx", "has_header", F.posexplode("cells").alias("col_idx", "cell")).withColumn("cell", F.trim(F.coalesce("cell", F.lit(""))))
    header = cells.where("has_header and row_idx = 0").select("sheet", "col_idx", F.col("cell").alias("header"))
    data = cells.where(F.col("row_idx") >= F.col("has_header").cast("int"))
    data = data.where(F.col("row_idx") < PROFILE_ROWS + F.col("has_header").cast("int")).withColumn("site", U.normalize_website("cell"))
    kind = (
        F.when(F.col("cell") == "", "empty").when(U.looks_like_email("cell"), "email").when((F.col("site") != "") & U.is_social("site"), "social")
        .when(F.col("site") != "", "website").when(looks_like_note(F.col("cell")), "note").otherwise("other")
    )
    data = data.withColumn("kind", kind)
    n = lambda *k: F.count_if(F.col("kind").isin(*k)).cast("int")
    stats = data.groupBy("sheet", "col_idx").agg(
        F.count_if(F.col("kind") != "empty").cast("int").alias("non_empty"), n("website").alias("websites"),
        F.count_if((F.col("kind") == "website") & U.is_homepage("site")).cast("int").alias("homepages"), n("social").alias("socials"), n("email").alias("emails"), n("note").alias("notes"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") != "empty", F.struct("row_idx", "cell")))), 1, SAMPLES), lambda x: x["cell"]), "|").alias("samples"),
    )
    stats = stats.join(header, ["sheet", "col_idx"], "left").withColumn("header", F.when(F.coalesce("header", F.lit("")) != "", F.col("header")).otherwise(F.concat(F.lit("第"), (F.col("col_idx") + 1).cast("string"), F.lit("列"))))
    share = F.when(F.col("non_empty") > 0, F.col("websites") / F.col("non_empty")).otherwise(0.0)
    score = (
        header_score(F.col("header")) + F.col("websites") * 6 + F.col("homepages") * 2 - F.col("socials") * 14 - F.col("emails") * 16 - F.col("notes") * 4
        - F.when(F.col("websites") <= 0, 40).otherwise(0) - F.when(F.col("socials") > F.col("websites"), 80).otherwise(0) - F.when(F.col("emails") > F.col("websites"), 90).otherwise(0)
        + F.when(share >= 0.6, 25).otherwise(0)
    )
    return stats.withColumn("local_score", score.cast("double"))


# Why a column was chosen.
REASONS = {"overruled": "本地规则压过了 LLM 误判，当前列更像公司官网列", "unnamed": "该列里官网样本占比最高", "named": "该列表头和样本都更像公司官网列"}


def selection_reason(header: Column, chosen: Column, voted: Column, reason: Column) -> Column:
    """Why column `chosen` was taken: the picker's own reason where it voted for it, else one of REASONS; `voted` may be null."""
    own = F.trim(F.coalesce(reason, F.lit("")))
    return (
        F.when((voted == chosen) & (own != ""), own).when(voted.isNotNull() & (voted != chosen), REASONS["overruled"])
        .when(F.startswith(F.coalesce(header, F.lit("")), F.lit("第")), REASONS["unnamed"]).otherwise(REASONS["named"])
    )


def picker_payload(profiles: DataFrame) -> DataFrame:
    """(sheet, col_idx, payload): what an outside picker is told of each column, as JSON."""
    samples = F.filter(F.split("samples", r"\|"), lambda x: x != "")
    counts = [F.col(a).alias(b) for a, b in (("non_empty", "non_empty_count"), ("websites", "website_count"), ("homepages", "homepage_count"), ("socials", "social_count"), ("emails", "email_count"), ("notes", "note_count"))]
    told = F.struct(F.col("col_idx").alias("index"), "header", samples.alias("samples"), *counts, F.round("local_score", 2).alias("local_score"))
    return profiles.select("sheet", "col_idx", F.to_json(told).alias("payload"))


def pick_column(profiles: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """(sheet, col_idx): best score and vote, the leftmost on ties; none where the best column has no website.

    votes(sheet, col_idx, confidence) come from an outside picker.
    """
    bonus = F.lit(0.0)
    if votes is not None:
        profiles = profiles.join(votes.select("sheet", "col_idx", "confidence"), ["sheet", "col_idx"], "left")
        bonus = F.when(F.col("confidence").isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in VOTES.items() for x in p]), F.lower("confidence")), F.lit(OTHER_VOTE)))
    best = F.struct(-(F.col("local_score") + bonus), F.col("col_idx"))
    return profiles.groupBy("sheet").agg(F.min_by(F.struct("col_idx", "websites"), best).alias("b")).where("b.websites > 0").select("sheet", F.col("b.col_idx").alias("col_idx"))


def header_column(sheet: DataFrame) -> DataFrame:
    """(sheet, col_idx): the leftmost column whose first row is one of the names of website columns."""
    cells = sheet.where("row_idx = 0").select("sheet", F.posexplode("cells").alias("col_idx", "cell"))
    return cells.where(F.lower(F.trim("cell")).isin(*HEADERS)).groupBy("sheet").agg(F.min("col_idx").alias("col_idx"))


def fallback_column(sheet: DataFrame) -> DataFrame:
    """(sheet, col_idx): the column with most websites in the first 50 rows, the leftmost on ties."""
    cells = sheet.where(F.col("row_idx") < FALLBACK_ROWS).select("sheet", F.posexplode("cells").alias("col_idx", "cell"))
    stats = cells.groupBy("sheet", "col_idx").agg(F.count_if(U.normalize_website("cell") != "").alias("n")).where("n > 0")
    return stats.groupBy("sheet").agg(F.min_by("col_idx", F.struct(-F.col("n"), "col_idx")).alias("col_idx"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows(sheet, row_idx) with input_index, counted from 1 over all sheets by name and row.

    Blocks of BLOCK_ROWS rows are counted first; only their counts, not the rows, are summed up in one order.
    """
    rows = rows.withColumn("block", F.expr(f"row_idx div {BLOCK_ROWS}"))
    counts = rows.groupBy("sheet", "block").agg(F.count("*").alias("n"))
    before = counts.select("sheet", "block", (F.sum("n").over(Window.orderBy("sheet", "block")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("sheet", "block").orderBy("row_idx"))
    return rows.withColumn("k", within).join(before, ["sheet", "block"]).withColumn("input_index", (F.col("before") + F.col("k")).cast("int")).drop("block", "k", "before")


def load_sheet(sheet: DataFrame, picker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Websites of a sheet: profile, choice (with the picker's votes where it has any), projection, dedupe.

    Where no column is chosen, the one with a website column's name is taken, and else that with most websites.
    """
    profiles = profile(sheet)
    chosen = pick_column(profiles, picker(profiles) if picker else None)
    chosen = chosen.unionByName(header_column(sheet).join(chosen, "sheet", "left_anti"))
    chosen = chosen.unionByName(fallback_column(sheet).join(chosen, "sheet", "left_anti"))
    rows = sheet.join(header_rows(sheet), "sheet").where(F.col("row_idx") >= F.col("has_header").cast("int")).join(chosen, "sheet")
    raw = rows.select("sheet", "row_idx", F.trim(F.coalesce(F.get("cells", F.col("col_idx")), F.lit(""))).alias("raw")).where("raw <> ''")
    return dedupe(numbered(raw))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row, sha256: identity of a deduped list, as the hash of the hashes of its blocks of BLOCK_ROWS input rows."""
    block = F.expr(f"input_index div {BLOCK_ROWS}").alias("block")
    items = F.sort_array(F.collect_list(F.struct("input_index", "website", "dedupe_key")))
    blocks = rows.groupBy(block).agg(F.sha2(F.to_json(items), 256).alias("sha256"))
    return blocks.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("block", "sha256")))), 256).alias("sha256"))
