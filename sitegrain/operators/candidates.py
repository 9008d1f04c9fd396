"""Candidate pages of each site: scores, selection under limits, and the fetch plan.

Greedy choices are windows: a page's rank within its family and the number of strong families decide what a
greedy walk down the ranking would keep. All windows are partitioned by site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import urls as U

STRONG_EMAIL, STOP_EMAIL, EMAIL_LIMIT, FAMILY_TARGET = 12, 8, 32, 6
LEARN_CAP, PERSON_BONUS, TEACHERS = 10, 8, 40


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def discover(found: DataFrame, limit: int) -> DataFrame:
    """(site, start_url, pos, url): found(site, start_url, pos, url) normalised, distinct, by priority, at most `limit` a site."""
    rows = found.withColumn("url", U.normalize_discovery("url")).where("url <> ''")
    rows = first_of(rows, ["site", "url"], ["pos"]).withColumn("priority", S.discovery_priority("start_url", "url"))
    w = Window.partitionBy("site").orderBy(F.desc("priority"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("site", "start_url", F.col("rank").alias("pos"), "url")


def build(discovered: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Candidates with their scores from discovered(site, start_url, pos, url) and learned(kind, feature, score).

    The start page is always a candidate, the first one.
    """
    starts = discovered.select("site", "start_url").distinct().select("site", "start_url", F.lit(-1).alias("pos"), F.col("start_url").alias("url"))
    rows = starts.unionByName(discovered.select("site", "start_url", "pos", F.trim("url").alias("url"))).where("url <> ''")
    rows = first_of(rows, ["site", "url"], ["pos"])
    rows = rows.withColumn("discovery_order", (F.row_number().over(Window.partitionBy("site").orderBy("pos")) - 1).cast("int")).drop("pos")
    rows = rows.withColumn("path_tokens", U.path_tokens("url")).withColumn("depth", U.depth("url")).withColumn("family_key", U.family_key(F.col("path_tokens")))
    rows = rows.withColumn("is_person", U.is_person_page(U.trim_family(F.col("path_tokens")))).withColumn("tokens", U.learning_tokens(F.col("path_tokens"), F.col("is_person")))
    low, p = F.lower("url"), F.col("path_tokens")
    home = F.col("url") == F.col("start_url")
    rep = S.token_score(p, S.weights(S.REPRESENTATIVE)) + S.phrase_score(low, S.PHRASES + S.REPRESENTATIVE_PHRASES) + F.when(home, 30).otherwise(0) + F.when(F.col("is_person"), 12).otherwise(0)
    email = S.token_score(p, S.weights(S.EMAIL)) + S.phrase_score(low, S.PHRASES + S.EMAIL_PHRASES) + F.when(home, 20).otherwise(0)
    off = F.least("depth", F.lit(6)) + U.locale_penalty("start_url", "url")
    rows = rows.withColumn("rep_raw", rep).withColumn("rep_noise", S.noise_penalty(p, F.col("depth"), F.col("rep_raw")))
    rows = rows.withColumn("rep_rule", F.col("rep_raw") - off).withColumn("email_rule", email - off).drop("rep_raw")
    rows = _with_learned(rows, learned)
    rep_final = F.col("rep_rule") + F.least("rep_learn", F.lit(LEARN_CAP)) + F.when(F.col("is_person"), PERSON_BONUS).otherwise(0) - F.col("rep_noise")
    return rows.withColumn("rep_final", rep_final.cast("int")).withColumn("email_final", (F.col("email_rule") + F.col("email_learn")).cast("int"))


def _with_learned(rows: DataFrame, learned: DataFrame | None) -> DataFrame:
    """Learned scores of the tokens: a join on the feature, summed by candidate; negative words cost 6 here as well."""
    bad = F.size(F.filter("tokens", lambda t: t.isin(*U.NEGATIVE))) * -6
    if learned is None:
        return rows.withColumn("rep_learn", bad).withColumn("email_learn", bad)
    tokens = rows.select("site", "url", F.explode("tokens").alias("feature"))
    sums = tokens.join(learned.select("kind", "feature", "score"), "feature").groupBy("site", "url").agg(
        F.sum(F.when(F.col("kind") == "representative", F.col("score"))).alias("r"), F.sum(F.when(F.col("kind") == "email", F.col("score"))).alias("e"))
    rows = rows.join(sums, ["site", "url"], "left")
    return rows.withColumn("rep_learn", bad + F.coalesce("r", F.lit(0))).withColumn("email_learn", bad + F.coalesce("e", F.lit(0))).drop("r", "e")


def representative_pages(candidates: DataFrame, target: int = 5) -> DataFrame:
    """(site, url, role, pos): up to `target` pages likely to name a representative, and the pool of others worth asking about."""
    order = [F.desc("rep_final"), "depth", "discovery_order", "url"]
    rows = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    open_ = rows.withColumn("open", (F.col("rep_final") > 0) | (F.col("rank") == 1))
    family = Window.partitionBy("site", "is_person", "family_key", "open").orderBy("rank")
    open_ = open_.withColumn("head", F.col("open") & (F.row_number().over(family) == 1))
    chosen = F.sum(F.col("head").cast("int")).over(Window.partitionBy("site").orderBy("rank"))
    rows = open_.withColumn("n", chosen).withColumn("chosen", F.col("head") & (F.col("n") <= target))
    rest = rows.where(~F.col("chosen") & (F.col("is_person") | (F.col("rep_noise") < 18)))
    teachers = rest.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("rank"))).where(F.col("pos") <= TEACHERS)
    return rows.where("chosen").select("site", "url", F.lit("representative").alias("role"), F.col("n").cast("int").alias("pos")).unionByName(
        teachers.select("site", "url", F.lit("teacher").alias("role"), F.col("pos").cast("int").alias("pos")))


def email_pages(candidates: DataFrame) -> DataFrame:
    """(site, url, pos): pages likely to hold e-mail addresses, at most 32 a site."""
    order = [F.desc("email_final"), "depth", "url"]
    rows = candidates.where("email_final > 0").withColumn("strong", F.col("email_final") >= STRONG_EMAIL)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("site", "family_key").orderBy(*order)))
    strong = F.size(F.collect_set(F.when(F.col("strong"), F.col("family_key"))).over(Window.partitionBy("site")))
    rows = rows.withColumn("families", strong)
    rows = rows.where(((F.col("k") == 1) | (F.col("strong") & (F.col("k") <= 2))) & ~((F.col("email_final") < STOP_EMAIL) & (F.col("families") >= FAMILY_TARGET)))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    return rows.where(F.col("pos") <= EMAIL_LIMIT).select("site", "url", F.col("pos").cast("int").alias("pos"))


def _unique(rows: DataFrame) -> DataFrame:
    """rows(site, start_url, url, pos) by canonical address: the start page's first, then in order."""
    rows = rows.where("trim(url) <> ''").withColumn("key", U.canonical("url")).withColumn("late", (F.col("key") != U.canonical("start_url")).cast("int"))
    rows = first_of(rows, ["site", "key"], ["pos"])
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("late", "pos"))).drop("late")


def fetch_plan(starts: DataFrame, rep: DataFrame, email: DataFrame, rep_limit: int = 5, soft: int = 8, hard: int = 16, total: int = 20) -> DataFrame:
    """(site, role, pos, url): which pages to read for what, under the page limits.

    starts(site, start_url), rep(site, url, pos), email(site, url, pos). Roles: rep, homepage, email_primary, email_overflow.
    """
    r = _unique(rep.select("site", "url", "pos").join(starts, "site")).where(F.col("pos") <= max(min(rep_limit, total), 0))
    used = r.groupBy("site").agg(F.count("*").alias("n_rep"), F.collect_set("url").alias("rep_urls"))
    home = starts.join(used, "site", "left").withColumn("n_rep", F.coalesce("n_rep", F.lit(0)))
    home = home.withColumn("home", (F.col("start_url") != "") & ~F.coalesce(F.array_contains("rep_urls", F.col("start_url")), F.lit(False)) & (F.col("n_rep") < total))
    taken = r.select("site", "key").union(home.where("home").select("site", U.canonical("start_url")))
    e = _unique(email.select("site", "url", "pos").join(starts, "site")).join(taken.distinct(), ["site", "key"], "left_anti")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).join(home.select("site", "n_rep", "home"), "site")
    cap = F.greatest(F.least(F.lit(hard), F.lit(total) - F.col("n_rep") - F.col("home").cast("int")), F.lit(0))
    e = e.where(F.col("pos") <= cap).withColumn("first", F.greatest(F.least(F.lit(soft), cap), F.lit(0)))
    role = F.when(F.col("pos") <= F.col("first"), "email_primary").otherwise("email_overflow")
    place = F.when(F.col("pos") <= F.col("first"), F.col("pos")).otherwise(F.col("pos") - F.col("first"))
    return (
        r.select("site", F.lit("rep").alias("role"), F.col("pos").cast("int").alias("pos"), "url")
        .unionByName(home.where("home").select("site", F.lit("homepage").alias("role"), F.lit(1).alias("pos"), F.col("start_url").alias("url")))
        .unionByName(e.select("site", role.alias("role"), place.cast("int").alias("pos"), "url"))
    )
