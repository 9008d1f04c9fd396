"""Registered queries over script-only pages, long pages, fetched bytes, sitemaps and learned words. What the tables lack is derived from them alike on both sides."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decoding, markdown, truncation
from ..functions import urls as U
from ..functions.batches import mapped
from ..operators import candidates, shells, sitemaps, state
from ..operators import pagesets as PS
from .page_queries import WORDS
from .queries import CANDIDATES, discovered, query, table, values

spark_sql = lambda sql: F.expr(sql.replace("varchar", "string"))

# ---- script-only pages --------------------------------------------------------------------------------------------------

PAGE_WORD = "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS)) + " END"
PAGE_URL = f"'https://firm' || cast(page_id % 20 AS varchar) || '.com/' || {PAGE_WORD} || '/' || cast(page_id AS varchar)"
SCRIPT_FILE = "'/static/app' || cast(page_id % 2 AS varchar) || '.js'"
BODY = f"""CASE page_id % 5 WHEN 0 THEN '<body><div id="app"></div><script src="' || {SCRIPT_FILE} || '"></script><script src="https://cdn.other.org/x.js"></script>'
WHEN 1 THEN '<body><main><div id="app"></div></main><script src="/a.js"></script>' WHEN 2 THEN '<body data-reactroot><script src="https://static.firm' || cast(page_id % 20 AS varchar) || '.com/assets/main"></script>'
WHEN 3 THEN '<body><div id="root"></div>' ELSE '<body><section></section><p>open<div id="__next"></div><script src="' || {SCRIPT_FILE} || '"></script>' END"""
TITLE = "'Firm ' || cast(page_id % 3 AS varchar)"


def shell_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, site, url, html): every page, as one of five kinds of script page; three of them are script-only."""
    rows = table(spark, d, "pages").withColumn("bare", F.regexp_replace("html", "<title>[^<]*</title>", ""))
    head = F.concat(F.lit("<title> "), spark_sql(TITLE), F.lit("\n</title>"))
    body = F.replace(F.regexp_replace("bare", "<body[^>]*>", "<body>"), F.lit("<body>"), spark_sql(BODY))
    return rows.select("page_id", (F.col("page_id") % 20).alias("site"), spark_sql(PAGE_URL).alias("url"), F.concat(head, body).alias("html"))


SQL_SHELLS = f"""shells AS (SELECT page_id, page_id % 20 AS site, {PAGE_URL} AS url, {PAGE_WORD} AS word, CASE WHEN page_id % 5 IN (1, 3) THEN '' ELSE
sha1(CASE WHEN page_id % 5 = 2 THEN 'static.firm' || cast(page_id % 20 AS varchar) || '.com/assets/main' ELSE 'firm' || cast(page_id % 20 AS varchar) || '.com' || {SCRIPT_FILE} END || chr(10) || {TITLE}) END AS fingerprint FROM pages)"""


@query(f"WITH {SQL_SHELLS} SELECT page_id, url, fingerprint FROM shells")
def shell_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return shells.with_fingerprint(shell_pages(spark, d)).select("page_id", "url", "fingerprint")


@query(f"""WITH {SQL_SHELLS}, k AS (SELECT *, count(*) OVER (PARTITION BY site, fingerprint) AS m,
first_value(url) OVER (PARTITION BY site, fingerprint ORDER BY CASE word WHEN 'impressum' THEN -120 WHEN 'contact' THEN -90 WHEN 'about' THEN -76 WHEN 'team' THEN -52 ELSE 0 END, length(url), url) AS best FROM shells WHERE fingerprint <> '')
SELECT site, url, best AS canonical FROM k WHERE m > 1""")
def shell_page_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = shells.with_fingerprint(shell_pages(spark, d))
    starts = rows.select("site").distinct().select("site", F.concat(F.lit("https://firm"), F.col("site").cast("string"), F.lit(".com/")).alias("url"))
    return PS.shell_aliases(rows, starts)


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """(url, text): every document as a script of one of the firms; its first words are a string in it."""
    text = F.concat(F.lit('var t="Contact '), F.regexp_extract("text", r"\A\s*((?:\S+\s+){0,4}\S+)", 1), F.lit(' Impressum";\n'), "text")
    url = F.concat(F.lit("https://firm"), (F.col("doc_id") % 20).cast("string"), F.lit(".com/static/app"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit(".js"))
    return table(spark, d, "documents").select(url.alias("url"), text.alias("text"))


@query()
def script_signals(spark: SparkSession, d: str) -> DataFrame:
    return shells.signal_lines(scripts(spark, d)).select("url", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("lines"))


@query()
def recovered_pages(spark: SparkSession, d: str) -> DataFrame:
    return shells.recovered(shell_pages(spark, d).select("page_id", "url", "html"), scripts(spark, d))


# ---- long pages and bytes -----------------------------------------------------------------------------------------------


@query()
def truncated_pages(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "pages").select("page_id", "html"), 1500)


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", markdown.markdown("html").alias("content"))


@F.arrow_udf(T.BinaryType())
def packed(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(lambda x: x if x is None else gzip.compress(x, 1), pa.binary(), content)


def fetched(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, url, content, content_type): every document as the bytes of a file, in one of four forms."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.when((F.col("doc_id") % 4 == 2) & F.col("text").rlike(r"[^\x00-\xFF]"), 0).otherwise(F.col("doc_id") % 4)
    rows = rows.withColumn("kind", kind)
    plain = F.when(F.col("kind") == 1, F.encode("text", "UTF-16LE")).when(F.col("kind") == 2, F.encode(F.when(F.col("kind") == 2, F.col("text")).otherwise(""), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    kinds = F.when(F.col("kind") == 1, "text/plain; charset=utf-16-le").when(F.col("kind") == 2, 'text/html; Charset="ISO-8859-1"').otherwise("")
    rows = rows.select("doc_id", F.concat(F.lit("https://a.com/"), F.col("doc_id").cast("string")).alias("url"), "kind", plain.alias("plain"), kinds.alias("content_type"))
    return rows.select("doc_id", "url", F.when(F.col("kind") == 3, packed(F.when(F.col("kind") == 3, F.col("plain")))).otherwise(F.col("plain")).alias("content"), "content_type")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def decoded_files(spark: SparkSession, d: str) -> DataFrame:
    return fetched(spark, d).select("doc_id", decoding.unpacked("url", "content", "content_type").alias("text"))


# ---- sitemaps -----------------------------------------------------------------------------------------------------------

MAP_HOST = "'firm' || cast(site AS varchar) || '.com'"
MAP_PAGE = f"""CASE o_orderkey % 7 WHEN 0 THEN 'https://www.' || {MAP_HOST} WHEN 1 THEN 'https://other.org' ELSE 'https://' || {MAP_HOST} END || '/p/' || cast(o_orderkey % 300 AS varchar) || CASE WHEN o_orderkey % 11 = 0 THEN '.pdf' ELSE '' END"""
SITE_OF_ORDER = "o_custkey % 40"


def _urlset(name: str, locs) -> object:
    inside = "sitemap" if name == "sitemapindex" else "url"
    rows = F.array_join(F.transform(locs, lambda x: F.concat(F.lit(f"<{inside}><loc> "), x, F.lit(f" </loc></{inside}>"))), "\n")
    return F.concat(F.lit(f'<?xml version="1.0"?>\n<{name} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), rows, F.lit(f"</{name}>"))


def map_files(spark: SparkSession, d: str) -> DataFrame:
    """(url, xml): for each of 40 sites an index of three sitemaps, of one more index and of itself; pages are orders."""
    rows = table(spark, d, "orders").withColumn("site", spark_sql(SITE_OF_ORDER)).select("site", (F.col("o_orderkey") % 4).alias("part"), "o_orderkey", spark_sql(MAP_PAGE).alias("page"))
    lists = rows.groupBy("site", "part").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "page"))).alias("pages"))
    address = lambda name: F.concat(F.lit("https://"), spark_sql(MAP_HOST), F.lit("/"), name)
    leaves = lists.select(address(F.concat(F.lit("map"), F.col("part").cast("string"), F.lit(".xml"))).alias("url"), _urlset("urlset", F.transform("pages", lambda p: p["page"])).alias("xml"))
    sites = rows.select("site").distinct()
    first = F.when(F.col("site") % 3 == 0, "main.xml").otherwise("sitemap.xml")
    tops = sites.select(address(first).alias("url"), _urlset("sitemapindex", F.array(*[address(F.lit(f"map{k}.xml")) for k in range(3)], address(F.lit("deep.xml")), address(first))).alias("xml"))
    deep = sites.select(address(F.lit("deep.xml")).alias("url"), _urlset("sitemapindex", F.array(address(F.lit("map3.xml")), address(F.lit("map0.xml")))).alias("xml"))
    return leaves.unionByName(tops).unionByName(deep)


@query(f"""WITH o AS (SELECT site, part, row_number() OVER (PARTITION BY site, part ORDER BY o_orderkey) AS n, {MAP_PAGE} AS url FROM (SELECT *, {SITE_OF_ORDER} AS site, o_orderkey % 4 AS part FROM orders)),
f AS (SELECT site, url, min(part * 1000000 + n) AS place FROM o WHERE NOT contains(url, 'other.org') AND NOT ends_with(url, '.pdf') GROUP BY 1, 2)
SELECT site, cast(row_number() OVER (PARTITION BY site ORDER BY place) AS integer) AS pos, url FROM f QUALIFY pos <= {sitemaps.scan_limit(8)}""")
def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "orders").select(spark_sql(SITE_OF_ORDER).alias("site")).distinct().select("site", F.concat(F.lit("https://"), spark_sql(MAP_HOST)).alias("start"))
    named = F.concat(F.lit("User-agent: *\r\nsitemap:  "), "start", F.lit("/main.xml\r\n"))
    robots = sites.select("site", F.when(F.col("site") % 3 == 0, named).otherwise("Disallow: /x").alias("txt"))
    return sitemaps.walk(map_files(spark, d), sites, sitemaps.roots(sites, robots), 8)


# ---- learned words ------------------------------------------------------------------------------------------------------

KIND = "CASE WHEN event_id % 2 = 0 THEN 'representative' ELSE 'email' END"
NOW = "1998-12-01 00:00:00"


@query(f"""WITH b AS (SELECT {KIND} AS kind, 'word' || cast(user_id % 97 AS varchar) AS token FROM events UNION ALL SELECT {KIND}, 'word' || cast(event_id % 13 AS varchar) FROM events),
k AS (SELECT 'email' AS kind, 'word' || cast(s_suppkey AS varchar) AS token, s_suppkey % 5 AS weight FROM supplier UNION ALL SELECT kind, token, 1 FROM b)
SELECT kind, token, cast(sum(weight) AS bigint) AS weight FROM k GROUP BY 1, 2""")
def learned_tokens(spark: SparkSession, d: str) -> DataFrame:
    word = lambda n, lead="word": F.concat(F.lit(lead), n.cast("string"))
    batches = table(spark, d, "events").select(spark_sql(KIND).alias("kind"), F.array(word(F.col("user_id") % 97, " Word"), word(F.col("event_id") % 13), F.lit(" "), F.lit(None)).alias("tokens"))
    known = table(spark, d, "supplier").select(F.lit("email").alias("kind"), word(F.col("s_suppkey")).alias("token"), (F.col("s_suppkey") % 5).alias("weight"))
    return state.bump_tokens(known, batches)


STORED_SQL = f"""stored AS (SELECT *, floor(greatest(epoch(timestamp '{NOW}') - epoch(t), 0) / 1209600) AS w FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'representative' ELSE 'email' END AS kind, 'word' || cast(c_custkey // 2 AS varchar) AS feature,
cast((c_custkey * 7) % 73 AS integer) - 12 AS score, timestamp '1998-06-01' + to_days(cast(c_custkey % 170 AS integer)) AS t FROM customer WHERE c_custkey > 1)),
known AS (SELECT kind, feature, t, cast(CASE WHEN score > 0 AND w > 0 THEN greatest(score - w, 1) ELSE score END AS integer) AS score FROM stored)"""


def stored_scores(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("1998-06-01").cast("date"), (key % 170).cast("int")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "customer").where("c_custkey > 1").select(
        F.when(key % 2 == 0, "representative").otherwise("email").alias("kind"), F.concat(F.lit("word"), F.floor(key / 2).cast("string")).alias("feature"), ((key * 7) % 73 - 12).cast("int").alias("score"), day.alias("updated"))


@query(f"WITH {STORED_SQL} SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY score DESC, feature) AS place, feature, score FROM known WHERE score <> 0")
def ordered_scores(spark: SparkSession, d: str) -> DataFrame:
    return state.load_scores(stored_scores(spark, d), F.lit(NOW).cast("timestamp")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {STORED_SQL}, e AS (SELECT DISTINCT {KIND} AS kind, event_id, unnest(['word' || cast(user_id % 97 AS varchar), 'word' || cast(event_id % 11 AS varchar)]) AS feature, CASE WHEN value < 60 THEN 3 ELSE -1 END AS delta FROM events),
l AS (SELECT kind, feature, list(delta ORDER BY event_id) AS s FROM e GROUP BY 1, 2),
n AS (SELECT l.kind, l.feature, cast(list_reduce(CASE WHEN k.score IS NULL THEN s ELSE list_prepend(k.score, s) END, lambda x, y: least(greatest(x + y, -12), 60)) AS integer) AS score, '{NOW}' AS updated FROM l LEFT JOIN known k USING (kind, feature))
SELECT * FROM n UNION ALL SELECT kind, feature, score, strftime(t, '%Y-%m-%d %H:%M:%S') FROM known ANTI JOIN l USING (kind, feature)""")
def recorded_scores(spark: SparkSession, d: str) -> DataFrame:
    word = lambda n, lead="word": F.concat(F.lit(lead), n.cast("string"))
    features = F.array(word(F.col("user_id") % 97, " Word"), word(F.col("event_id") % 11), word(F.col("user_id") % 97), F.lit(" "))
    events = table(spark, d, "events").select(spark_sql(KIND).alias("kind"), F.col("event_id").alias("seq"), features.alias("features"), F.when(F.col("value") < 60, 3).otherwise(-1).alias("delta"))
    return state.record(stored_scores(spark, d), events, F.lit(NOW).cast("timestamp"))


TAUGHT = ("about", "team", "contact", "leadership", "impressum", "management", "family:about", "family:team", "family:contact", "story", "imprint", "company")
TAUGHT_CASE = f"CASE user_id % {len(TAUGHT)} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(TAUGHT)) + " END"
SQL_TRIMMED = f"list_filter(kept, lambda t: NOT list_contains([{values(U.FAMILY_SKIP)}], t))[1]"


@query(CANDIDATES + f""", ev AS (SELECT {KIND} AS kind, {TAUGHT_CASE} AS feature, list(CASE WHEN value < 60 THEN 3 ELSE -1 END ORDER BY event_id) AS s FROM events GROUP BY 1, 2),
taught AS (SELECT kind, feature, cast(list_reduce(s, lambda x, y: least(greatest(x + y, -12), 60)) AS integer) AS score FROM ev),
kept AS (SELECT site, url, list_filter(p, lambda t: NOT (is_person AND list_contains(names, t)) AND NOT list_contains([{values(U.LEARNING_STOP)}], t)) AS kept FROM per2),
fk AS (SELECT *, CASE WHEN {SQL_TRIMMED} IS NULL THEN NULL ELSE 'family:' || array_to_string(list_slice(list_slice(kept, list_position(kept, {SQL_TRIMMED}), len(kept)), 1, 2), '/') END AS family FROM kept),
feats AS (SELECT site, url, unnest(kept) AS feature FROM fk UNION SELECT site, url, family FROM fk WHERE family IS NOT NULL),
sums AS (SELECT site, url, coalesce(sum(score) FILTER (WHERE kind = 'representative'), 0) AS r, coalesce(sum(score) FILTER (WHERE kind = 'email'), 0) AS e FROM feats JOIN taught USING (feature) GROUP BY 1, 2)
SELECT site, url, cast(learn + coalesce(r, 0) AS integer) AS rep_learn, cast(learn + coalesce(e, 0) AS integer) AS email_learn,
cast(rep_rule + least(learn + coalesce(r, 0), 10) + CASE WHEN is_person THEN 8 ELSE 0 END - rep_noise AS integer) AS rep_final, cast(email_rule + learn + coalesce(e, 0) AS integer) AS email_final
FROM cand LEFT JOIN sums USING (site, url)""")
def learned_candidates(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(spark_sql(KIND).alias("kind"), spark_sql(TAUGHT_CASE).alias("feature"), F.col("event_id").alias("seq"), F.when(F.col("value") < 60, 3).otherwise(-1).alias("delta"))
    rows = candidates.build(discovered(spark, d), state.fold_scores(events))
    return rows.select("site", "url", *[F.col(c).cast("int").alias(c) for c in ("rep_learn", "email_learn", "rep_final", "email_final")])
