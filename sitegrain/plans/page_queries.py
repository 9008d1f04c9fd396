"""Registered queries over page lists, page texts and contact lines. Lists that the tables lack are derived from their keys alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pagetext as PT
from ..functions import scoring as SC
from ..functions import shell as SH
from ..functions import text as T
from ..functions import urls as U
from ..operators import contacts, importing, links, state
from ..operators import pagesets as PS
from .queries import PROFILE, query, sheet, sites_table, table, values

WORDS = ("about", "contact", "team", "impressum", "news", "our-story")
CASE = "CASE l_partkey % 6 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS)) + " END"
URL = f"'https://' || CASE WHEN l_linenumber % 2 = 0 THEN 'www.' ELSE '' END || 'firm' || cast(l_orderkey % 50 AS varchar) || '.com/' || {CASE} || CASE WHEN l_linenumber % 3 = 0 THEN '/' ELSE '' END"
SQL_LIST = f"list AS (SELECT l_orderkey AS site, l_partkey * 10 + l_linenumber AS pos, {URL} AS url, {CASE} AS word, l_linenumber AS n FROM lineitem)"
HOME = "'https://firm' || cast(o_orderkey % 50 AS varchar) || '.com/'"


def page_list(spark: SparkSession, d: str) -> DataFrame:
    expr = lambda sql: F.expr(sql.replace("varchar", "string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), expr(URL).alias("url"), expr(CASE).alias("word"), F.col("l_linenumber").alias("n"))


def homes(spark: SparkSession, d: str, end: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("site"), F.concat(F.expr(HOME.replace("varchar", "string")), F.lit(end)).alias("url"))


def numbered(order: str) -> str:
    return f"row_number() OVER (PARTITION BY site ORDER BY {order}) - 1"


@query(f"""WITH {SQL_LIST}, f AS (SELECT site, CASE WHEN n <= 3 THEN 0 ELSE 1 END AS source, pos, url, row_number() OVER (PARTITION BY site, word ORDER BY CASE WHEN n <= 3 THEN 0 ELSE 1 END, pos, url) AS r FROM list),
g AS (SELECT site, {numbered('source, pos, url')} AS pos, url FROM f WHERE r = 1) SELECT * FROM g WHERE pos < 4""")
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = page_list(spark, d)
    return PS.merge([rows.where("n <= 3"), rows.where("n > 3")], 4, U.canonical)


@query(f"WITH {SQL_LIST} SELECT site, {numbered('pos, url')} AS pos, url FROM list a WHERE n <= 4 AND NOT EXISTS (SELECT 1 FROM list b WHERE b.site = a.site AND b.word = a.word AND b.n > 4)")
def remaining_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = page_list(spark, d)
    return PS.exclude(rows.where("n <= 4"), rows.where("n > 4"))


@query(f"""WITH {SQL_LIST}, r AS (SELECT *, site IN (SELECT o_orderkey FROM orders) AND word = 'contact' AS hit, row_number() OVER (PARTITION BY site, word ORDER BY pos) AS k FROM list)
SELECT site, {numbered('CASE WHEN hit THEN 0 ELSE 1 END, pos, url')} AS pos, url FROM r WHERE NOT hit OR k = 1""")
def promoted_pages(spark: SparkSession, d: str) -> DataFrame:
    return PS.promote(page_list(spark, d), homes(spark, d, "contact"))


SQL_ALIASES = f"""{SQL_LIST}, p AS (SELECT DISTINCT site, url, word, CASE WHEN word IN ('about', 'contact') THEN 'f1' WHEN word IN ('team', 'impressum') THEN 'f2' WHEN word = 'our-story' THEN 'f3' ELSE '' END AS fp FROM list),
k AS (SELECT *, count(*) OVER (PARTITION BY site, fp) AS m, max(CASE WHEN url = s.u THEN url END) OVER (PARTITION BY site, fp) AS home,
first_value(url) OVER (PARTITION BY site, fp ORDER BY CASE word WHEN 'impressum' THEN -120 WHEN 'contact' THEN -90 WHEN 'about' THEN -76 WHEN 'team' THEN -52 ELSE 0 END, length(url), url) AS best
FROM p LEFT JOIN (SELECT o_orderkey AS o, {HOME} || 'team' AS u FROM orders) s ON o = site WHERE fp <> ''),
aliases AS (SELECT site, url, coalesce(home, best) AS canonical FROM k WHERE m > 1)"""


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    word = F.col("word")
    shell = F.when(word.isin("about", "contact"), "f1").when(word.isin("team", "impressum"), "f2").when(word == "our-story", "f3").otherwise("")
    return PS.shell_aliases(page_list(spark, d).withColumn("fingerprint", shell), homes(spark, d, "team"))


@query(f"WITH {SQL_ALIASES} SELECT * FROM aliases")
def shell_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark, d)


@query(f"""WITH {SQL_ALIASES}, c AS (SELECT l.site, l.pos, coalesce(a.canonical, l.url) AS url FROM list l LEFT JOIN aliases a ON a.site = l.site AND a.url = l.url),
f AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY pos) AS r FROM c) SELECT site, {numbered('pos, url')} AS pos, url FROM f WHERE r = 1""")
def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    return PS.canonicalize(page_list(spark, d), _aliases(spark, d))


@query(f"""WITH {SQL_LIST}, c AS (SELECT DISTINCT site, url, word FROM list),
r AS (SELECT l.site, count(*) AS rep_pages, bool_or(l.word IN ('our-story', 'team', 'impressum')) AS confident FROM list l WHERE n <= 4 GROUP BY 1),
e AS (SELECT site, count(DISTINCT word) AS families FROM list WHERE n > 2 GROUP BY 1)
SELECT s.site, coalesce(rep_pages, 0) AS rep_pages, coalesce(families, 0) AS families, coalesce(confident, false) AS confident, coalesce(rep_pages, 0) >= 3 AND coalesce(families, 0) >= 6 AND coalesce(confident, false) AS enough
FROM (SELECT DISTINCT site FROM c) s LEFT JOIN r ON r.site = s.site LEFT JOIN e ON e.site = s.site""")
def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = page_list(spark, d)
    candidates = rows.select("site", "url", F.col("word").alias("family_key"), (F.col("word") == "our-story").alias("is_person"), F.array("word").alias("tokens")).dropDuplicates(["site", "url"])
    return PS.coverage(candidates, rows.where("n <= 4"), rows.where("n > 2"), PS.STRONG_WORDS, 3)


@query(f"""WITH {SQL_LIST}, k AS (SELECT site, arg_max(url, pos) AS found FROM list WHERE n <= 4 AND word = 'about' GROUP BY 1), s AS (SELECT DISTINCT site FROM list WHERE n <= 4)
SELECT o_orderkey AS site, CASE WHEN s.site IS NULL THEN '' ELSE o_orderstatus END AS company_name, CASE WHEN found IS NULL OR o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS representative,
coalesce(found, '') AS evidence_url, CASE WHEN found IS NULL OR o_orderkey % 3 = 0 THEN '' ELSE 'quote' END AS evidence_quote FROM orders LEFT JOIN k ON k.site = o_orderkey LEFT JOIN s ON s.site = o_orderkey""")
def checked_evidence(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    answers = orders.select(F.col("o_orderkey").alias("site"), F.col("o_orderstatus").alias("company_name"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" "), "o_orderpriority")).alias("representative"),
                            F.concat(F.expr(HOME.replace("varchar", "string")), F.lit("about/")).alias("evidence_url"), F.lit(" quote").alias("evidence_quote"))
    return PS.checked_evidence(answers, page_list(spark, d).where("n <= 4").withColumn("seq", F.col("pos")))


FEEDBACK_SQL = f"""{SQL_LIST}, w AS (SELECT o_orderkey AS site, 'representative' AS kind, {HOME} || 'team' AS url FROM orders WHERE o_orderkey % 3 <> 0
UNION SELECT site, 'email', url FROM list WHERE n >= 3 AND site IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)),
led AS (SELECT DISTINCT l.site, w.kind, l.word FROM list l JOIN w ON w.site = l.site AND w.url = l.url WHERE l.n <= 5),
words AS (SELECT site, kind, CASE WHEN word = 'our-story' THEN 'story' ELSE word END AS feature FROM led UNION ALL SELECT site, kind, 'family:' || replace(word, 'our-story', 'story') FROM led)"""


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    rows, orders = page_list(spark, d), table(spark, d, "orders")
    results = orders.select(F.col("o_orderkey").alias("site"), F.when(F.col("o_orderkey") % 3 != 0, "name").alias("representative"), F.concat(F.expr(HOME.replace("varchar", "string")), F.lit("team")).alias("evidence_url"), F.when(F.col("o_orderkey") % 2 == 0, "a@b.com").alias("emails"))
    fetched = rows.where("n <= 5").select("site", F.explode(F.array(F.lit("representative"), F.lit("email"))).alias("kind"), "url")
    return PS.feedback(results, rows.where("n >= 3"), fetched)


@query(f"WITH {FEEDBACK_SQL} SELECT * FROM words")
def learning_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d)


@query(f"WITH {FEEDBACK_SQL} SELECT kind, feature, cast(least(3 * count(*), 60) AS integer) AS score FROM words GROUP BY 1, 2")
def learned_from_feedback(spark: SparkSession, d: str) -> DataFrame:
    return state.fold_scores(_feedback(spark, d).select("kind", "feature", F.col("site").alias("seq"), F.lit(3).alias("delta")))


@query("SELECT c_custkey AS site, c_custkey % 4 > 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 < 2) AS wanted FROM customer")
def overflow_wanted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("site"), PS.wants_overflow(F.when(k % 3 != 0, "name"), k % 5, k % 4).alias("wanted"))


# ---- texts ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, cast(" + " + ".join([f"CASE WHEN contains(lower(coalesce(text, '')), '{h}') THEN 2 ELSE 0 END" for h in PT.HINTS]) + " + 6 * (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS integer) AS priority FROM documents")
def text_priority(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("doc_id") % 2 == 0, "https://a.com/Team").otherwise("https://a.com/x")
    return table(spark, d, "documents").select("doc_id", PT.page_priority(url, F.col("text")).cast("int").alias("priority"))


def prioritized_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", PT.prioritized(F.col("text")).alias("content"), PT.abbreviated(F.col("text")).alias("short"))


def budgeted_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("site"), (F.col("doc_id") % 5).alias("pos"), F.concat(F.lit("https://a.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"))
    return PT.prepared(pages, 6000)


query()(prioritized_texts)
query()(budgeted_pages)

NAMES = ("Mr. Kim  Vale", "CEO", "Sales Team", "Madam Ada Stone", " dr Lee", "Mx. Rio", "Co-Founder", "Jean-Luc Roy", "", "Prof. Ash Hill")
NAME_CASE = "CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"


@query(f"""WITH n AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(trim({NAME_CASE}), '^(mr|mrs|ms|miss|dr|sir|madam|mx)\\.?\\s+', '', 'i'), '\\s+', ' ', 'g')) AS name FROM customer),
b AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS bare FROM n)
SELECT c_custkey, CASE WHEN bare = '' OR bare IN ({values(T.NO_NAMES)}) THEN '' ELSE name END AS name, CASE WHEN bare = '' OR bare IN ({values(T.NO_NAMES)}) THEN false ELSE contains(name, 'Kim') OR contains(name, 'Lee') END AS quoted FROM b""")
def representative_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", T.representative_name(F.expr(NAME_CASE)).alias("name"))
    return rows.select("c_custkey", "name", T.quote_has_name(F.lit("Our leader is kim, and LEE helps"), F.col("name")).alias("quoted"))


LINES = ("Call +44 20 7946 0018 now", "Ada Stone, Managing Director", "Ada Stone", "info@firm.com", "https://firm.com/ada", "function(x) { return 1 }", "ab", "Firm GmbH Impressum", "mailto:ada@firm.com today", "Geschäftsführer Jürgen Maß")
LINE_CASE = "CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(LINES)) + " END"


@query(f"""WITH l AS (SELECT c_custkey, {LINE_CASE} AS x FROM customer), p AS (SELECT *, lower(strip_accents(x)) AS y FROM l)
SELECT c_custkey, cast(CASE WHEN length(x) < 3 OR length(x) > 180 OR regexp_matches(x, '^https?://') OR contains(x, '{{') THEN 0 ELSE
CASE WHEN regexp_matches(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN 90 ELSE 0 END + CASE WHEN regexp_matches(x, '\\+?[0-9][0-9()./\\-\\s]{{5,}}[0-9]') THEN 36 ELSE 0 END
+ CASE WHEN regexp_matches(y, '{"|".join(SH.ROLES)}') THEN 48 ELSE 0 END + CASE WHEN regexp_matches(' ' || y || ' ', '{"|".join(SH.COMPANIES)}') THEN 38 ELSE 0 END
+ CASE WHEN regexp_matches(x, '^[A-Z][A-Za-z.-]+( [A-Z][A-Za-z.-]+){{1,3}}$') THEN 58 ELSE 0 END + CASE WHEN contains(y, 'mailto:') THEN 12 ELSE 0 END
+ CASE WHEN regexp_matches(x, '[A-Za-z].*[A-Za-z]') AND contains(x, ' ') THEN 4 ELSE 0 END END AS integer) AS score FROM p""")
def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", SH.signal_score(F.expr(LINE_CASE)).cast("int").alias("score"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    html = F.regexp_extract("html", r"(?is)<title\b[^>]*>.*?</title>", 0)
    return table(spark, d, "pages").select("page_id", F.coalesce(F.get(SH.head_lines(html), F.lit(0)), F.lit("")).alias("title"))


# ---- state ------------------------------------------------------------------------------------------------------------

ERROR_SQL = "CASE c_custkey % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 403 ELSE 200 END"


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'invalid_key' WHEN 1 THEN 'access_restricted' WHEN 2 THEN 'quota_exhausted' WHEN 3 THEN 'temporary_unavailable' WHEN 4 THEN 'temporary_unavailable' WHEN 5 THEN 'request_rejected' ELSE '' END AS category, CASE c_custkey % 7 WHEN 0 THEN 'new_key' WHEN 1 THEN 'new_key' WHEN 2 THEN 'new_key' WHEN 6 THEN '' ELSE 'retry' END AS prompt FROM customer")
def model_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    code = F.when(k == 1, "ip_not_allowed").when(k == 2, "insufficient_quota")
    category = T.model_error(F.expr(ERROR_SQL), code, F.lit(None).cast("string"), F.lit("no text"))
    return table(spark, d, "customer").select("c_custkey", category.alias("category")).select("c_custkey", "category", T.prompt_mode(F.col("category")).alias("prompt"))


@query("""WITH s AS (SELECT c_name AS site, c_custkey AS input_index, CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed_temp' WHEN 3 THEN 'done' ELSE 'dropped' END AS status FROM customer),
t AS (SELECT site FROM s WHERE status IN ('pending', 'failed_temp') ORDER BY CASE status WHEN 'pending' THEN 0 ELSE 1 END, input_index LIMIT 400)
SELECT site, input_index, CASE WHEN site IN (SELECT site FROM t) THEN 'running' ELSE status END AS status FROM s""")
def claimed_sites(spark: SparkSession, d: str) -> DataFrame:
    return state.claim(sites_table(spark, d), 400)


@query("SELECT c_name AS site, c_custkey AS input_index, CASE WHEN c_custkey % 5 = 1 THEN 'pending' WHEN c_custkey % 5 = 0 THEN 'pending' WHEN c_custkey % 5 = 2 THEN 'failed_temp' WHEN c_custkey % 5 = 3 THEN 'done' ELSE 'dropped' END AS status FROM customer")
def reset_sites(spark: SparkSession, d: str) -> DataFrame:
    return state.reset(sites_table(spark, d)).select("site", "input_index", "status")


# ---- probes, people, responses -----------------------------------------------------------------------------------------

START = "CASE WHEN site % 7 = 0 THEN 'https://other.com/' ELSE 'https://shop.firm' || cast(site % 50 AS varchar) || '.com/' END"


@query(f"""WITH {SQL_LIST}, f AS (SELECT site, url, min(pos) AS pos FROM list WHERE word IN ('about', 'contact', 'team') AND site % 7 <> 0 GROUP BY site, url),
g AS (SELECT site, {numbered('pos, url')} AS pos, url FROM f) SELECT * FROM g WHERE pos < 4""")
def subdomain_probes(spark: SparkSession, d: str) -> DataFrame:
    return links.subdomain_probes(page_list(spark, d).withColumn("start", F.expr(START.replace("varchar", "string"))))


HITS = "CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 0 ELSE (l_partkey + l_linenumber) % 4 END"


@query(f"""WITH a AS (SELECT l_orderkey AS site, l_linenumber AS batch, sum({HITS}) AS hits FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY batch) AS n FROM a),
c AS (SELECT *, sum(hits) OVER w AS found, coalesce(max(CASE WHEN hits > 0 THEN n END) OVER w, 0) AS last FROM b WINDOW w AS (PARTITION BY site ORDER BY n)),
e AS (SELECT site, min(n) AS stop FROM c WHERE found >= 8 OR n - last >= 2 OR (n >= 2 AND found < 2) GROUP BY site)
SELECT site, cast(batch AS integer) AS batch, cast(hits AS bigint) AS hits FROM b LEFT JOIN e USING (site) WHERE stop IS NULL OR n <= stop""")
def probe_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").cast("int").alias("batch"), F.expr(HITS).cast("long").alias("hits"))
    return state.probe_batches(rows)


TITLES = ("Chief Executive Officer", "Managing Director", "Founder and Owner", "Clerk", "Non-Executive Chairman", "", "Director")
TITLE_CASE = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(TITLES)) + " END"
SQL_WORTH = " + ".join(f"CASE WHEN contains(low, '{p}') THEN {v} ELSE 0 END" for p, v in SC.TITLE_PHRASES.items())


@query(f"""WITH p AS (SELECT c_nationkey AS site, c_custkey AS pos, c_name AS name, lower({TITLE_CASE} || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'Leadership Board' ELSE '' END) AS low FROM customer),
s AS (SELECT *, cast({SQL_WORTH} AS integer) AS score FROM p), r AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY score DESC, lower(name), pos) AS place, name, score FROM s)
SELECT * FROM r WHERE place <= 40""")
def ranked_biographies(spark: SparkSession, d: str) -> DataFrame:
    departments = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Leadership"), F.lit("Board")))
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.expr(TITLE_CASE).alias("title"), departments.alias("departments"))
    return contacts.ranked_biographies(people).withColumn("score", F.col("score").cast("int"))


TYPES = ("text/html; charset=utf-8", "", "application/pdf", "application/xhtml+xml", "image/png")
TYPE_CASE = "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(TYPES)) + " END"
ASSET = "'HTTPS://Cdn.Firm' || cast(c_custkey % 50 AS varchar) || '.com/Static/' || cast(c_custkey % 9 AS varchar) || CASE WHEN c_custkey % 3 = 0 THEN '.pdf' ELSE '.html?v=' || cast(c_custkey AS varchar) END"


@query(f"""SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 IN (0, 1, 3) AS supported,
'cdn.firm' || cast(c_custkey % 50 AS varchar) || '.com/Static/' || cast(c_custkey % 9 AS varchar) || CASE WHEN c_custkey % 3 = 0 THEN '.pdf' ELSE '.html' END AS asset FROM customer""")
def responses(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr(ASSET.replace("varchar", "string"))
    return table(spark, d, "customer").select("c_custkey", U.is_supported_response(url, F.expr(TYPE_CASE)).alias("supported"), U.asset_key(url).alias("asset"))


@query(f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '第3列' ELSE 'Website' END AS header, c_custkey % 3 AS chosen, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 END AS voted, CASE WHEN c_custkey % 7 < 4 THEN ' most sites ' ELSE '' END AS reason FROM customer)
SELECT c_custkey, CASE WHEN voted = chosen AND reason <> '' THEN 'most sites' WHEN voted <> chosen THEN '{importing.REASONS["overruled"]}' WHEN starts_with(header, '第') THEN '{importing.REASONS["unnamed"]}' ELSE '{importing.REASONS["named"]}' END AS reason FROM r""")
def selection_reasons(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    header, voted, reason = F.when(key % 2 == 0, "第3列").otherwise("Website"), F.when(key % 4 != 0, key % 5), F.when(key % 7 < 4, " most sites ").otherwise("")
    return table(spark, d, "customer").select("c_custkey", importing.selection_reason(header, key % 3, voted, reason).alias("reason"))


@query(PROFILE + """ SELECT sheet, cast(col_idx AS integer) AS col_idx, cast(to_json({'index': cast(col_idx AS integer), 'header': header, 'samples': list_filter(string_split(samples, '|'), lambda x: x <> ''), 'non_empty_count': non_empty, 'website_count': websites,
'homepage_count': homepages, 'social_count': socials, 'email_count': emails, 'note_count': notes, 'local_score': round(local_score, 2)}) AS varchar) AS payload FROM f""")
def picker_payloads(spark: SparkSession, d: str) -> DataFrame:
    return importing.picker_payload(importing.profile(sheet(spark, d)))
