"""Registered queries over the driver's tables, one for each family of operators, with DuckDB SQL where SQL can say it.

Inputs that the tables lack (site lists, mail snippets, error logs) are derived from their keys in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions import phones as P
from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import candidates, contacts, importing, links, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in dict.fromkeys(names))


# ---- websites -------------------------------------------------------------------------------------------------

RAW = "CASE c_custkey % 8 WHEN 0 THEN 'www.' || n || '.co.uk' WHEN 1 THEN 'https://www.' || n || '.co.uk/' WHEN 2 THEN 'http://' || n || '.de/About?x=1' WHEN 3 THEN 'hello@' || n || '.com' WHEN 4 THEN 'not a site' WHEN 5 THEN 'localhost' WHEN 6 THEN 'HTTPS://Shop.' || n || '.com.au/a/b/#top' ELSE n || '.org' END"
NAME = "'firm' || cast(c_custkey % 400 AS varchar)"
SQL_LIST = f"""rawlist AS (SELECT c_custkey AS id, {RAW} AS raw FROM (SELECT c_custkey, {NAME} AS n FROM customer)),
split AS (SELECT id, raw, CASE WHEN contains(raw, '://') THEN raw ELSE 'https://' || raw END AS f FROM rawlist),
parts AS (SELECT id, raw, lower(regexp_extract(f, '^([A-Za-z]+):', 1)) AS sch, lower(regexp_extract(f, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(f, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM split),
norm AS (SELECT id, raw, CASE WHEN (NOT contains(raw, ' ') AND contains(raw, '@')) OR contains(host, ' ') OR NOT contains(host, '.') THEN ''
  ELSE regexp_replace(sch || '://' || regexp_replace(host, '^www\\.', '') || path, '/+$', '') END AS website FROM parts),
keyed AS (SELECT *, CASE WHEN website = '' THEN '' WHEN regexp_extract(website, '^[a-z]+://[^/]*(.*)$', 1) NOT IN ('', '/') THEN lower(website) ELSE lower(regexp_extract(website, '^[a-z]+://([^/]*)', 1)) END AS dedupe_key FROM norm)"""


def site_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.expr(NAME.replace("varchar", "string")).alias("n"))
    return rows.select(F.col("c_custkey").alias("input_index"), F.expr(RAW).alias("raw"))


@query(f"WITH {SQL_LIST} SELECT id AS input_index, raw, website, dedupe_key FROM keyed")
def site_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = site_list(spark, d).withColumn("website", U.normalize_website("raw"))
    return rows.withColumn("dedupe_key", F.when(F.col("website") == "", "").otherwise(U.dedupe_key("website")))


@query(f"""WITH {SQL_LIST} SELECT cast(id AS integer) AS input_index, raw AS raw_website, website, dedupe_key FROM
(SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY id) AS k FROM keyed WHERE website <> '') WHERE k = 1""")
def site_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return importing.dedupe(site_list(spark, d))


DOMAIN = "CASE WHEN len(string_split(h, '.')) >= 3 AND regexp_extract(h, '[^.]+\\.[^.]+$') IN (" + values(U.TWO_LABEL_SUFFIXES) + ") THEN regexp_extract(h, '[^.]+\\.[^.]+\\.[^.]+$') ELSE regexp_extract(h, '[^.]+\\.[^.]+$') END"


@query(f"""WITH p AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages)
SELECT {DOMAIN} AS domain, count(*) AS pages, count(DISTINCT h) AS hosts FROM p GROUP BY 1""")
def domain_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(U.registrable_domain("url").alias("domain"), F.regexp_replace(F.lower(U.netloc("url")), r"^www\.", "").alias("h"))
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("h").alias("hosts"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid','gclid','mc_cid','mc_eid','msclkid','ref_src','srsltid'], lower(string_split(x, '=')[1]))) AS kept FROM p)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url,
regexp_replace(lower(regexp_extract(base, '^([a-z]+)://', 1)), '$', '') || '://' || regexp_replace(lower(regexp_extract(base, '^[a-z]+://([^/]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(base, '^[a-z]+://[^/]*(.*)$', 1), '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical,
regexp_extract(lower(regexp_extract(base, '^[a-z]+://[^/]*(.*)$', 1)), '^/*([a-z]{2}(?:-[a-z]{2})?)(?:/|$)', 1) AS locale FROM k""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.normalize_discovery("url").alias("url"), U.canonical("url").alias("canonical"), U.locale("url").alias("locale"))


LINKS = """WITH a AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS org, regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)["'']', 1) AS l FROM pages),
b AS (SELECT page_id, url, org, unnest(l) AS href, generate_subscripts(l, 1) AS pos FROM a),
c AS (SELECT page_id, url, pos, org || trim(href) AS link FROM b WHERE starts_with(trim(href), '/') AND NOT starts_with(trim(href), '//') AND NOT contains(href, '?') AND NOT contains(href, '#')),
e AS (SELECT page_id, url, link, min(pos) AS pos FROM c WHERE NOT regexp_matches(lower(link), '[{}]') GROUP BY page_id, url, link)"""


@query(LINKS + " SELECT url, cast(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS integer) AS pos, link FROM e QUALIFY pos <= 80")
def same_site_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return links.same_site(pages, keys=("page_id",)).drop("page_id")  # a url that was fetched again has the links of each fetch


# ---- candidates -------------------------------------------------------------------------------------------------

EXTRA = ("/financial/advisers/about-us", "/news/leadership-update", "/team_members/kim-vale", "/team_members/lee-moor", "/forums/sponsored_discussions/ask", "/directory/contacts", "/contactus", "/services/help", "/a/b/c/d/e/f/g/h", "/jobs/driver")


def discovered(spark: SparkSession, d: str) -> DataFrame:
    """(site, start_url, pos, url): well-known and other paths under each page host."""
    hosts = table(spark, d, "pages").select(F.lower(U.netloc("url")).alias("site")).distinct()
    paths = F.array(*[F.lit(p) for p in (*U.PROBE_PATHS, *EXTRA)])
    rows = hosts.select("site", F.concat(F.lit("https://"), "site").alias("start_url"), F.posexplode(paths).alias("pos", "path"))
    return rows.select("site", "start_url", "pos", F.concat("start_url", "path").alias("url"))


def _map(weights: dict[str, int]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in weights.items()) + "}"


def _phrases(column: str, phrases) -> str:
    return " + ".join(f"CASE WHEN contains({column}, '{p}') THEN {v} ELSE 0 END" for p, v in phrases)


def _any(tokens: str, names) -> str:
    return f"list_has_any({tokens}, [{values(names)}])"


_EXPAND = "CASE " + " ".join(f"WHEN t = '{k}' THEN [{values(v)}]" for k, v in U.COMPOUNDS.items()) + " ELSE [t] END"
CANDIDATES = f"""WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site FROM pages),
paths AS (SELECT unnest([{values((*U.PROBE_PATHS, *EXTRA))}]) AS path, generate_subscripts([{values((*U.PROBE_PATHS, *EXTRA))}], 1) AS o),
urls AS (SELECT site, 'https://' || site AS start_url, path, o FROM hosts, paths UNION ALL SELECT site, 'https://' || site, '', 0 FROM hosts),
tok AS (SELECT *, start_url || path AS url, list_filter(flatten(list_transform(string_split_regex(regexp_replace(path, '\\.[a-z0-9]{{2,5}}$', ''), '[^a-z0-9]+'), lambda t: {_EXPAND})), lambda t: len(t) >= 3) AS raw FROM urls),
tok2 AS (SELECT *, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS p, len(path) - len(replace(path, '/', '')) AS depth FROM tok),
fam AS (SELECT *, CASE WHEN len(list_filter(p, lambda t: NOT list_contains([{values(U.FAMILY_SKIP)}], t))) = 0 THEN [] ELSE list_slice(p, list_position(p, list_filter(p, lambda t: NOT list_contains([{values(U.FAMILY_SKIP)}], t))[1]), len(p)) END AS tr FROM tok2),
per AS (SELECT *, CASE WHEN len(tr) = 0 THEN 'root' ELSE array_to_string(list_slice(tr, 1, 2), '/') END AS family_key, list_filter(tr, lambda t: NOT list_contains([{values((*U.PERSON_NO_NAME, *U.NEGATIVE))}], t)) AS names FROM fam),
per2 AS (SELECT *, len(p) BETWEEN 3 AND 6 AND {_any('tr', U.PERSON_CONTEXT)} AND len(names) BETWEEN 2 AND 3 AND len(tr) BETWEEN 3 AND 6 AS is_person, len(list_filter(p, lambda t: list_contains([{values(U.NEGATIVE)}], t))) AS bad FROM per),
sc AS (SELECT *, list_sum(list_transform(p, lambda t: coalesce({_map(S.REPRESENTATIVE)}[t], 0))) AS rw, list_sum(list_transform(p, lambda t: coalesce({_map(S.EMAIL)}[t], 0))) AS ew FROM per2),
sc2 AS (SELECT *, coalesce(rw, 0) - 6 * bad + {_phrases('url', S.PHRASES + S.REPRESENTATIVE_PHRASES)} + CASE WHEN o = 0 THEN 30 ELSE 0 END + CASE WHEN is_person THEN 12 ELSE 0 END AS rr,
 coalesce(ew, 0) - 6 * bad + {_phrases('url', S.PHRASES + S.EMAIL_PHRASES)} + CASE WHEN o = 0 THEN 20 ELSE 0 END AS er, {_any('p', S.STRONG)} AS strong FROM sc),
cand AS (SELECT site, start_url, url, cast(o AS integer) AS discovery_order, cast(depth AS integer) AS depth, family_key, is_person,
 cast(CASE WHEN {_any('p', S.NOISE)} THEN 18 ELSE 0 END + CASE WHEN NOT strong AND len(p) >= 6 THEN 18 WHEN NOT strong AND len(p) >= 4 THEN 10 ELSE 0 END + CASE WHEN NOT strong AND depth >= 2 THEN 6 ELSE 0 END + CASE WHEN NOT strong AND rr <= 0 THEN 10 ELSE 0 END AS integer) AS rep_noise,
 cast(rr - least(depth, 6) AS integer) AS rep_rule, cast(er - least(depth, 6) AS integer) AS email_rule, -6 * bad AS learn FROM sc2),
fin AS (SELECT *, cast(rep_rule + least(learn, 10) + CASE WHEN is_person THEN 8 ELSE 0 END - rep_noise AS integer) AS rep_final, cast(email_rule + learn AS integer) AS email_final FROM cand)"""
SCORED = ["site", "url", "discovery_order", "depth", "family_key", "is_person", "rep_noise", "rep_rule", "email_rule", "rep_final", "email_final"]


@query(CANDIDATES + " SELECT " + ", ".join(SCORED) + " FROM fin")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return candidates.build(discovered(spark, d)).select(*SCORED[:-5], *[F.col(c).cast("int").alias(c) for c in SCORED[-5:]])


REP = """, r1 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rep_final DESC, depth, discovery_order, url) AS rank FROM fin),
r2 AS (SELECT *, row_number() OVER (PARTITION BY site, is_person, family_key ORDER BY rank) AS k FROM r1 WHERE rep_final > 0 OR rank = 1),
rep AS (SELECT site, start_url, url, row_number() OVER (PARTITION BY site ORDER BY rank) AS pos FROM r2 WHERE k = 1 QUALIFY pos <= 5)"""
MAIL = """, e1 AS (SELECT *, email_final >= 12 AS strong_mail, row_number() OVER (PARTITION BY site, family_key ORDER BY email_final DESC, depth, url) AS k FROM fin WHERE email_final > 0),
e2 AS (SELECT e1.*, n FROM e1 JOIN (SELECT site, count(DISTINCT family_key) FILTER (WHERE strong_mail) AS n FROM e1 GROUP BY site) USING (site)),
mail AS (SELECT site, start_url, url, row_number() OVER (PARTITION BY site ORDER BY email_final DESC, depth, url) AS pos FROM e2 WHERE (k = 1 OR (strong_mail AND k <= 2)) AND NOT (email_final < 8 AND n >= 6) QUALIFY pos <= 32)"""


@query(CANDIDATES + REP + """, t AS (SELECT r1.site, r1.url, row_number() OVER (PARTITION BY r1.site ORDER BY rank) AS pos FROM r1 ANTI JOIN rep USING (site, url) WHERE (is_person OR rep_noise < 18) QUALIFY pos <= 40)
SELECT site, url, 'representative' AS role, cast(pos AS integer) AS pos FROM rep UNION ALL SELECT site, url, 'teacher', cast(pos AS integer) FROM t""")
def representative_pages(spark: SparkSession, d: str) -> DataFrame:
    return candidates.representative_pages(candidates.build(discovered(spark, d)))


@query(CANDIDATES + MAIL + " SELECT site, url, cast(pos AS integer) AS pos FROM mail")
def email_pages(spark: SparkSession, d: str) -> DataFrame:
    return candidates.email_pages(candidates.build(discovered(spark, d)))


@query(CANDIDATES + REP + MAIL + """, h AS (SELECT site, start_url, count(*) AS n, max(CASE WHEN url = start_url THEN 1 ELSE 0 END) AS has FROM rep GROUP BY site, start_url),
re AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN url = start_url THEN 0 ELSE 1 END, pos) AS pos FROM rep),
m AS (SELECT mail.site, mail.url, row_number() OVER (PARTITION BY mail.site ORDER BY mail.pos) AS pos, 20 - h.n - (1 - has) AS room FROM mail JOIN h USING (site) LEFT JOIN rep ON rep.site = mail.site AND rep.url = mail.url WHERE rep.url IS NULL AND mail.url <> mail.start_url)
SELECT site, 'rep' AS role, cast(pos AS integer) AS pos, url FROM re
UNION ALL SELECT site, 'homepage', 1, start_url FROM h WHERE has = 0
UNION ALL SELECT site, CASE WHEN pos <= least(8, room) THEN 'email_primary' ELSE 'email_overflow' END, cast(CASE WHEN pos <= least(8, room) THEN pos ELSE pos - least(8, room) END AS integer), url FROM m WHERE pos <= least(16, room)""")
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    found = discovered(spark, d)
    rows = candidates.build(found)
    rep = candidates.representative_pages(rows).where("role = 'representative'")
    return candidates.fetch_plan(found.select("site", "start_url").distinct(), rep, candidates.email_pages(rows))


@query()
def discovery_priority(spark: SparkSession, d: str) -> DataFrame:
    return candidates.discover(discovered(spark, d), 20)


# ---- sheets -------------------------------------------------------------------------------------------------------

CELLS = (NAME, f"'https://linkedin.com/company/' || {NAME}", f"'info@' || {NAME} || '.co.uk'", f"CASE c_custkey % 3 WHEN 0 THEN {NAME} || '.co.uk' WHEN 1 THEN 'https://' || {NAME} || '.de' ELSE 'https://' || {NAME} || '.com/en' END", "'called them on a day in spring'")
TITLES = ("Firm", "LinkedIn URL", "Email", "Company Website", "Remarks")


def sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 200).cast("string").alias("sheet"), (F.col("c_custkey") % 200 + 1).cast("int").alias("row_idx"), F.array(*[F.expr(c.replace("varchar", "string")) for c in CELLS]).alias("cells"))
    return rows.unionByName(rows.select("sheet").distinct().select("sheet", F.lit(0).alias("row_idx"), F.array(*[F.lit(t) for t in TITLES]).alias("cells")))


PROFILE = f"""WITH c AS (SELECT cast(c_custkey // 200 AS varchar) AS sheet, c_custkey % 200 + 1 AS row_idx, unnest([{', '.join(CELLS)}]) AS cell, unnest([0, 1, 2, 3, 4]) AS col_idx FROM customer),
k AS (SELECT *, CASE WHEN contains(cell, '@') THEN 'email' WHEN contains(cell, 'linkedin.com') THEN 'social' WHEN contains(cell, '.') THEN 'website' WHEN len(cell) >= 24 AND contains(cell, ' ') THEN 'note' ELSE 'other' END AS kind FROM c WHERE row_idx <= 120),
s AS (SELECT sheet, col_idx, ['{"', '".join(TITLES)}'][col_idx + 1] AS header, count(*) AS non_empty, count(*) FILTER (WHERE kind = 'website') AS websites, count(*) FILTER (WHERE kind = 'website' AND NOT contains(cell, '/en')) AS homepages,
 count(*) FILTER (WHERE kind = 'social') AS socials, count(*) FILTER (WHERE kind = 'email') AS emails, count(*) FILTER (WHERE kind = 'note') AS notes, array_to_string(list_slice(list(cell ORDER BY row_idx), 1, 5), '|') AS samples FROM k GROUP BY 1, 2),
f AS (SELECT *, cast({" + ".join(f"CASE WHEN contains(lower(header), '{h}') THEN {v} ELSE 0 END" for h, v in importing.HEADER_HINTS.items())}
 + websites * 6 + homepages * 2 - socials * 14 - emails * 16 - notes * 4 - CASE WHEN websites <= 0 THEN 40 ELSE 0 END - CASE WHEN socials > websites THEN 80 ELSE 0 END - CASE WHEN emails > websites THEN 90 ELSE 0 END + CASE WHEN websites / non_empty >= 0.6 THEN 25 ELSE 0 END AS double) AS local_score FROM s)"""
COUNTS = ("non_empty", "websites", "homepages", "socials", "emails", "notes")


@query(PROFILE + f" SELECT sheet, cast(col_idx AS integer) AS col_idx, header, {', '.join(f'cast({c} AS integer) AS {c}' for c in COUNTS)}, samples, local_score FROM f")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return importing.profile(sheet(spark, d)).select("sheet", "col_idx", "header", *COUNTS, "samples", "local_score")


@query(PROFILE + " SELECT sheet, cast(arg_min(col_idx, {'s': -local_score, 'i': col_idx}) AS integer) AS col_idx FROM f GROUP BY sheet")
def column_pick(spark: SparkSession, d: str) -> DataFrame:
    return importing.pick_column(importing.profile(sheet(spark, d)))


@query(f"""WITH r AS (SELECT cast(c_custkey // 200 AS varchar) AS sheet, c_custkey % 200 + 1 AS row_idx, {CELLS[3]} AS raw FROM customer), n AS (SELECT row_number() OVER (ORDER BY sheet, row_idx) AS k, raw FROM r),
w AS (SELECT *, CASE WHEN starts_with(raw, 'https://') THEN raw ELSE 'https://' || raw END AS website FROM n), d AS (SELECT *, CASE WHEN ends_with(website, '/en') THEN website ELSE website[9:] END AS dedupe_key FROM w)
SELECT cast(k AS integer) AS input_index, raw AS raw_website, website, dedupe_key FROM d QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY k) = 1""")
def sheet_websites(spark: SparkSession, d: str) -> DataFrame:
    return importing.load_sheet(sheet(spark, d))


@query("SELECT cast(c_custkey // 200 AS varchar) AS sheet, true AS has_header FROM customer GROUP BY 1")
def header_detect(spark: SparkSession, d: str) -> DataFrame:
    return importing.header_rows(sheet(spark, d))


# ---- contacts -----------------------------------------------------------------------------------------------------

MAILS = ("'info@firm' || s || '.co.uk'", "'Sales@mail.firm' || s || '.co.uk'", "'posted@partner.org'", "'kim.vale@partner.org'", "'noreply@firm' || s || '.co.uk'", "'logo@2x.png'", "'info@firm' || s || '.co.ukk'", "'kim@www.firm' || s || '.co.uk'", "'hire@gmail.com'", "'info@other.example.com'")
SNIPPETS = f"SELECT c_custkey % 100 AS g, c_custkey AS pos, 'https://firm' || cast(c_custkey % 100 AS varchar) || '.co.uk' AS site, [{', '.join(m.replace('s ||', 'cast(c_custkey % 100 AS varchar) ||') for m in MAILS)}][1 + (c_custkey // 100) % 10] AS raw FROM customer"


def mail_rows(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("cast(c_custkey % 100 AS string)")
    rows = table(spark, d, "customer").withColumn("s", s)
    mails = F.array(*[F.expr(m) for m in MAILS])
    return rows.select(F.concat(F.lit("https://firm"), "s", F.lit(".co.uk")).alias("site"), F.col("c_custkey").alias("pos"), F.element_at(mails, (F.floor(F.col("c_custkey") / 100) % 10 + 1).cast("int")).alias("email"))


MAIL_SQL = f"""WITH a AS ({SNIPPETS}), b AS (SELECT *, lower(raw) AS email, regexp_replace(site, 'https://', '') AS sd, split_part(lower(raw), '@', 1) AS l, split_part(lower(raw), '@', 2) AS dm FROM a),
v AS (SELECT site, sd, email, l, dm, min(pos) AS pos FROM b WHERE l NOT IN ({values(E.IGNORED_LOCALS)}) AND regexp_extract(dm, '[^.]*$') NOT IN ({values(E.BAD_TLDS)}) AND NOT contains(dm, 'example.com') GROUP BY ALL)"""


@query(MAIL_SQL + " SELECT site, email FROM v")
def email_normalize(spark: SparkSession, d: str) -> DataFrame:
    return contacts.split_emails(mail_rows(spark, d), ["site"]).select("site", "email")


@query(MAIL_SQL + """, w AS (SELECT *, NOT starts_with(dm, 'www.') AND (dm = sd OR ends_with(dm, '.' || sd)) AS same FROM v),
x AS (SELECT *, bool_or(same) OVER (PARTITION BY site) AS has, bool_or(same) OVER (PARTITION BY site, l) AS sl FROM w),
y AS (SELECT * FROM x WHERE same OR (NOT sl AND NOT starts_with(dm, 'www.') AND (dm = 'gmail.com' OR NOT (has AND l IN ('found','posted','profile','webmaster','website'))))),
z AS (SELECT *, first_value(dm) OVER (PARTITION BY site, l ORDER BY len(dm), email) AS wd, row_number() OVER (PARTITION BY site, l ORDER BY len(dm), email) AS k FROM y)
SELECT site, email, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE WHEN l IN ('info', 'sales') THEN 0 WHEN contains(l, 'hr') OR contains(l, 'pr') THEN 1 WHEN regexp_full_match(l, '[a-z]+') THEN 2 WHEN l = 'kim.vale' THEN 2 ELSE 3 END, CASE WHEN same THEN 0 ELSE 1 END, pos) AS integer) AS pos FROM z WHERE k = 1 OR NOT (starts_with(dm, wd) OR starts_with(wd, dm))""")
def email_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = mail_rows(spark, d).withColumn("site_domain", U.registrable_domain("site"))
    return contacts.filter_emails(rows, ["site"]).select("site", "email", "pos")


PHONES = ("'Phone: 0044 20 5550 ' || n", "'tel:+44-20-5550-' || n", "'mobile 1111111'", "'Call us: (030) 5555 ' || n || ' ext. 12'", "'call 2147483647'", "'phone is 20' || n || '1234567890123'")


@query(f"""WITH a AS (SELECT s_suppkey, lpad(cast(s_suppkey AS varchar), 5, '0') AS n FROM supplier), b AS (SELECT s_suppkey, [{', '.join(PHONES)}][1 + s_suppkey % 6] AS raw, n FROM a)
SELECT s_suppkey, raw, CASE s_suppkey % 6 WHEN 0 THEN '+44205550' || n WHEN 1 THEN '+44205550' || n WHEN 3 THEN '0305555' || n ELSE '' END AS phone FROM b""")
def phone_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("n"))
    rows = rows.select("s_suppkey", F.element_at(F.array(*[F.expr(p) for p in PHONES]), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("raw"))
    number = F.regexp_replace("raw", r"(?i)^(?:phone|mobile|call us|call)\b\s*(?:[:=]|is)?\s*", "")
    return rows.select("s_suppkey", "raw", P.normalized(number).alias("phone"))


def contact_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of hosts, with a footer of invented contacts, so that all rules have work."""
    host = F.lower(U.netloc("url"))
    name = F.translate(F.regexp_extract(host, r"([^.]+)\.[^.]+\.[^.]+$", 1), "0123456789", "abcdefghij")
    site = F.concat(F.lit("https://"), name, F.element_at(F.split(F.lit(".co.uk;.de;.org"), ";"), (F.abs(F.hash(host)) % 3 + 1).cast("int")))
    foot = F.concat(F.lit("<footer>Phone: +44 20 5550 "), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit(" &middot; info[at]"), F.regexp_replace(site, "https://", ""), F.lit(" kim@partner.org</footer>"))
    return table(spark, d, "pages").select(site.alias("site"), F.col("page_id").alias("page_pos"), "url", F.concat("html", foot).alias("html"))


@query()
def page_emails(spark: SparkSession, d: str) -> DataFrame:
    return contacts.page_emails(contact_pages(spark, d)).select("site", "page_pos", "pos", "email")


@query()
def page_phones(spark: SparkSession, d: str) -> DataFrame:
    return contacts.page_phones(contact_pages(spark, d)).select("site", "page_pos", "pos", "phone")


@query()
def company_names(spark: SparkSession, d: str) -> DataFrame:
    return contacts.company_names(contacts.company_candidates(contact_pages(spark, d)))


@query()
def site_contacts(spark: SparkSession, d: str) -> DataFrame:
    pages = contact_pages(spark, d)
    sites = pages.groupBy("site").agg(F.min("page_pos").alias("input_index"))
    return contacts.contacts(sites, pages)


# ---- state and learning -----------------------------------------------------------------------------------------------

def _error_sql() -> str:
    return "CASE CASE WHEN value < 20 THEN 0 WHEN value < 40 THEN 1 WHEN value < 60 THEN 2 ELSE 3 END WHEN 0 THEN 'read timeout' WHEN 1 THEN 'llm_queue_timeout' WHEN 2 THEN 'http_403 forbidden' END"


def error_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("site"), (F.col("event_id") % 2000).cast("string")).alias("site"), F.col("event_id").alias("attempt"), F.expr(_error_sql()).alias("error"))


@query(f"""WITH a AS (SELECT 'site' || cast(event_id % 2000 AS varchar) AS site, event_id, {_error_sql()} AS error FROM events),
l AS (SELECT site, list_prepend({{'st': 'pending', 'r': 0, 'e': '', 'x': false, 'b': 0}}, list({{'st': '', 'r': 0, 'e': coalesce(error, ''), 'x': error IS NULL, 'b': CASE WHEN contains(error, 'llm_queue') THEN 2 WHEN contains(error, 'http_403') THEN -1 ELSE 1 END}} ORDER BY event_id)) AS s FROM a GROUP BY site),
f AS (SELECT site, list_reduce(s, lambda acc, y: CASE WHEN acc.st IN ('done', 'dropped') THEN acc WHEN y.x THEN {{'st': 'done', 'r': acc.r, 'e': '', 'x': false, 'b': 0}} WHEN acc.r >= y.b THEN {{'st': 'dropped', 'r': CASE WHEN y.b < 0 THEN acc.r ELSE acc.r + 1 END, 'e': y.e, 'x': false, 'b': 0}} ELSE {{'st': 'failed_temp', 'r': acc.r + 1, 'e': y.e, 'x': false, 'b': 0}} END) AS z FROM l)
SELECT site, z.st AS status, cast(z.r AS integer) AS retry_count, z.e AS last_error FROM f""")
def retry_machine(spark: SparkSession, d: str) -> DataFrame:
    return state.outcomes(error_log(spark, d))


def learning_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "representative").otherwise("email")
    return rows.select(kind.alias("kind"), F.concat(F.lit("word"), (F.col("user_id") % 97).cast("string")).alias("feature"), F.col("event_id").alias("seq"), F.when(F.col("value") < 60, 3).otherwise(-1).alias("delta"))


@query("""WITH a AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'representative' ELSE 'email' END AS kind, 'word' || cast(user_id % 97 AS varchar) AS feature, event_id, CASE WHEN value < 60 THEN 3 ELSE -1 END AS delta FROM events),
l AS (SELECT kind, feature, list(delta ORDER BY event_id) AS s FROM a GROUP BY 1, 2)
SELECT kind, feature, cast(list_reduce(s, lambda x, y: least(greatest(x + y, -12), 60)) AS integer) AS score FROM l""")
def learning_scores(spark: SparkSession, d: str) -> DataFrame:
    return state.fold_scores(learning_events(spark, d))


@query("""WITH a AS (SELECT o_orderkey, cast(o_orderkey % 70 AS integer) - 10 AS score, o_orderdate AS t FROM orders), b AS (SELECT *, floor(greatest(epoch(timestamp '1998-12-01') - epoch(t), 0) / 1209600) AS w FROM a)
SELECT o_orderkey, cast(CASE WHEN score > 0 AND w > 0 THEN greatest(score - w, 1) ELSE score END AS integer) AS score FROM b""")
def score_decay(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("score", F.expr("cast(o_orderkey % 70 AS int) - 10"))
    return rows.select("o_orderkey", state.decayed(F.col("score"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("1998-12-01 00:00:00").cast("timestamp")).alias("score"))


STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed_temp' WHEN 3 THEN 'done' ELSE 'dropped' END"


def sites_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("site"), F.col("c_custkey").alias("input_index"), F.expr(STATUS).alias("status"))


@query(f"SELECT {', '.join(f'count(*) FILTER (WHERE s = {chr(39)}{x}{chr(39)}) AS {x}' for x in ('pending', 'running', 'failed_temp', 'done', 'dropped'))}, count(*) AS total FROM (SELECT {STATUS} AS s FROM customer)")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return state.progress(sites_table(spark, d))


@query(f"SELECT c_name AS site, c_custkey AS input_index, s AS status FROM (SELECT *, {STATUS} AS s FROM customer) WHERE s IN ('pending', 'failed_temp') ORDER BY CASE WHEN s = 'pending' THEN 0 ELSE 1 END, c_custkey LIMIT 400")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    return state.claim_order(sites_table(spark, d), 400)


@query(f"SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS company_name, '' AS representative, '' AS emails, '' AS phones, c_name AS website FROM (SELECT *, {STATUS} AS s FROM customer) WHERE s IN ('done', 'dropped')")
def delivery(spark: SparkSession, d: str) -> DataFrame:
    sites = sites_table(spark, d)
    results = sites.where("input_index % 2 = 0").select("site", F.col("site").alias("company_name"), *[F.lit("").alias(c) for c in ("representative", "emails", "phones")])
    return state.delivery(sites, results)


# ---- texts ------------------------------------------------------------------------------------------------------------

SIGNS = ("<title>Just a moment...</title>", "/.well-known/sgcaptcha/?r=1", "_Incapsula_Resource", "plain page")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'cloudflare_challenge' WHEN 1 THEN 'sgcaptcha_challenge' WHEN 2 THEN 'imperva_challenge' ELSE '' END AS kind FROM pages")
def challenge_pages(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(*[F.lit(s) for s in SIGNS]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", T.challenge_kind(F.concat(sign, "html")).alias("kind"))


FAULTS = ("HTTP_404: x", "curl: (28) Operation timed out", "Connection refused", "tlsv1_alert internal", "odd thing", "")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '站点返回 HTTP 404，页面不存在' WHEN 1 THEN '请求超时' WHEN 2 THEN '站点当前明显无法连通，已直接停止重试' WHEN 3 THEN '站点 TLS 握手失败' WHEN 4 THEN 'odd thing' ELSE '未知错误' END AS reason,
event_id % 6 = 1 AS is_temporary, cast(CASE WHEN event_id % 6 = 3 THEN 2 ELSE 1 END AS integer) AS budget FROM events""")
def error_reasons(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(s) for s in FAULTS]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.error_reason(text).alias("reason"), T.is_temporary(text).alias("is_temporary"), T.retry_budget(text).alias("budget"))


@query("""WITH s AS (SELECT user_id, event_id * 10 AS lo, event_id * 10 + cast(floor(value) AS bigint) AS hi FROM events),
b AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
c AS (SELECT *, sum(CASE WHEN m IS NULL OR lo > m + 256 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi) AS n FROM b)
SELECT user_id, cast(n AS bigint) AS n, min(lo) AS lo, max(hi) AS hi FROM c WHERE n <= 8 GROUP BY 1, 2""")
def signal_windows(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "events").select("user_id", (F.col("event_id") * 10).alias("lo"), (F.col("event_id") * 10 + F.floor("value")).alias("hi"))
    return state.islands(spans, ["user_id"], 256, 8)
