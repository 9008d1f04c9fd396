"""E-mail rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .text import contains_any

ADDRESS = r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"
SCRIPTS = r"(?is)<(script|style|template)\b[^>]*>.*?</\1>"
# File endings that are no top-level domains, parts of hosts that are no mail hosts, and local parts that are no mailboxes.
BAD_TLDS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "avif", "mp4", "webm", "mov", "pdf", "js", "css", "woff", "woff2", "ttf", "eot")
BAD_HOSTS = (
    "mockconsole.prototype", "prototype.render", "prototype.read", "template.com", "template.net", "template.org", "example.com", "example.org", "example.net",
    "sample.com", "sentry.io", "sentry.wixpress.com", "sentry-next.wixpress.com", "xyz.com", "godaddy.com", "website.com", ".pb.hx",
)
IGNORED_LOCALS = ("x", "xx", "xxx", "name", "test", "example", "sample", "yourname", "youremail", "email", "noreply", "no-reply", "donotreply", "do-not-reply")
# Placeholders.
PLACEHOLDER_LOCALS = ("aaa", "aaaa", "beispiel", "dummy", "example", "hogehoge", "hoge", "name", "sample", "test", "xxx", "xxxx", "xxxxx", "yourdomain", "yourdmain")
PLACEHOLDER_DOMAINS = ("aaa", "beispiel", "dummy", "email", "example", "sample", "test", "yourdomain", "yourdmain")
PLACEHOLDER_STEMS = ("beispiel", "dummy", "email", "example", "name", "sample", "test")
ADDRESS_WORDS = ("road", "street", "lane", "avenue", "drive", "close", "court", "house", "london", "catford")
# Mailboxes of roles, free mail hosts, and mailboxes that are dropped when they are off-site.
ROLES = (
    "contact", "customer", "hello", "help", "hr", "info", "inquiry", "office", "privacy", "pr", "press", "recruit", "recruiting", "sales", "service", "support",
    "customercare", "enquiries", "enquiry",
)
FREE_MAIL = (
    "aol.com", "gmail.com", "googlemail.com", "hotmail.com", "icloud.com", "live.com", "mac.com", "me.com", "msn.com", "outlook.com", "pm.me", "proton.me",
    "protonmail.com", "yahoo.co.jp", "yahoo.com", "yahoo.com.br",
)
OFFSITE_DROPPED = ("found", "posted", "profile", "webmaster", "website")
TAIL = r"[.,);:\]}>]+$"


def clear(value: Column) -> Column:
    """[at], (at), ' at ' and the like written as @, and the same for dots."""
    at = F.regexp_replace(value, r"(?i)\[(?:at)\]|\((?:at)\)|\s+at\s+", "@")
    return F.regexp_replace(at, r"(?i)\[(?:dot)\]|\((?:dot)\)|\s+dot\s+", ".")


def find(page: Column, keep_scripts: bool = False) -> Column:
    """All addresses in decoded HTML, lower case, distinct, in order."""
    body = page if keep_scripts else F.regexp_replace(page, SCRIPTS, " ")
    body = clear(F.replace(F.replace(body, F.lit("%40"), F.lit("@")), F.lit("%2E"), F.lit(".")))
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(ADDRESS), F.lit(0)), lambda m: F.regexp_replace(F.lower(F.trim(m)), TAIL, "")))


def local(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def domain(email: Column) -> Column:
    return F.regexp_replace(email, r"^[^@]*@?", "")


def squash(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "")


def normalized(value: Column) -> Column:
    """(text, email) before the checks of `valid`."""

    def found(v: Column) -> Column:
        return F.struct(v.alias("text"), F.regexp_replace(F.trim(F.regexp_extract(v, ADDRESS, 0)), TAIL, "").alias("email"))

    plain = U.bind(value, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    v = F.lower(F.trim(F.regexp_replace(plain, "[\u200b-\u200f\ufeff\u00ad\u2060]", "")))
    v = clear(F.regexp_replace(F.replace(v, F.lit("mailto:"), F.lit("")), r"^(?:u003e|u003c|>|<)+", ""))
    return U.bind(v, found)


def valid(found: Column) -> Column:
    """Whether the email of normalized() is a mailbox."""
    dots = lambda x: F.startswith(x, F.lit(".")) | F.endswith(x, F.lit(".")) | F.contains(x, F.lit(".."))

    def test(x: Column) -> Column:
        e, a, d = x["e"], x["a"], x["d"]
        in_url = F.exists(F.split(x["t"], r"\s+"), lambda t: F.contains(t, F.lit("://")) & F.contains(t, e))
        suffix = F.regexp_extract(d, r"\.([^.]*)$", 1)
        return F.contains(e, F.lit("@")) & ~in_url & ~dots(a) & ~dots(d) & ~U.one_of(a, IGNORED_LOCALS) & ~U.one_of(suffix, BAD_TLDS) & ~contains_any(d, BAD_HOSTS)

    return U.bind(U.bind(found, lambda x: F.struct(x["text"].alias("t"), x["email"].alias("e"), local(x["email"]).alias("a"), domain(x["email"]).alias("d"))), test)


def _address_noise(value: Column) -> Column:
    separators = F.length(F.regexp_replace(value, r"[^+\-._]", ""))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.length(value) >= 36) & (((separators >= 4) & (digits >= 2)) | (contains_any(value, ADDRESS_WORDS) & (separators >= 2)))


def is_placeholder(email: Column) -> Column:
    def bad_local(x: Column) -> Column:
        a, key = x["a"], x["key"]
        stem = F.lit(False)
        for w in PLACEHOLDER_STEMS:
            stem = stem | ((F.length(key) <= len(w) + 8) & (F.startswith(key, F.lit(w)) | F.endswith(key, F.lit(w))))
        return (key == "") | _address_noise(a) | U.one_of(key, PLACEHOLDER_LOCALS) | stem | key.rlike("^a{3,}$|^0{3,}$|x{4,}|0{4,}")

    edge = "^(?:" + "|".join(PLACEHOLDER_DOMAINS) + ")|(?:" + "|".join(PLACEHOLDER_DOMAINS) + ")$"

    def bad_domain(labels: Column) -> Column:
        two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").isin(*U.TWO_LABEL_SUFFIXES)
        core = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - F.when(two, 2).otherwise(1), F.lit(0))), squash)
        return (F.size(labels) < 2) | U.bind(core, lambda c: (F.size(c) == 0) | F.exists(c, lambda x: (x == "") | x.rlike(edge)))

    def test(e: Column) -> Column:
        labels = F.filter(F.split(domain(e), r"\."), lambda x: x != "")
        named = F.struct(local(e).alias("a"), squash(local(e)).alias("key"))
        return ~F.contains(e, F.lit("@")) | U.bind(named, bad_local) | U.bind(labels, bad_domain)

    return U.bind(email, test)


def matches_site(site_domain: Column, email: Column) -> Column:
    return (site_domain != "") & F.contains(email, F.lit("@")) & U.bind(domain(email), lambda d: ~F.startswith(d, F.lit("www.")) & ((d == site_domain) | F.endswith(d, F.concat(F.lit("."), site_domain))))


def keep_offsite(email: Column, has_same: Column) -> Column:
    kept = lambda reg: (reg != "") & (U.one_of(reg, FREE_MAIL) | ~(has_same & squash(local(email)).isin(*OFFSITE_DROPPED)))
    return ~F.startswith(domain(email), F.lit("www.")) & U.bind(U.registrable_domain(domain(email)), kept)


def is_typo(site_domain: Column, email: Column) -> Column:
    """The host is another than the site's, but one name begins the other."""
    near = lambda reg: (reg != "") & (reg != site_domain) & (F.startswith(reg, site_domain) | F.startswith(site_domain, reg))
    return (site_domain != "") & U.bind(U.registrable_domain(domain(email)), near)


def priority(email: Column) -> Column:
    def rank(x: Column) -> Column:
        a, key = x["a"], x["key"]
        return (
            F.when(U.one_of(a, ROLES), 100).when(U.one_of(key, ROLES), 90).when(contains_any(key, ROLES), 70)
            .when(key.rlike("^[a-z]+$"), 20).when(key.rlike("[0-9]"), 5).otherwise(10)
        )

    return U.bind(U.bind(local(email), lambda a: F.struct(a.alias("a"), squash(a).alias("key"))), rank)
