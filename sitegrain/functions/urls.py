"""URL functions as Column expressions; null is treated as the empty string and '' stands for "none"."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au",
    "net.au", "org.au", "com.br", "net.br", "org.br", "co.nz", "org.nz", "com.mx", "org.mx",
)
# Hosts of social networks.
SOCIAL_HOSTS = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "wechat.com", "weibo.com")
# Query keys that only track, besides utm_*.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "ref_src", "srsltid")
# Parts of paths that no page has, and file endings that are no pages.
SYSTEM_PATHS = ("/.well-known/sgcaptcha", "/cdn-cgi/", "/wp-admin/", "/wp-login.php", "/xmlrpc.php")
FILE_ENDINGS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dmg", ".apk",
)
# Well-known paths worth probing.
PROBE_PATHS = (
    "/impressum", "/imprint", "/kontakt", "/kontakt.html", "/ueber-uns", "/uber-uns", "/about-us/our-people", "/our-people", "/company-leadership",
    "/executive-team", "/leadership", "/management", "/our-team", "/team-members", "/team", "/people", "/about-us", "/about", "/about.html",
    "/company", "/contact-us", "/contact", "/contact.html", "/legal-notice", "/privacy-policy", "/privacy", "/terms",
)
# Compound path words and what they are made of.
COMPOUNDS = {
    "aboutus": ("about", "us"), "contactus": ("contact", "us"), "executiveteam": ("executive", "team"), "leadershipteam": ("leadership", "team"),
    "managementteam": ("management", "team"), "ourpeople": ("our", "people"), "ourteam": ("our", "team"), "privacypolicy": ("privacy", "policy"), "teammembers": ("team", "members"),
}
# Leading words that don't tell page families apart; words that are not learned from.
FAMILY_SKIP = ("financial", "advisers", "individual", "individuals", "professional", "professionals")
LEARNING_STOP = ("and", "for", "from", "our", "the", "with", "your")
# Words of person pages.
PERSON_CONTEXT = (
    "about", "bio", "board", "contact", "director", "executive", "founder", "leadership", "management", "member", "members", "officers",
    "partner", "partners", "people", "principal", "profile", "profiles", "referral", "referrals", "solicitor", "team", "kontakt",
)
PERSON_NO_NAME = (*PERSON_CONTEXT,
    "and", "advice", "business", "certification", "charitable", "coach", "coaching", "company", "commercial", "corporate", "course", "courses", "cultures",
    "digital", "dispute", "employment", "executive", "faq", "faqs", "foundation", "fund", "funds", "group", "help", "home", "html", "index", "investment",
    "investments", "leaders", "management", "mentoring", "office", "our", "page", "pages", "payroll", "private", "resolution", "responsibility", "secretarial",
    "service", "services", "sessions", "sitemap", "start", "store", "support", "supervision", "taxation", "the", "training", "us", "wealth",
)
NEGATIVE = ("blog", "discussion", "discussions", "event", "forum", "forums", "news", "post", "press-release", "sponsored", "tag", "author", "category")
# Words of named detail pages in discovery, and words that speak against a page there.
DETAIL_CONTEXT = ("about", "leadership", "management", "officers", "our", "people", "profile", "profiles", "referral", "referrals", "team")
DETAIL_NO_NAME = (*DETAIL_CONTEXT,
    "business", "careers", "charitable", "company", "corporate", "culture", "cultures", "director", "directors", "executive", "foundation", "fund", "funds",
    "group", "investment", "investments", "legal", "office", "our", "people", "planning", "responsibility", "service", "services", "wealth",
)
DISCOVERY_NEGATIVE = (
    "article", "articles", "award", "awards", "blog", "case", "event", "events", "funds", "insight", "insights", "journeys", "news", "post", "posts",
    "resource", "resources", "stories", "story", "update", "updates",
)
# Words of related sub-domains and of pages that lead to them.
RELATED_HOSTS = (
    "about", "career", "careers", "company", "contact", "help", "jobs", "leadership", "people", "support", "team",
)
RELATED_PATHS = (
    "about", "board", "career", "careers", "company", "contact", "director", "executive", "founder", "governance", "jobs",
    "leadership", "management", "officers", "people", "president", "privacy", "support", "team", "terms",
)
SCAN_WORDS = ("about", "contact", "company", "help", "people", "privacy", "support", "team")


def text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def bind(value: Column, f) -> Column:
    """f of the value, which is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quoted(names) -> str:
    """Alternatives of a pattern that stand for themselves."""
    return "|".join(f"\\Q{n}\\E" for n in dict.fromkeys(names))


def _grouped(names: set[str]) -> str:
    heads: dict[str, set[str]] = {}
    for n in names:
        heads.setdefault(n[:1], set()).add(n[1:])
    if "" in heads:  # what goes on from here need not be looked at
        return ""
    parts = [(c if c.isalnum() else "\\" + c) + _grouped(rest) for c, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def anywhere(names) -> str:
    """A pattern that occurs where one of the names does, grouped by their beginnings, so that most places of a text are passed at their first sign."""
    firsts = "".join(sorted({n[0] if n[0].isalnum() else "\\" + n[0] for n in names}))
    return f"(?=[{firsts}]){_grouped(set(names))}"


def one_of(value: Column, names) -> Column:
    """Whether the value is one of the names (one pattern keeps plans small)."""
    return value.rlike(rf"\A(?:{quoted(names)})\z")


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in dict.fromkeys(values)])


def any_of(tokens: Column, values) -> Column:
    return F.exists(tokens, lambda t: one_of(t, values))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    raw = F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url: Column | str) -> Column:
    return F.regexp_extract(text(url), r"^[^?#]*\?([^#]*)", 1)


def depth(url: Column | str) -> Column:
    """Number of slashes in the path."""
    p = path(url)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def looks_like_email(value: Column | str) -> Column:
    v = F.lower(F.trim(text(value)))
    return (v != "") & ~F.contains(v, F.lit(" ")) & F.contains(v, F.lit("@")) & F.contains(F.regexp_replace(v, r"^[^@]*@", ""), F.lit("."))


def normalize_website(value: Column | str) -> Column:
    """https added, host lower and without www., query and fragment dropped, no slash at the end; '' if no website."""

    def parts(v: Column) -> Column:
        full = F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("https://"), v))
        host = F.lower(F.trim(F.coalesce(F.nullif(netloc(full), F.lit("")), path(full))))
        return F.struct(v.alias("v"), F.coalesce(F.nullif(scheme(full), F.lit("")), F.lit("https")).alias("kind"), host.alias("host"), F.trim(path(full)).alias("path"))

    def address(x: Column) -> Column:
        host = x["host"]
        ok = (x["v"] != "") & ~looks_like_email(x["v"]) & (host != "") & ~F.contains(host, F.lit(" ")) & F.contains(host, F.lit("."))
        return F.when(ok, F.regexp_replace(F.concat(x["kind"], F.lit("://"), F.regexp_replace(host, r"^www\.", ""), x["path"]), "/+$", "")).otherwise("")

    return bind(bind(F.trim(text(value)), parts), address)


def dedupe_key(website: Column | str) -> Column:
    """The whole address in lower case if it has a path, else the host."""
    host, p = F.lower(netloc(website)), path(website)
    return F.when((host != "") & ~p.isin("", "/"), F.lower(text(website))).when(host != "", host).otherwise(F.lower(text(website)))


def is_social(website: Column | str) -> Column:
    host, out = F.lower(netloc(website)), F.lit(False)
    for h in SOCIAL_HOSTS:
        out = out | (host == h) | F.endswith(host, F.lit("." + h))
    return out


def is_homepage(website: Column | str) -> Column:
    return path(website).isin("", "/")


def registrable_domain(value: Column | str) -> Column:
    """The last two labels of the host, three under a suffix of two labels."""

    def host(v: Column) -> Column:
        full = F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("https://"), v))
        h = F.when(~F.contains(v, F.lit("/")), v).otherwise(F.coalesce(F.nullif(netloc(full), F.lit("")), path(full)))
        return F.split_part(F.regexp_replace(F.trim(h), r"^www\.", ""), F.lit(":"), F.lit(1))

    def last(h: Column) -> Column:
        two = F.regexp_extract(h, r"([^.]+\.[^.]+)\.*$", 1)
        three = F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)\.*$", 1)
        return F.when(two == "", h).when(one_of(two, TWO_LABEL_SUFFIXES) & (three != ""), three).otherwise(two)

    return bind(bind(F.lower(F.trim(text(value))), host), last)


def canonical(url: Column | str) -> Column:
    """Key under which spellings of one page are equal."""
    v = F.trim(text(url))
    host = F.regexp_replace(F.lower(netloc(v)), r"^www\.", "")
    q = F.trim(query(v))
    key = F.concat(scheme(v), F.lit("://"), host, F.regexp_replace(path(v), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when((scheme(v) == "") | (netloc(v) == ""), F.regexp_replace(F.lower(v), "/+$", "")).otherwise(key)


def normalize_discovery(url: Column | str) -> Column:
    """Without fragment and tracking keys; the other pairs stay in order, re-encoded."""
    v = F.trim(text(url))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.filter(F.split(query(v), "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(plain(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    key = lambda p: F.lower(F.trim(p["k"]))
    kept = F.filter(pairs, lambda p: (key(p) != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*TRACKING_KEYS))
    q = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    base = F.regexp_extract(v, r"^([^?#]*)", 1)
    return F.when((scheme(v) == "") | (netloc(v) == ""), v).otherwise(F.concat(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.\-]*", scheme(v)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def is_supported(url: Column | str) -> Column:
    v = F.trim(text(url))
    p, out = F.lower(path(v)), ~v.rlike(r"[{}]") & ~F.contains(F.lower(v), F.lit("itemdataobject."))
    for part in SYSTEM_PATHS:
        out = out & ~F.contains(p, F.lit(part))
    out = out & ~F.contains(F.lower(query(v)), F.lit("action=lostpassword"))
    return out & ~p.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")


def _fold_pairs() -> tuple[str, str]:
    """Letters with marks and the ASCII letter each decomposes to."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) for i in range(0xAA, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_fold(value: Column) -> Column:
    """Marks taken off Latin letters; what has no ASCII form is dropped."""
    return F.regexp_replace(F.translate(value, *_fold_pairs()), r"[^\x00-\x7F]", "")


def _expand(token: Column) -> Column:
    out = bind(ascii_fold(token), lambda a: F.when(a.isin("") | (a == token), F.array(token)).otherwise(F.array(token, a)))
    for word, parts in COMPOUNDS.items():
        out = F.when(token == word, words(parts)).otherwise(out)
    return out


def path_tokens(url: Column | str) -> Column:
    """Distinct words of three letters or more of the path, in order; compounds split, marked letters also folded."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
    plain = F.transform(plain, lambda p: F.regexp_replace(F.lower(F.trim(p)), r"\.[a-z0-9]{2,5}$", ""))
    tokens = F.flatten(F.transform(plain, lambda p: F.split(p, r"(?U)[\W_]+")))
    return F.array_distinct(F.filter(F.flatten(F.transform(tokens, _expand)), lambda t: F.length(t) >= 3))


def hint_tokens(url: Column | str) -> Column:
    """Distinct words of three letters or more of the undecoded path."""
    tokens = F.flatten(F.transform(F.split(path(url), "/"), lambda p: F.split(F.lower(F.trim(p)), r"(?U)[\W_]+")))
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 3))


def trim_family(tokens: Column) -> Column:
    """Without the leading words that don't tell families apart."""

    def rest(x: Column) -> Column:
        first = F.array_min(F.transform(x, lambda t, i: F.when(~one_of(t, FAMILY_SKIP), i)))
        return F.when(first.isNull(), F.slice(x, 1, 0)).otherwise(F.slice(x, first + 1, F.size(x)))

    return bind(tokens, rest)


def family_key(tokens: Column) -> Column:
    return bind(trim_family(tokens), lambda t: F.when(F.size(t) == 0, "root").otherwise(F.array_join(F.slice(t, 1, 2), "/")))


def _named(tokens: Column, context, no_name, negative) -> Column:

    def test(x: Column) -> Column:
        names = F.filter(x, lambda t: ~one_of(t, dict.fromkeys([*no_name, *negative])))
        named = bind(names, lambda n: F.size(n).between(2, 3) & F.forall(F.slice(n, 1, 2), lambda t: t.rlike(r"^\p{L}{3,}$")))
        return F.size(x).between(3, 6) & any_of(x, context) & named

    return bind(tokens, test)


def person_names(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~one_of(t, dict.fromkeys([*PERSON_NO_NAME, *NEGATIVE])))


def is_person_page(tokens: Column) -> Column:
    """From the trimmed tokens of a path."""
    return _named(tokens, PERSON_CONTEXT, PERSON_NO_NAME, NEGATIVE)


def is_named_detail(tokens: Column) -> Column:
    return _named(tokens, DETAIL_CONTEXT, DETAIL_NO_NAME, DISCOVERY_NEGATIVE)


def learning_tokens(tokens: Column, person: Column) -> Column:
    """Words to learn from, and the family they make."""
    names = F.when(person, person_names(trim_family(tokens))).otherwise(F.slice(tokens, 1, 0))
    kept = F.filter(F.array_except(tokens, names), lambda t: ~one_of(t, LEARNING_STOP))

    def with_family(x: Column) -> Column:
        return F.when(x["family"] == "root", x["kept"]).otherwise(F.array_union(x["kept"], F.array(F.concat(F.lit("family:"), x["family"]))))

    return bind(bind(kept, lambda k: F.struct(k.alias("kept"), family_key(k).alias("family"))), with_family)


def locale(url: Column | str) -> Column:
    """The first path part if it is like en or en-gb, else ''."""
    return F.regexp_extract(F.lower(path(url)), r"^/*([a-z]{2}(?:-[a-z]{2})?)(?:/|$)", 1)


def locale_penalty(start: Column | str, url: Column | str) -> Column:
    a, b = locale(start), locale(url)
    return F.when((a != "") & (b != "") & (a != b), 12).otherwise(0)


def probe_urls(start: Column | str) -> Column:
    """Addresses of well-known paths under the host and www.host, with the start's locale and without."""
    v, host, loc = text(start), netloc(start), locale(start)
    hosts = F.when(F.startswith(F.lower(host), F.lit("www.")), F.array(host)).otherwise(F.array(host, F.concat(F.lit("www."), host)))
    prefixes = F.when(loc != "", F.array(F.concat(F.lit("/"), loc), F.lit(""))).otherwise(F.array(F.lit("")))
    out = F.flatten(F.transform(hosts, lambda h: F.flatten(F.transform(prefixes, lambda p: F.transform(words(PROBE_PATHS), lambda x: F.concat(scheme(v), F.lit("://"), h, p, x))))))
    return F.when((scheme(v) == "") | (host == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(out))


def is_related_seed(url: Column | str) -> Column:
    host = F.filter(F.split(F.lower(netloc(url)), r"(?U)[\W_]+"), lambda t: F.length(t) >= 3)
    return (netloc(url) != "") & (any_of(host, RELATED_HOSTS) | any_of(hint_tokens(url), RELATED_PATHS))


def http_fallback(url: Column | str) -> Column:
    return F.regexp_replace(text(url), "^https://", "http://")


def origin(url: Column | str) -> Column:
    return F.when(netloc(url) != "", F.concat(scheme(url), F.lit("://"), netloc(url))).otherwise("")


def host_key(url: Column | str) -> Column:
    return F.coalesce(F.nullif(F.lower(netloc(url)), F.lit("")), F.lit("__unknown__"))


def resolve(base: Column | str, href: Column | str) -> Column:
    """An absolute address from a link on a page; dot segments are removed."""
    h, b = F.trim(text(href)), text(base)
    folder = F.regexp_replace(path(b), r"[^/]*$", "")
    joined = F.when(F.startswith(h, F.lit("/")), h).when(F.startswith(h, F.lit("?")), F.concat(path(b), h)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), h))
    clean = F.regexp_replace(joined, r"(?<=/)\./", "")
    for _ in range(4):
        clean = F.regexp_replace(clean, r"^/\.\./|(?<=/)(?!\.\./)[^/?#]+/\.\./", F.when(F.startswith(clean, F.lit("/../")), "/").otherwise(""))
    return F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme(b), F.lit(":"), h)).otherwise(F.concat(scheme(b), F.lit("://"), netloc(b), clean))

# Content types of pages that are read as text.
TEXT_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "text/plain")


def is_supported_response(url: Column | str, content_type: Column | str) -> Column:
    """Whether a response is read: a supported address, and a text type or none at all."""
    kind = F.lower(text(content_type))
    return is_supported(url) & ((kind == "") | F.exists(words(TEXT_TYPES), lambda t: F.contains(kind, t)))


def asset_key(url: Column | str) -> Column:
    """Host in lower case and path: assets that differ in scheme, query or fragment alone have one key."""
    return F.concat(F.lower(F.trim(netloc(url))), F.trim(path(url)))
