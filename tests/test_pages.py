"""Page lists and page texts against plain Python on small fixtures."""

import random

from pyspark.sql import functions as F

from sitegrain.functions import pagetext as PT
from sitegrain.functions import shell as SH
from sitegrain.functions import text as T
from sitegrain.functions import urls as U
from sitegrain.operators import contacts as C
from sitegrain.operators import importing, state
from sitegrain.operators import links as LK
from sitegrain.operators import pagesets as PS

TEXTS = [
    None, "", "  \n ", "one line", "cookie policy here\nManage cookies", "Our Team\nAda Stone\nAda Stone", "\n".join(f"line {i}" for i in range(60)),
    "\n".join(("Founder and owner" if i % 30 == 7 else f"text {i % 11} of {i}") for i in range(400)), "intro\r\n\r\nContact us\x85Call now end",
    "\n".join(f"Director {i}" if i % 3 == 0 else "same line" for i in range(200)),
]


def plain_lines(text):
    return [x.strip() for x in (text or "").strip().splitlines() if x.strip() and not any(n in x.lower() for n in PT.NOISE)]


def plain_windows(lines):
    out = []
    for i, x in enumerate(lines):
        if any(h in x.lower() for h in PT.HINTS):
            lo, hi = max(0, i - 2), min(len(lines), i + 8)
            if out and lo <= out[-1][1] + 2:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
    return out[:8]


def plain_sections(text, short):
    lines = plain_lines(text)
    if not lines:
        return (text or "").strip()
    out, seen, at = [], set(), plain_windows(lines)
    if not at and not short:
        return "\n".join(lines)

    def add(part):
        for x in part:
            if x not in seen:
                seen.add(x)
                out.append(x)

    if at:
        out.append(PT.TELLING)
        for k, (lo, hi) in enumerate(at):
            if k:
                out.append(PT.BREAK)
            add(lines[lo:hi])
    out.append(PT.BEGINNING)
    add(lines[: PT.HEAD])
    if not short:
        out.append(PT.WHOLE)
        add(lines)
    elif len(lines) > PT.TAIL:
        out.append(PT.ENDING)
        add(lines[-PT.TAIL :])
    return "\n".join(out)


def test_texts_by_the_plain_rule(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in rows.select("i", PT.prioritized(F.col("text")).alias("a"), PT.abbreviated(F.col("text")).alias("b")).collect():
        assert r["a"] == plain_sections(TEXTS[r["i"]], False) and r["b"] == plain_sections(TEXTS[r["i"]], True), r["i"]
    assert rows.limit(0).select(PT.prioritized(F.col("text"))).count() == 0


def test_budget_by_the_plain_rule(spark):
    rng, rows = random.Random(3), []
    for site in range(20):
        for pos in range(rng.randint(1, 6)):
            rows.append((site, pos, f"https://a.com/{pos}", rng.choice(TEXTS[3:])))
    got = {(r["site"], r["pos"]): r["content"] for r in PT.fit_budget(spark.createDataFrame(rows, "site long, pos long, url string, content string"), 3000).collect()}
    for site in range(20):
        own = [r[3] for r in rows if r[0] == site]
        for k in range(len(own) - 1, -1, -1):
            if sum(map(len, own)) <= 3000:
                break
            short = plain_sections(own[k], True)
            own[k] = short if len(short) < len(own[k]) else own[k]
        assert [got[site, k] for k in range(len(own))] == own


def test_lists(spark):
    pages = spark.createDataFrame([(1, 0, "https://a.com/x"), (1, 1, " https://www.a.com/x/ "), (1, 2, None), (1, 3, ""), (1, 4, "https://a.com/y"), (2, 0, "https://b.com/")], "site long, pos long, url string")
    listed = lambda df: [tuple(r) for r in df.orderBy("site", "pos").select("site", "pos", "url").collect()]
    assert listed(PS.merge([pages])) == [(1, 0, "https://a.com/x"), (1, 1, "https://www.a.com/x/"), (1, 2, "https://a.com/y"), (2, 0, "https://b.com/")]
    assert listed(PS.exclude(pages, pages.where("pos = 0"))) == [(1, 0, "https://a.com/y")]
    fetched = spark.createDataFrame([(1, 1, "https://a.com/y", "old"), (1, 2, "https://a.com/y", "new")], "site long, seq long, url string, html string")
    found = PS.email_rule_pages(pages.where("pos = 4"), pages, PS.latest(fetched))
    assert [tuple(r) for r in found.collect()] == [(1, 0, "https://a.com/y", "new")]
    home = spark.createDataFrame([(1, "https://a.com/x", "<p>"), (2, "https://b.com/", "")], "site long, url string, html string")
    assert listed(PS.without_reused(pages, home)) == [(1, 0, "https://www.a.com/x/"), (1, 1, "https://a.com/y"), (2, 0, "https://b.com/")]
    assert PS.merge([pages.limit(0)]).count() == 0


def test_lines_and_names(spark):
    rows = spark.createDataFrame([("Ada Stone",), ("Firm Ltd contact",), (None,)], "x string")
    got = [{(b["kind"], b["score"]) for b in r["b"]} for r in rows.select(SH.buckets(F.col("x")).alias("b")).collect()]
    assert got == [{("general", 62), ("person", 82)}, {("general", 90), ("role", 102), ("company", 100)}, {("general", 0)}]
    page = "<TITLE> A  b </TITLE><meta name='Description' content='a B'><meta property=\"og:title\" content=\"Other\"><meta name=x content=y>"
    assert spark.range(1).select(SH.head_lines(F.lit(page))).first()[0] == ["A b", "Other"]
    names = ["Madam Kim Vale", "Prof. Ada", "sales-team", "Ärzte", "李"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.representative_name(F.col("n"))).collect()] == ["Kim Vale", "Prof. Ada", "", "Ärzte", ""]


def test_jobs(spark):
    sites = spark.createDataFrame([("a", 0, "done", 2), ("b", 1, "dropped", 1)], "site string, input_index long, status string, retry_count int")
    assert {r["status"] for r in state.rerun(sites).collect()} == {"pending"}
    half = sites.withColumn("status", F.when(F.col("site") == "a", "running").otherwise("done"))
    assert state.rerun(half).collect() == half.collect()
    assert state.prepare(sites, ("n", "f"), "n", "f", sites).collect() == sites.collect()
    assert {(r["status"], r["retry_count"]) for r in state.prepare(sites, ("n", "f"), "n", "g", sites).collect()} == {("pending", 0)}


def test_probe_batches_stop_as_the_plain_loop_does(spark):
    rng = random.Random(4)
    runs = {site: [rng.choice((0, 0, 1, 2, 5)) for _ in range(rng.randint(1, 7))] for site in range(60)}
    want = set()
    for site, hits in runs.items():
        found = empty = 0
        for n, h in enumerate(hits, 1):
            want.add((site, n, h))
            found, empty = found + h, 0 if h else empty + 1
            if found >= 8 or empty >= 2 or (n >= 2 and found < 2):
                break
    rows = [(s, n, h or None) for s, hits in runs.items() for n, h in enumerate(hits, 1)] + [(0, None, 3), (1, 1, 0)]
    table = spark.createDataFrame(rows, "site int, batch int, hits int")
    assert {tuple(r) for r in state.probe_batches(table).collect()} == want
    assert state.probe_batches(table.limit(0)).count() == 0


def test_subdomain_probes(spark):
    rows = [
        (1, "https://www.firm.co.uk/", p, u)
        for p, u in enumerate(["https://firm.co.uk/about", "https://shop.firm.co.uk/about", "https://firm.co.uk/about", None, "", "/team", "https://other.co.uk/team", "https://firm.co.uk/blog", "https://help.firm.co.uk/privacy-policy", "https://firm.co.uk/team/a", "https://firm.co.uk/support"])
    ]
    got = LK.subdomain_probes(spark.createDataFrame(rows, "site int, start string, pos int, url string")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, rows[0][3]), (1, 1, rows[1][3]), (1, 2, rows[8][3]), (1, 3, rows[9][3])]


def test_ranked_biographies(spark):
    people = [(1, 0, "bea", "Clerk", None), (1, 1, "Ada", "Director", ["Leadership"]), (1, 2, "cy", None, ["Founder", "Owner"]), (1, 3, "Al", "clerk", []), (1, 4, None, None, None), (1, 5, "Al", "", [])]
    rows = spark.createDataFrame(people, "site int, pos int, name string, title string, departments array<string>")
    got = [(r["place"], r["name"], r["score"]) for r in C.ranked_biographies(rows, 5).orderBy("place").collect()]
    assert got == [(1, "cy", 138), (2, "Ada", 84), (3, None, 0), (4, "Al", 0), (5, "Al", 0)]


def test_responses_reasons_and_assets(spark):
    rows = spark.createDataFrame([("https://A.com/x?y=1", "TEXT/HTML; charset=x"), ("https://a.com/x.pdf", "text/html"), ("//A.com/b#c", None), ("https://a.com/x", "image/png"), (None, "")], "url string, kind string")
    got = [tuple(r) for r in rows.select(U.is_supported_response("url", "kind"), U.asset_key("url")).collect()]
    assert got == [(True, "a.com/x"), (False, "a.com/x.pdf"), (True, "a.com/b"), (False, "a.com/x"), (True, "")]
    table = spark.createDataFrame([("第1列", 0, 0, " own "), ("Website", 0, 1, "own"), ("第1列", 0, None, "own"), ("Website", 0, 0, " "), (None, 0, None, None)], "header string, chosen int, voted int, reason string")
    reasons = [r[0] for r in table.select(importing.selection_reason(*(F.col(c) for c in table.columns))).collect()]
    assert reasons == ["own", *(importing.REASONS[k] for k in ("overruled", "unnamed", "named", "named"))]


def test_unescape_sends_entities_alone_to_python(spark):
    import html

    some = [None, "", "plain", "&amp;", "a&lt;b&gt;&notit;&not&notin;&#64;&#x40;&#X40 &#0;&#x110000;&#128;&unknown; & &; &&amp;&amp &a b;&\u00e9amp; &#;", "x" * 50 + "&" + "y" * 40 + ";", "&middot;\U0001f600&eacute;\n&NotEqualTilde;"]
    rows = spark.createDataFrame(list(enumerate(some)), "i int, x string")
    got = {r["i"]: r["y"] for r in rows.select("i", T.unescape("x").alias("y")).collect()}
    assert got == {i: x if x is None else html.unescape(x) for i, x in enumerate(some)}
    plan = rows.select(T.unescape("x"))._jdf.queryExecution().executedPlan().toString()
    assert "_characters(regexp_extract_all(" in plan  # not the texts


def test_batches_are_handled_in_bounded_runs():
    import pyarrow as pa

    from sitegrain.functions import batches

    column = pa.array(["x" * (batches.CHUNK // 4)] * 10 + [None, "", "y" * batches.CHUNK * 2, "z"])
    runs = [c[0] for c in batches.slices([column])]
    assert max(sum(len(x or "") for x in r.to_pylist()[1:]) for r in runs) <= batches.CHUNK and len(runs) > 3
    assert pa.concat_arrays(list(batches.mapped(lambda x: x, pa.string(), [column]))).equals(column)
    assert list(batches.slices([pa.array([], pa.string())])) == []


def test_footers_alone_give_contacts(spark, tmp_path):
    from sitegrain.plans import failure_queries as Q

    own = "<h1>Look at a.com</h1><p>kim@own.com joe[at]b.com j&#64;c.com d%40e.com Phone: +44 20 1111 22222</p>"
    rows = [(7, "https://www.firm1.example.com/a", own), (100007, "https://www.firm1.example.com/b", own), (100008, "https://www.firm1.example.com/c", "<p>x</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.footer_contacts(spark, str(tmp_path)).collect()
    assert [(r["emails"].split("; ")[1:], r["phones"]) for r in got] == [(["kim@partner.org"], "+4420555000007; +4420555010000; +4420555010000")]
    assert Q.footer_emails(spark, str(tmp_path)).count() == 6
