import random

from sitegrain.operators import candidates, contacts, importing, links, state


def test_sheet_column(spark):
    rows = [("s", 0, ["Firm", "LinkedIn URL", "Email", "Company Website"]), ("s", 1, ["Blue Kiln", "https://linkedin.com/company/bluekiln", "info@bluekiln.co.uk", "bluekiln.co.uk"]), ("s", 2, ["Oak Ferry", "https://linkedin.com/company/oakferry", "info@oakferry.de", "https://oakferry.de"])]
    sheet = spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")
    votes = spark.createDataFrame([("s", 1, "high")], "sheet string, col_idx int, confidence string")
    assert importing.pick_column(importing.profile(sheet), votes).collect()[0]["col_idx"] == 3
    got = importing.load_sheet(sheet, lambda p: votes).orderBy("input_index").collect()
    assert [r["website"] for r in got] == ["https://bluekiln.co.uk", "https://oakferry.de"]
    assert len(importing.fingerprint(importing.load_sheet(sheet)).first()["sha256"]) == 64


def test_retry_machine(spark):
    logs = {"a": ["timeout", "timeout"], "b": ["timeout", None], "c": ["llm_queue_timeout"] * 3, "d": ["llm_queue_timeout"] * 2, "e": ["http_403"]}
    rows = [(s, i, x) for s, v in logs.items() for i, x in enumerate(v)]
    got = {r["site"]: (r["status"], r["retry_count"]) for r in state.outcomes(spark.createDataFrame(rows, "site string, attempt int, error string")).collect()}
    assert got == {"a": ("dropped", 2), "b": ("done", 1), "c": ("dropped", 3), "d": ("failed_temp", 2), "e": ("dropped", 0)}


def test_fold_is_the_plain_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for f in "xyz":
        score = None
        for seq in range(300):
            d = rng.choice([3, 3, -1, -9])
            rows.append(("email", f, seq, d))
            score = d if score is None else max(-12, min(60, score + d))
        want[f] = score
    events = spark.createDataFrame(rows, "kind string, feature string, seq long, delta int")
    for chunk in (7, 4096):
        assert {r["feature"]: r["score"] for r in state.fold_scores(events, chunk).collect()} == want


def test_islands(spark):
    spans = spark.createDataFrame([("k", 0, 5), ("k", 6, 7), ("k", 20, 30), ("k", 1, 9)], "k string, lo int, hi int")
    assert [(r["lo"], r["hi"]) for r in state.islands(spans, ["k"], 2).orderBy("lo").collect()] == [(0, 9), (20, 30)]


def test_contacts(spark):
    html = '<title>Blue Kiln Ltd | Home</title><h1>Welcome to Blue Kiln</h1> info@bluekiln.co.uk posted@kilnpartner.org ops@kilnpartner.org info@bluekiln.co.ukk kim@www.bluekiln.co.uk <a href="tel:+44-20-5550-0101">x</a> Phone: 0044 20 5550 0101'
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Blue Kiln Group"}]}</script>'
    pages = spark.createDataFrame([("https://bluekiln.co.uk", 0, "https://bluekiln.co.uk/", html), ("https://bluekiln.co.uk", 1, "https://bluekiln.co.uk/about", ld), ("https://none.de", 2, "https://none.de", None)], "site string, page_pos int, url string, html string")
    sites = spark.createDataFrame([(1, "https://bluekiln.co.uk"), (2, "https://none.de")], "input_index int, site string")
    a, b = contacts.contacts(sites, pages).orderBy("input_index").collect()
    assert (a["company_name"], a["emails"], a["phones"]) == ("Blue Kiln Group", "info@bluekiln.co.uk; ops@kilnpartner.org", "+442055500101")
    assert (b["company_name"], b["emails"], b["phones"]) == ("", "", "")


def test_phone_extensions(spark):
    rows = spark.createDataFrame([("s", "020555001017"), ("s", "02055500101"), ("s", "+49301234567")], "site string, phone string")
    assert sorted(r["phone"] for r in contacts.drop_extensions(rows, ["site"]).collect()) == ["+49301234567", "02055500101"]


def test_links_and_sitemaps(spark):
    html = '<a href="/a">1</a><a class="x" href="b?utm_source=1">2</a><a href="#x">3</a><a href="https://jobs.kiln.de/team">4</a><a href="mailto:x@y.z">5</a><a href="/a">6</a><a href="/f.pdf">7</a><script src="/app.js"></script>'
    pages = spark.createDataFrame([("https://kiln.de/x/", html)], "url string, html string")
    assert [r["link"] for r in links.same_site(pages).orderBy("pos").collect()] == ["https://kiln.de/a", "https://kiln.de/x/b", "https://jobs.kiln.de/team"]
    assert [r["link"] for r in links.same_organisation(pages).collect()] == ["https://jobs.kiln.de/team"]
    assert [r["link"] for r in links.first_party_assets(pages).collect()] == ["https://kiln.de/app.js"]
    files = spark.createDataFrame([("r", "<sitemapindex><loc>m</loc><loc>r</loc></sitemapindex>"), ("m", "<urlset><loc>https://kiln.de/p</loc><loc>https://o.de/q</loc></urlset>")], "url string, xml string")
    roots = spark.createDataFrame([("kiln.de", "r")], "site string, url string")
    assert [r["url"] for r in links.sitemap_pages(files, roots).collect()] == ["https://kiln.de/p"]


def test_plan_limits(spark):
    start = "https://bluekiln.co.uk"
    paths = ["/about-us", "/our-team", "/contact-us", "/impressum", "/privacy-policy", "/team_members/kim-vale/", "/team_members/lee-moor/", "/forums/sponsored_discussions/ask", "/contactus"]
    found = spark.createDataFrame([("s", start, i, start + p) for i, p in enumerate(paths)], "site string, start_url string, pos int, url string")
    rows = candidates.build(found)
    scores = {r["url"]: r for r in rows.collect()}
    assert scores[start + "/team_members/kim-vale/"]["is_person"] and scores[start + "/contactus"]["email_final"] > 0
    rep = candidates.representative_pages(rows).where("role = 'representative'")
    plan = candidates.fetch_plan(found.select("site", "start_url").distinct(), rep, candidates.email_pages(rows), 3, 1, 2, 4)
    got = [(r["role"], r["pos"]) for r in plan.collect()]
    assert len(got) == 4 and sorted(x for x, _ in got if x == "rep") == ["rep"] * 3
    assert not any("forums" in r["url"] for r in plan.collect())


def test_links_of_repeated_urls(spark, tmp_path):
    from sitegrain.plans.queries import same_site_links

    rows = [(1, "https://kiln.de/", '<a href="/a"></a>'), (2, "https://kiln.de/", '<a href="/a"></a><a href="/b"></a>'), (3, "https://oak.de/", '<a href="/c"></a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = same_site_links(spark, str(tmp_path))
    assert got.columns == ["url", "pos", "link"]
    assert sorted(map(tuple, got.collect())) == [
        ("https://kiln.de/", 1, "https://kiln.de/a"), ("https://kiln.de/", 1, "https://kiln.de/a"), ("https://kiln.de/", 2, "https://kiln.de/b"), ("https://oak.de/", 1, "https://oak.de/c"),
    ]


def test_shorter_numbers_win(spark):
    rows = [("a", "+49 30 1234567"), ("a", "+49 30 123456789"), ("a", "+49 30 765432"), ("b", "+49 30 123456789")]
    got = contacts.drop_extensions(spark.createDataFrame(rows, "site string, phone string"), ["site"]).collect()
    assert sorted((r["site"], r["phone"]) for r in got) == sorted(r for k, r in enumerate(rows) if k != 1)


def test_later_attempts_change_nothing(spark):
    rows = [("x", n, "timeout") for n in range(1, 4)] + [("x", 4, None), ("y", 1, None), ("y", 2, "http_404")]
    got = {r["site"]: r["status"] for r in state.outcomes(spark.createDataFrame(rows, "site string, attempt int, error string")).collect()}
    assert got == {"x": "dropped", "y": "done"}
