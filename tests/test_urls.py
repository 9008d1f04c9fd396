import pytest
from pyspark.sql import functions as F

from sitegrain.functions import emails as E
from sitegrain.functions import phones as P
from sitegrain.functions import text as T
from sitegrain.functions import urls as U


def run(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_websites(spark):
    given = ["bluekiln.co.uk", "https://www.bluekiln.co.uk/", "http://bluekiln.co.uk", "https://bluekiln.co.uk/About?x=1", "hello@bluekiln.co.uk", "not a site", "localhost", None, ""]
    want = ["https://bluekiln.co.uk", "https://bluekiln.co.uk", "http://bluekiln.co.uk", "https://bluekiln.co.uk/About", "", "", "", "", ""]
    assert run(spark, U.normalize_website, given) == want
    assert run(spark, U.dedupe_key, want[:4]) == ["bluekiln.co.uk"] * 3 + ["https://bluekiln.co.uk/about"]


def test_domains(spark):
    given = ["https://www.a.b.co.uk/x", "shop.kiln.de:80", "localhost", "a.co.uk", "http://x.y.com", ""]
    assert run(spark, U.registrable_domain, given) == ["b.co.uk", "kiln.de", "localhost", "a.co.uk", "y.com", ""]


def test_path_words(spark):
    given = ["https://k.de/aboutus/Our-Team.html", "https://k.de/%C3%BCber-uns", "https://k.de/"]
    assert run(spark, U.path_tokens, given) == [["about", "our", "team"], ["über", "uber", "uns"], []]
    people = ["https://k.de/team_members/kim-vale", "https://k.de/news/leadership-update", "https://k.de/team"]
    assert run(spark, lambda v: U.is_person_page(U.trim_family(U.path_tokens(v))), people) == [True, False, False]


def test_discovery_address(spark):
    given = ["https://A.de/x?utm_source=q&b=1&a=#top", "no url", "https://a.de/?gclid=1"]
    assert run(spark, U.normalize_discovery, given) == ["https://A.de/x?b=1&a=", "no url", "https://a.de/"]
    assert run(spark, U.is_supported, ["https://a.de/x.PDF", "https://a.de/{id}", "https://a.de/wp-admin/x", "https://a.de/ok"]) == [False, False, False, True]


@pytest.mark.parametrize("href,want", [("/b", "https://a.de/b"), ("c", "https://a.de/x/c"), ("?q=1", "https://a.de/x/y?q=1"), ("//z.de/1", "https://z.de/1"), ("http://o.de", "http://o.de"), ("../u", "https://a.de/u"), ("./v", "https://a.de/x/v")])
def test_resolve(spark, href, want):
    assert run(spark, lambda v: U.resolve(F.lit("https://a.de/x/y"), v), [href]) == [want]


def test_emails(spark):
    given = ["info@bluekiln.co.uk", "hire[at]bluekiln[dot]co.uk", "hire at bluekiln dot co.uk", "logo@2x.png", "noreply@bluekiln.co.uk", "info@other.example.com", "x..y@kiln.de", ""]
    found = run(spark, lambda v: F.when(E.valid(E.normalized(v)), E.normalized(v)["email"]).otherwise(""), given)
    assert found == ["info@bluekiln.co.uk", "hire@bluekiln.co.uk", "hire@bluekiln.co.uk", "", "", "", "", ""]
    assert run(spark, E.is_placeholder, ["info@kiln.de", "info@sample-shop.de", "testing@kiln.de", "xxxx@kiln.de"]) == [False, True, True, True]


def test_phones(spark):
    given = ["+44-20-5550-0101", "0044 20 5550 0101", "1111111", "12345", "2147483647", "030 555 5555 ext. 12"]
    assert run(spark, P.normalized, given) == ["+442055500101", "+442055500101", "", "", "", "0305555555"]


def test_errors(spark):
    assert run(spark, T.challenge_kind, ["<title>Just a moment...</title>", "sgcaptcha", "Imperva", "ok", None]) == ["cloudflare_challenge", "sgcaptcha_challenge", "imperva_challenge", "", ""]
    assert run(spark, T.retry_budget, ["llm_queue_timeout", "timeout"]) == [2, 1]
    assert run(spark, T.error_reason, ["", "odd"]) == ["未知错误", "odd"]
