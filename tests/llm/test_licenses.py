"""License scans against every rule run over whole texts, one text and one pair of detections at a time."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, seed, settings
from hypothesis import strategies as st

from sitegrain.llm import license_rules as L
from sitegrain.llm import licenses

from .conftest import LOW

RULES = L.rules()
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(text):
    """(n_words, n_base, first, last, base labels, labels, suppressed) by whole scans."""
    words = words_of(text)
    spaced = " " + " ".join(words) + " "
    base = [(i, label) for label, phrase in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    found = []
    for order, rule in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", spaced):
            first = spaced.count(" ", 0, m.start()) - 1
            version = m.groupdict().get("v")
            found.append((first, first + m[0].count(" ") + 1, rule.rank, order, f"{rule.label}-{version.replace(' ', '.')}" if version else rule.label, rule.base))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (b[2] > a[2] or b[2] == a[2] and (b[0] < a[0] or b[1] > a[1] or b[3] < a[3]))
    hidden = [any(inside(a, b) for b in found if b is not a) for a in found]
    labels = {d[4] for d, h in zip(found, hidden, strict=True) if d[5] or not h}
    return (len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), sum(hidden))


def test_rules_hold_their_keywords_and_are_short():
    assert 300 <= len(RULES)
    for rule in RULES:
        assert re._parser.parse(rule.pattern).getwidth()[1] < licenses.REACH


        @seed(7)
        @settings(max_examples=8, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True))
        def check(text):
            assert rule.keyword in text.split(" ")  # noqa: B023

        check()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    lines = [
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
        "All rights reserved.", "SPDX-License-Identifier: BSD-3-Clause", "// SPDX-License-Identifier: GPL 2.0 or\n * later", "cc by cc by", "GNU Lesser General Public License v2.1", "https://creativecommons.org/licenses/by-sa/4.0/",
        "general public\n * license", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit der Zeit", "ALL RIGHTS Réserved", "all rights reserved rights", "Creative Commons Attribution ShareAlike 3.0 Unported License",
        "either version 2 of the License, or (at your option) any later version", "École général", "all\x00rights\x7freserved", "copyright (c) 2019-2021", "Mozilla Public License Version 2.0", "zlib/libpng license",
    ]
    filler = ["the", "of", "für", "MIT", "by", "license", "3", "CC", "ä", "public", "x-y", "gnu", "reserved"]
    out = [None, "", " .,;", *lines]
    for _ in range(60):
        out.append(" ".join(rng.choice(lines) if rng.random() < 0.15 else rng.choice(filler) for _ in range(rng.randint(1, 60))))
    out.append(" ".join(rng.choice(filler) for _ in range(60_000)) + " Released under the MIT License. " + "ü " * 50_000 + "all rights reserved")
    return out


def test_digest_is_the_plain_scan(spark, texts):
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] * 2 + [(None, texts[3], "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").repartition(3)
    got = licenses.digest(docs)
    assert got.columns == [c.split()[0] for c in licenses.DIGEST.split(", ")]
    got = got.collect()
    assert len(got) == len(rows)
    want = {i: plain(t) for i, t in enumerate(texts)} | {None: plain(texts[3])}
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["n_suppressed"]) == want[r["doc_id"]], texts[r["doc_id"] or 3]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert set(want[3][4:6]) == {"cc-by", "cc-by,cc-by-nc-4.0"} and want[4][5] == "apache-2.0" and want[6][5] == "mit" and want[15][5] == ""


def test_detections_and_empty_table(spark, texts):
    docs = spark.createDataFrame([(1, "x Licensed under the Apache License, Version 2.0 y"), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in licenses.detections(docs).collect()]
    assert ("apache-2.0", L.NOTICE, 1, 8, False) in [r[1:] for r in got] and {r[0] for r in got} == {1}
    assert ("apache-2.0", L.NAME, 3, 6, True) in [r[1:] for r in got]
    assert licenses.digest(docs.limit(0)).count() == licenses.detections(docs.limit(0)).count() == 0
