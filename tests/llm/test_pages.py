"""Search, URL filters and HTML extraction, against brute force and planted pages."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import html, topk, urls

NAN, INF = float("nan"), float("inf")


def best_by_hand(rows: list[tuple], every: int, k: int) -> list[tuple]:
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("copies", [0, 300])
def test_top_k(spark, copies):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(copies)]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [NAN] + [1.0] * 7), (2150, [INF] + [1.0] * 7), (2200, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = topk.top_k(frame, is_query=F.col("id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == best_by_hand(rows, 50, 5)


def test_top_k_of_few(spark):
    shape = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame([], shape), is_query=F.col("id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], shape)
    got = topk.top_k(two, is_query=F.col("id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.COM", "a.com", "", None), ("http://A.COM/x?y#z", "a.com", "/x", "com/"),
    ("http://example.com/en/a", "example.com", "/en/a", "example.com/en/"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://b.net/es/1", "b.net", "/es/1", "net/es/"),
    ("http://b.net/ES/1", "b.net", "/ES/1", None), ("http://x.org/a://b/c", "x.org", "/a://b/c", None), ("http://h?p/en/", "h", "", None),
    ("http://net/fr/", "net", "/fr/", "net/fr/"),
])
def test_rules(spark, url, host, path, rule):
    frame = spark.createDataFrame([(1, url)], "page_id long, url string")
    h, p = urls.host_and_path("url")
    name, verdict = urls.fitting(urls.RULES, F.col("h"), F.col("p"))
    r = frame.select(h.alias("h"), p.alias("p")).select("h", "p", name.alias("rule"), verdict.alias("verdict")).first()
    assert (r["h"], r["p"], r["rule"]) == (host, path, rule)


def test_spread_is_pagerank(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(12), rng.randrange(12)): rng.randrange(1, 4) for _ in range(30)}
    pairs = {k: n for k, n in pairs.items() if k[0] != k[1]}
    links = spark.createDataFrame([(f"h{a}", f"h{b}", n) for (a, b), n in pairs.items()], "src string, dst string, n long")
    got = {r["host"]: r["rank"] for r in urls.spread(links, spark.createDataFrame([("h0", 0.5), ("h3", 0.5)], "host string, seed double"), rounds=60).collect()}
    m, s = np.zeros((12, 12)), np.zeros(12)
    for (a, b), n in pairs.items():
        m[b, a] += n
    m /= np.maximum(m.sum(axis=0), 1)
    s[[0, 3]] = 0.5
    r = s.copy()
    for _ in range(60):
        moved = urls.DAMPING * m @ r
        r = moved + s * (1 - moved.sum())
    for k in range(12):
        assert got.get(f"h{k}", 0.0) == pytest.approx(r[k], abs=1e-5)


def test_distrust_reaches_who_links_to_blocked_hosts(spark):
    """A host that links to two blocked ones holds more than half of what either starts with."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", link("bad.net") + link("worse.net")), (8, "http://worse.net/fr/", ""), (3, "http://good.com/1", link("fine.org")),
            (4, "http://fine.org/1", ""), (5, None, None), (6, "http://good.com/1", link("fine.org")), (7, "http://alone.org/", None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    assert urls.judge(frame.limit(0)).count() == 0


@pytest.mark.parametrize("linkers", [1, 10, 100])
def test_one_blocked_host_counts_for_each_linker(spark, linkers):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [("http://bad.net/es/1", ""), ("http://fine.org/", ""), ("http://good.com/", link("both.org")),
            ("http://both.org/", link("bad.net")), ("http://some.org/", link("bad.net") + link("fine.org"))]
    rows += [(f"http://farm{k}.org/", link("bad.net")) for k in range(linkers)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r for r in urls.judge(frame).collect()}
    # both.org is linked only by an allowed host, and half of some.org's links go to a blocked one.
    assert {h: r["verdict"] for h, r in got.items()} == {
        "bad.net": "block", "fine.org": "allow", "good.com": "allow", "both.org": "allow", "some.org": "allow",
    } | {f"farm{k}.org": "block" for k in range(linkers)}
    assert got["farm0.org"]["distrusted_share"] == pytest.approx(urls.DAMPING, abs=1e-5)
    # A fixed point: what the blocked host does not hold is divided among its linkers.
    d, shares = urls.DAMPING, linkers + 2
    assert got["farm0.org"]["distrust"] == pytest.approx(got["bad.net"]["distrust"] * d / shares, abs=1e-6)


def test_ranks_and_shares_reach_far_hosts(spark):
    """Along a chain of 40 hosts, with the rounds that ``judge`` takes."""
    links = spark.createDataFrame([(f"h{k + 1}", f"h{k}", 1) for k in range(40)], "src string, dst string, n long")
    share = {r["host"]: r["reach"] for r in urls.reach(links, spark.createDataFrame([("h0", 1.0)], "host string, mark double")).collect()}
    assert all(share[f"h{k}"] == pytest.approx(urls.DAMPING**k, abs=1e-5) for k in range(41))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    rank = {r["host"]: r["rank"] for r in urls.spread(back, spark.createDataFrame([("h0", 1.0)], "host string, seed double")).collect()}
    first = (1 - urls.DAMPING) / (1 - urls.DAMPING**41)
    assert all(rank[f"h{k}"] == pytest.approx(first * urls.DAMPING**k, abs=1e-5) for k in range(41))


PAGE = """<html><head><title>Site</title><style>p {}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>One</a></li><li>Two</li></ul></nav><div class="{holder}"><h1>Head &amp; line</h1>
<p>First  paragraph\nwith <b>bold</b> text and more words to read.</p><div class=advert>Buy this now</div>
<p>Second&nbsp;one&#8212;ends here, after a good many further words.</p><script>var x = "<p>no</p>";</script></div>
<section id="comments"><p>Nice post, thanks to all of you for this!</p></section><aside>Side</aside><footer>Foot</footer></body></html>"""
TEXT = "Head & line\n\nFirst paragraph with bold text and more words to read.\n\nSecond one—ends here, after a good many further words."


@pytest.mark.parametrize("form", [PAGE.replace("{holder}", "content"), PAGE.replace('<div class="{holder}">', "<article>").replace("</script></div>", "</script></article>")])
def test_main_text(spark, form):
    rows = [(1, "u", form), (2, None, None), (3, "u", ""), (4, "u", "<p>cut <b>off"), (5, "u", "<nav>only menu</nav>"), (1, "u", form)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = html.main_text(frame).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == TEXT
    assert by[2]["text"] == by[3]["text"] == by[5]["text"] == "" and by[4]["text"] == "cut off"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.main_text(frame.limit(0)).count() == 0


def test_long_page_is_read_whole():
    page = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert html.extract(page, html.PRIOR).count("some words here") == 20_000
