import re

import pytest

from tillweave.llm import urls


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls._UPPER, urls._LOWER)), m[2]) if m else ("", "")
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))


def test_rules_match_brute_force(table, spark):
    extra = [None, "", "no scheme", "http://", "x://A.Net", "x://net/fr/", "http://notnet/fr/1", "http://WWW.Example.com/en/a?b#c", "http://a.www.example.com/en/", "a://b://com/", "http://com?x", "http://com/"]
    pages = table("pages").select("url", "html").union(spark.createDataFrame([(u, None) for u in extra], "url string, html string"))
    for r in urls.with_verdicts(pages).collect():
        host, path, rule, verdict = brute(r.url)
        assert (r._url.host, r._url.path, r._url.rule) == (host, path, rule)
        assert r._url.verdict == verdict if verdict else r._url.verdict in ("allow", "block")


def test_distrust_follows_links_backwards(spark):
    link = '<a href="http://{}/x">'.format
    rows = [(1, "http://bad.example.com/en/1", ""), (2, "http://near.org/1", link("bad.example.com") * 3), (3, "http://far.org/", link("far.org")), (4, "http://good.com/", link("liked.org")), (5, "http://liked.org/", "<a href=/own>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in urls.report(pages).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"bad.example.com": "block", "near.org": "block", "far.org": "allow", "good.com": "allow", "liked.org": "allow"}
    assert got["liked.org"].trust > 0 and got["near.org"].distrust > 0 and got["far.org"].distrust == 0


def test_ranks_match_power_iteration(spark):
    edges = {("a", "b"): 1.0, ("a", "c"): 3.0, ("b", "a"): 1.0, ("c", "c"): 2.0}
    df = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, weight double")
    got = {r.host: r["rank"] for r in urls.pagerank(df, spark.createDataFrame([("a", 1.0)], "host string, share double"), 5).collect()}
    rank = {"a": 1.0}
    for _ in range(5):
        new = {"a": 0.15}
        for (s, d), w in edges.items():
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * w / sum(x for (t, _), x in edges.items() if t == s)
        rank = new
    assert got == pytest.approx({k: v for k, v in rank.items() if v})


def test_hostile_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1)] * 2 + [(1, "http://a.org/", "x", 2)], "page_id long, url string, html string, rank int")
    out = urls.with_verdicts(pages)
    assert out.count() == 3 and out.columns == [*pages.columns, "_url"]
    assert urls.report(pages.limit(0)).count() == 0
