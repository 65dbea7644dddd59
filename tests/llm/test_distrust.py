import pytest

from tillweave.llm import urls

LINK = '<a href="http://{}/x">'.format


def report(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in urls.report(pages).collect()}


def test_a_mixed_net_host_seeds_distrust(spark):
    rows = [(k, f"http://mixed.net/{'es' if k < 2 else 'en'}/{k}", "") for k in range(5)]
    rows += [(10 + k, f"http://worse.net/{'fr' if k < 4 else 'en'}/{k}", "") for k in range(5)]
    rows += [(20, "http://clean.net/a", ""), (21, "http://friend.org/", LINK("mixed.net")), (22, "http://other.org/", LINK("clean.net"))]
    got = report(spark, rows)
    assert {k: r.verdict for k, r in got.items()} == {**dict.fromkeys(range(5), "block"), **dict.fromkeys(range(10, 15), "block"), 20: "allow", 21: "block", 22: "allow"}
    assert got[3].distrust * 2 == pytest.approx(got[14].distrust) and got[20].distrust == 0


def test_a_long_chain(spark):
    n = 25
    rows = [(0, "http://h0.net/es/", "")] + [(k, f"http://h{k}.org/", LINK(f"h{k - 1}." + ("net" if k == 1 else "org"))) for k in range(1, n)]
    got = report(spark, rows)
    # what is left of a whole seed after k hops
    assert {k: r.verdict for k, r in got.items()} == {k: "block" if 0.85**k > urls.MARGIN else "allow" for k in range(n)}
    # a host hands all it has to the one that links to it; the restart feeds the first host alone
    want = {k: 0.15 * 0.85**k * n for k in range(n)}
    assert {k: r.distrust for k, r in got.items()} == pytest.approx(want, rel=1e-3)


def test_small_ranks_are_not_cut(spark, monkeypatch):
    """Ranks are rounded after they are multiplied by the number of hosts."""
    monkeypatch.setattr(urls, "pagerank", lambda edges, seeds, *a, **k: seeds.selectExpr("host", "share * 1e-11 AS rank"))
    got = report(spark, [(k, f"http://h{k}.net/es/", "") for k in range(50)])
    assert all(r.distrust == pytest.approx(1e-11, rel=0.1, abs=0) for r in got.values())


def test_one_blocked_page_in_fifty(spark):
    """The host stays allowed and so does who links to it; with ten of fifty both go."""
    for bad, verdict in ((1, "allow"), (10, "block")):
        rows = [(k, f"http://shop.net/{'fr' if k < bad else 'en'}/{k}", "") for k in range(50)] + [(100, "http://fan.org/", LINK("shop.net")), (101, "http://worst.net/es/", "")]
        got = report(spark, rows)
        assert all(got[k].verdict == ("block" if k < bad else verdict) for k in range(50)) and got[100].verdict == verdict


def test_taken_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "", "x")], "page_id long, url string, html string, _url string")
    out = urls.with_verdicts(pages)
    assert out.columns == [*pages.columns, "_url_"] and out.first()["_url_"].host == "a.org"
