import re

import pytest

from gridspark.llm import urls
from gridspark.llm.queries import URL_RULES
from gridspark.llm.urls import Rule


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")


def judged(spark, rows, rules=URL_RULES, **kw):
    return {r.page_id: r for r in urls.judge(pages(spark, rows), rules, **kw).collect()}


URLS = [
    (None, "", ""), ("", "", ""), ("example.com/x", "", ""), ("http://A.Example.COM/De/x?y#z", "a.example.com", "/De/x"), ("http://h?x", "h", ""),
    ("http://h#/x", "h", ""), ("http://h", "h", ""), ("a://b://c/d", "b:", "//c/d"), ("://h/p", "h", "/p"), ("http:///p", "", "/p"), ("http://É.com/é", "É.com", "/é"),
]


def test_host_and_path(spark):
    got = judged(spark, [(url, None) for url, _, _ in URLS])
    assert [(got[i].host, got[i].path) for i in range(len(URLS))] == [(host, path) for _, host, path in URLS]


def test_longest_rule_wins(spark):
    got = judged(spark, [(u, "") for u in (
        "http://example.net/en/1", "http://www.example.net/fr/", "http://a.net/", "http://net/", "http://b.net", "http://example.com/de/x", "http://x.example.com/de",
        "http://myexample.com/de/x", "http://a.org/fr/x", "http://example.org/en/")])
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "net/", "net/", "net/", None, "example.com/de/", None, None, "org/fr/", None]
    assert [got[i].verdict for i in range(10)] == ["allow", "block", "block", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def brute(seeds, links, damping, rounds):
    """The same by dictionaries."""
    out = {}
    for kind, flip in (("trust", False), ("distrust", True)):
        total = {}
        for (s, _), n in links.items():
            total[s] = total.get(s, 0) + n
        edges = [(t, s, n / total[s]) if flip else (s, t, n / total[s]) for (s, t), n in links.items()]
        value = dict(seeds[kind])
        for _ in range(rounds):
            new = dict(seeds[kind])
            for s, t, share in edges:
                if s in value:
                    new[t] = new.get(t, 0) + damping * value[s] * share
            value = new
        out[kind] = value
    return out


def test_propagation_against_brute_force(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">x</a>' for h in hosts)
    rules = [Rule("allow", "good.org", "/"), Rule("block", "bad.com", "/")]
    rows = [("http://good.org/", link("B.x", "b.x", "c.x") + '<a href="/local">'), ("http://b.x/1", link("c.x", "good.org")), ("http://farm.x/1", link("bad.com") * 3),
            ("http://feeder.x/1", link("farm.x")), ("http://bad.com/1", link("c.x")), ("http://c.x/1", "<img src='//farm.x/i.png'>"), ("http://alone.x/", None), (None, link("farm.x"))]
    links = {("good.org", "b.x"): 2, ("good.org", "c.x"): 1, ("b.x", "c.x"): 1, ("b.x", "good.org"): 1, ("farm.x", "bad.com"): 3, ("feeder.x", "farm.x"): 1,
             ("bad.com", "c.x"): 1, ("c.x", "farm.x"): 1}
    want = brute({"trust": {"good.org": 1.0}, "distrust": {"bad.com": 1.0}}, links, urls.DAMPING, urls.ROUNDS)
    got = judged(spark, rows, rules, threshold=0.1)
    for r in got.values():
        assert r.trust == pytest.approx(want["trust"].get(r.host, 0.0)) and r.distrust == pytest.approx(want["distrust"].get(r.host, 0.0))
        if r.rule is None:
            assert r.verdict == ("block" if r.host and r.distrust - r.trust >= 0.1 else "allow")
    assert got[3].verdict == "block" and got[1].verdict == got[6].verdict == got[7].verdict == "allow"


@pytest.mark.parametrize("linkers", [1, 2, 10, 100])
def test_many_linkers_to_one_blocked_host(spark, linkers):
    """At the production threshold: hosts that link nowhere else are blocked however many there are, one with mostly other links is not."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [("http://bad.com/", None), *[(f"http://farm{i}.x/", link("bad.com")) for i in range(linkers)], ("http://news.x/", link("bad.com", "a.x", "b.x", "c.x"))]
    got = judged(spark, rows, [Rule("block", "bad.com", "/")])
    assert [got[i].verdict for i in range(1, linkers + 2)] == ["block"] * linkers + ["allow"]


def test_clashing_columns_repeats_and_empty_table(spark):
    table = spark.createDataFrame([(1, "http://a.net/x", None, "h", 5)] * 3, "page_id bigint, url string, html string, host string, trust int")
    got = urls.judge(table, URL_RULES).collect()
    assert len(got) == 3 and {(r.host, r.verdict) for r in got} == {("a.net", "block")}
    assert urls.judge(table.limit(0), URL_RULES).count() == 0


def test_no_python_in_the_plan(spark):
    plan = urls.judge(pages(spark, [("http://a/", "")]), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)
