"""URL filter: rules against plain Python, ranks against power iteration, verdicts of unruled hosts."""

import pytest

from acct_health.llm.url_filter import DAMPING, RULES, judge_urls, propagate

URLS = [None, "", "no scheme", "http://", "http://com/", "https://a.com", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://sub.example.com/en/a/b",
        "http://notexample.com/en/", "http://www.example.com/fr/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/#top", "http://x.net/en/", "http://x.org/es/",
        "a://b://c.com/x", "http://com", "http://a.com?/x", "http://É.com/É", "ftp://user@x.com:80/", "http://x.net/fr/a\nb"]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    cut = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def _rule(host, path, rules=RULES):
    fits = [(len(r), r.index("/"), a, r) for a, r in rules
            if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
    return max(fits)[2:] if fits else (None, None)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "'p' as path", "1 as rule", "2 as trust")


@pytest.mark.parametrize("limit", [1000, 0])
def test_rules(spark, limit):
    rows = [(i, u, "<p>no links</p>") for i, u in enumerate(URLS)] + [(0, URLS[7], None), (None, URLS[11], "")]
    got = judge_urls(_pages(spark, rows), RULES, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        options = [u for i, u, _ in rows if i == r.page_id]
        assert any((r.host, r.path) == _parts(u) for u in options)
        action, rule = _rule(r.host, r.path)
        assert r.rule == rule and (action is None or r.verdict == action)
    assert judge_urls(_pages(spark, rows).where("false"), RULES).count() == 0
    assert {r.verdict for r in judge_urls(_pages(spark, rows), []).collect()} == {"allow"}


def _power(seeds, edges, reverse):
    out, ranks = {}, {h: (1 - DAMPING) * s for h, s in seeds.items()}
    for a, b, n in edges:
        a, b = (b, a) if reverse else (a, b)
        out.setdefault(a, []).append((b, n))
    for _ in range(200):
        new = {h: (1 - DAMPING) * s for h, s in seeds.items()}
        for a, to in out.items():
            for b, n in to:
                new[b] += DAMPING * ranks[a] * n / sum(k for _, k in to)
        ranks = new
    return ranks


def test_ranks(spark):
    edges = [("a", "b", 3), ("b", "c", 1), ("c", "a", 2), ("a", "c", 1), ("d", "c", 5), ("c", "d", 1), ("d", "e", 1)]
    trust, distrust = {"a": 1.0, "b": 0.0, "c": 0.25, "d": 0.0, "e": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0}
    seeds = spark.createDataFrame([(h, trust[h], distrust[h]) for h in "abcd"], "host string, trust double, distrust double")
    seeds = seeds.unionByName(spark.createDataFrame([("e", 0.0, 1.0)], seeds.schema))
    got = {r.host: (r.trust, r.distrust) for r in propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n long"), 100).collect()}
    want_t, want_d = _power(trust, edges, False), _power(distrust, edges, True)
    for h in "abcde":
        assert got[h] == pytest.approx((want_t[h], want_d[h]), abs=1e-4)


def test_hosts_that_link_to_blocked_ones(spark):
    link = lambda *hosts: "".join(f'<a href="{h}">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/fr/2", link("//other.org/")), (3, "http://farm.org/1", link("http://bad.net/x", "http://BAD.net/y", "/own", "#top")),
            (4, "http://good.com/", link("https://fine.org/a")), (5, "http://fine.org/", link("http://bad.net/")), (6, "http://alone.org/", link("relative.html"))]
    got = {r.page_id: r for r in judge_urls(_pages(spark, rows), RULES).collect()}
    assert [got[i].verdict for i in (1, 2, 4)] == ["block", "block", "allow"]
    assert got[3].distrust > got[3].trust == 0 and got[5].trust > 0
    assert got[6].verdict == "allow"
    # farm.org links to nothing but a blocked host
    assert got[3].verdict == "block"


def test_distrust_along_a_long_chain(spark):
    """Forty blocked hosts in a chain, and ten hosts that link to its first: the ranks have to converge."""
    blocked = [("block", f"b{i}.bad/") for i in range(40)]
    page = lambda i, host, to: (i, f"http://{host}/", f'<a href="http://{to}/x">' if to else None)
    rows = [page(i, f"b{i}.bad", f"b{i + 1}.bad" if i < 39 else None) for i in range(40)]
    rows += [page(100 + i, f"farm{i}.org", "b0.bad") for i in range(10)]
    verdicts = {r.page_id: r.verdict for r in judge_urls(_pages(spark, rows), blocked).collect()}
    seed, rank = 1 - DAMPING, 1 - DAMPING  # the chain's first host gets what the others' seeds hand down to it
    for _ in range(39):
        rank = seed + DAMPING * rank
    farm = DAMPING * rank / 10
    assert farm > seed * 0.5  # and the farms are blocked for it
    assert set(verdicts.values()) == {"block"}
