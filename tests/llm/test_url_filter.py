"""Page outcomes and posteriors of hosts against plain Python."""

import collections
import math
import random
import re

import pytest

from turnstore.llm import url_filter

RND = random.Random(8)


def test_page_outcomes(spark):
    htmls = [None, "", "<p> \n</p>", "<p>fine text here</p>", "<b>#$%&|</b> ok", "a" * 19 + "#", "a" * 20 + "#", "&amp;&lt;#",
             "<script>###</script>words <style a='b'>$$$\n$$</style>more", "x < y ### <unclosed", "tab\there#", "###", "a!" * 30]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, h in enumerate(htmls)] + [(99, None, "x")], "page_id long, url string, html string")
    expected = {"": 0}
    for i, html in enumerate(htmls):
        if html is None:
            expected[f"h{i}.org"] = None
            continue
        plain = re.sub(r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ", html)
        plain = re.sub("&[a-z]+;", " ", re.sub("<[^>]*>", " ", plain))
        n = len(re.sub("[ \t\r\n]", "", plain))
        symbols = len(re.findall("[#*$%&|<>!]", plain))
        expected[f"h{i}.org"] = int(20 * symbols >= n) if n else None
    assert {r.host: r.bad for r in url_filter.page_outcomes(pages).collect()} == expected


def brute(rows):
    """Posterior mean and bound of every host."""
    hosts = collections.defaultdict(lambda: [0, 0])
    for host, bad in rows:
        hosts[host][0] += 1
        hosts[host][1] += bad

    def up(members, key):
        out, sizes = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(list)
        for name, (n, bad) in members.items():
            out[key(name)][0] += n
            out[key(name)][1] += bad
            sizes[key(name)].append((n, bad))
        return dict(out), sizes

    def strength(members):
        n, bad, k = sum(m[0] for m in members), sum(m[1] for m in members), len(members)
        if k == 1:
            return 10.0
        p = bad / n
        noise = p * (1 - p)
        room = (n - sum(m[0] ** 2 for m in members) / n - (k - 1)) * noise
        rho = (sum(b * b / m for m, b in members) - p * bad - (k - 1) * noise) / room if room > 0 else 0
        return min(1000.0, max(1.0, round(1 / rho - 1, 6))) if room > 0 and rho > 0 else 1000.0

    domain_of = lambda h: ".".join(h.split(".")[-2:])
    domains, by_domain = up(hosts, domain_of)
    suffixes, by_suffix = up(domains, lambda d: d.split(".")[-1])
    n, bad = sum(x[0] for x in suffixes.values()), sum(x[1] for x in suffixes.values())
    mean, size, found = (1 + bad) / (2 + n), strength(list(suffixes.values())), {}
    for host, (n, bad) in hosts.items():
        m, s = mean, size
        for level, members, name in ((suffixes, by_suffix, host.split(".")[-1]), (domains, by_domain, domain_of(host))):
            m, s = (s * m + level[name][1]) / (s + level[name][0]), strength(members[name])
        post = (s * m + bad) / (s + n)
        found[host] = (n, bad, post, post - url_filter.BOUND_SD * math.sqrt(post * (1 - post) / (s + n + 1)))
    return found


def test_posteriors(spark):
    rate = {f"d{d}.{s}": RND.random() for d in range(6) for s in ("org", "net", "info")}
    rows = [(f"h{RND.randrange(4)}.{d}", int(RND.random() < r)) for d, r in rate.items() for _ in range(RND.randrange(1, 60))]
    rows += [("lonely.one", 1), ("a.only.biz", 0), ("b.only.biz", 0)]
    found = {r.host: (r.n, r.bad, r.mean, r.low) for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    expected = brute(rows)
    assert found.keys() == expected.keys()
    for host, values in expected.items():
        assert found[host] == pytest.approx(values, abs=1e-9), host


def test_limit_follows_the_rate_of_all_pages(spark):
    # One page in twenty is bad, and one host surely more often: blocked far below a rate of one half.
    rows = [(f"h{i % 40}.d{i % 8}.org", int(i % 20 == 0)) for i in range(4000)] + [("worse.d1.org", int(i % 4 == 0)) for i in range(400)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    pages = spark.createDataFrame([(0, "http://worse.d1.org/"), (1, "http://h3.d3.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes).collect()} == {0: "block", 1: "allow"}
    assert {r.verdict for r in url_filter.judge(pages, outcomes, bad_rate=0.5).collect()} == {"allow"}
