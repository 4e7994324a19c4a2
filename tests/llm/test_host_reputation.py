import math
import random

import pytest
from pyspark.sql import functions as F

from pokerlake.llm import host_reputation as hr

RULES = [("block", "net/"), ("allow", "Example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, b, "x", "x", "x") for i, u, b in rows], "page_id long, url string, bad boolean, host string, path string, rules string")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path


def ruled(host, path):
    fits = []
    for action, rule in RULES:
        at, slash, rest = rule.lower().partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://X.Example.NET", "https://example.net/en/1", "https://a.b.example.net/en/?x#y", "https://example.net/de/1",
    "https://badexample.net/en/3", "http://example.com/de/", "http://w.example.com/de", "http://example.com/DE/1", "http://a.org/fr/2", "http://.org/fr/2",
    "http://org/fr/", "ftp://user@Host.co.uk:80/a b?c", "x://É.com/ü://y", "http://a?q/x://b", "http://net#/x", "http://net/\nx", "http://" + "a." * 3000 + "net/" + "p" * 9000,
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://net/", False), (5, "http://net/", False), (5, "http://net/", False)]
    got = hr.filter_urls(pages(spark, rows), RULES).collect()
    want = []
    for i, u, _ in rows:
        host, path = parts(u)
        rule, action = ruled(host, path)
        want.append((i, host, path, rule, action or "allow"))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(want, key=str)


def test_equal_lengths_prefer_the_longer_host_then_a_block(spark):
    rules = [("allow", "b.net/"), ("block", "net/xy"), ("block", "a.b.net/z"), ("allow", "a.b.net/z")]
    got = hr.filter_urls(pages(spark, [(1, "x://a.b.net/xyz", None), (2, "x://a.b.net/zz", None)]), rules).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "b.net/", "allow"), (2, "a.b.net/z", "block")}
    with pytest.raises(ValueError):
        hr.rule_table(spark, [("deny", "net/")])


def beta_above(a, b, limit, n=400_000):
    """The midpoint rule on the plain scale, for parameters above 1."""
    xs = [(i + 0.5) / n for i in range(n)]
    top = max((a - 1) * math.log(x) + (b - 1) * math.log(1 - x) for x in (xs[0], max(1e-9, (a - 1) / max(a + b - 2, 1e-9)), xs[-1]) if 0 < x < 1)
    f = [math.exp((a - 1) * math.log(x) + (b - 1) * math.log(1 - x) - top) for x in xs]
    return sum(y for x, y in zip(xs, f, strict=True) if x > limit) / sum(f)


def test_probability_above_the_limit(spark):
    for a, b, limit in [(3.0, 2.0, 0.5), (40.0, 21.5, 0.5), (1.0, 1.0, 0.25), (900.0, 1000.0, 0.5), (2.0, 30.0, 0.1)]:
        df = spark.createDataFrame([(a, b)], "a double, b double")
        got = df.select(hr.above_limit(df.a, df.b, limit)).first()[0]
        assert got == pytest.approx(beta_above(a, b, limit, 60_000), abs=2e-4)
    tiny = spark.createDataFrame([(0.01, 0.02), (0.3, 4000.0), (1e7, 1e7)], "a double, b double")
    assert [round(r[0], 3) for r in tiny.select(hr.above_limit(tiny.a, tiny.b)).collect()] == [0.333, 0.0, 0.5]


def expected_reputation(rows, limit):
    """Plain loops: host -> (n, k, prior mean, a, b)."""
    hosts = {}
    for _, url, bad in rows:
        n, k = hosts.get(parts(url)[0], (0, 0))
        hosts[parts(url)[0]] = (n + (bad is not None), k + bool(bad))
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}

    def summed(items, up):
        out = {}
        for name, (n, k) in items.items():
            a, b = out.get(up(name), (0, 0))
            out[up(name)] = (a + n, b + k)
        return out

    domains = summed(hosts, domain.get)
    suffixes = summed(domains, lambda d: d.split(".")[-1])
    total = summed(suffixes, lambda _: "")[""]
    overall = (total[1] + 0.5) / (total[0] + 1)

    def strength(items, mean):
        more = sum(n * (n - 1) * mean[c] * (1 - mean[c]) for c, (n, k) in items.items())
        spread = sum((k - n * mean[c]) ** 2 - n * mean[c] * (1 - mean[c]) for c, (n, k) in items.items()) / more if more else 1 / 3
        return 1 / min(max(spread, 1 / 1001), 1 / 3) - 1

    w = strength(suffixes, dict.fromkeys(suffixes, overall))
    mean_d = {}
    for d, (n, k) in domains.items():
        up = suffixes[d.split(".")[-1]]
        mean_d[d] = (up[1] - k + w * overall) / (up[0] - n + w)
    w = strength(domains, mean_d)
    mean = {h: (domains[domain[h]][1] - k + w * mean_d[domain[h]]) / (domains[domain[h]][0] - n + w) for h, (n, k) in hosts.items()}
    w = strength(hosts, mean)
    return {h: (n, k, mean[h], mean[h] * w + k, (1 - mean[h]) * w + n - k) for h, (n, k) in hosts.items()}


def test_reputation_equals_plain_loops(spark):
    draw = random.Random(4)
    rows = []
    for d in range(6):
        rate = draw.random() * 0.4
        for h in range(5):
            own = 0.95 if (d, h) == (2, 3) else rate
            for _ in range(draw.randint(0, 40) if (d, h) != (2, 3) else 60):
                rows.append((len(rows), f"http://h{h}.d{d}.{'com' if d % 2 else 'org'}/p", None if draw.random() < 0.2 else draw.random() < own))
    rows.append((None, None, True))
    df = pages(spark, rows).select(hr.host_of(F.col("url")).alias("host"), "bad")
    found = {r.host: r for r in hr.reputations(df).collect()}
    want = expected_reputation(rows, 0.5)
    assert found.keys() == want.keys()
    for host, (n, k, mean, a, b) in want.items():
        r = found[host]
        assert (r.n, r.k) == (n, k)
        assert [r.prior_mean, r.a, r.b] == pytest.approx([mean, a, b])
    blocked = {r.host for r in hr.filter_urls(pages(spark, rows), []).collect() if r.verdict == "block"}
    assert blocked == {"h3.d2.org"}


def test_domains(spark):
    hosts = ["", "localhost", "a.b.com", "com", "x.y.co.uk", "co.uk", "me@a.b.com:8080", "10.0.0.1", "10.0.0.1:80", "a..com"]
    got = {r.host: (r.domain, r.suffix) for r in hr.with_domain(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {
        "": ("", ""), "localhost": ("localhost", "localhost"), "a.b.com": ("b.com", "com"), "com": ("com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"), "me@a.b.com:8080": ("b.com", "com"), "10.0.0.1": ("10.0.0.1", ""), "10.0.0.1:80": ("10.0.0.1", ""), "a..com": (".com", "com"),
    }


def test_outcomes_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "http://a.com/en/7.html"), (2, "http://a.com/en/8?x"), (3, "http://a.com/x"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, None, 1), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.page_id: r.bad for r in hr.outcomes_of(table, labels).collect()} == {1: True, 2: False, 3: None, 4: None}
    assert hr.outcomes_of(table, labels.limit(0)).filter("bad is not null").count() == 0
    assert hr.filter_urls(pages(spark, []), RULES).collect() == []
    assert len(hr.filter_urls(hr.outcomes_of(table, labels.limit(0)), []).collect()) == 4
