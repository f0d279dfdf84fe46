import random
import re
from collections import Counter, defaultdict

import pytest

from sparkgraft.llm import urlfilter
from sparkgraft.llm.queries import URL_RULES

COLUMNS = "page_id long, url string, html string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_for(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def plain(pages, rules, rounds=12):
    """Rules by trial, ranks by plain loops over hosts."""
    rows = [(i, *parts(u), h or "") for i, u, h in pages]
    count, trust, distrust, links = Counter(), Counter(), Counter(), set()
    for _, host, path, html in rows:
        if not host:
            continue
        r = rule_for(host, path, rules)
        count[host] += 1
        trust[host] += 1_000_000 * (r is not None and r.verdict == "allow")
        distrust[host] += 1_000_000 * (r is not None and r.verdict == "block")
        for m in re.findall(r"""href=["']?(?:https?:)?//([^/?#"'<>\x00-\x20]+)""", html, re.I):
            if m.lower() != host:
                links.add((host, m.lower()))

    def rank(seeds, edges):
        out = defaultdict(list)
        for a, b in edges:
            out[a].append(b)
        mass = dict(seeds)
        for _ in range(rounds):
            new = Counter({h: m * 15 // 100 for h, m in seeds.items()})
            for h, m in mass.items():
                for b in out[h]:
                    new[b] += m * 85 // (100 * len(out[h]))
            mass = new
        return mass

    good, bad = rank(trust, links), rank(distrust, {(b, a) for a, b in links})
    if not links:
        good, bad = ({h: m * 15 // 100 for h, m in s.items()} for s in (trust, distrust))
    out = []
    for i, host, path, _ in rows:
        r = rule_for(host, path, rules)
        spread = "block" if host and 2 * (bad.get(host, 0) - good.get(host, 0)) > count[host] * 150_000 else "allow"
        out.append((i, host, path, r and r.name, r.verdict if r else spread))
    return sorted(out, key=str)


def run(spark, pages, **more):
    df = spark.createDataFrame(pages, COLUMNS).selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS salt", "2 AS trust")
    return sorted((tuple(r) for r in urlfilter.judge(spark, df, URL_RULES, **more).collect()), key=str)


@pytest.mark.parametrize("few", [100_000, 0], ids=["broadcast", "dealt in parts"])
def test_against_plain_ranks(spark, few):
    pick = random.Random(9)
    hosts = [f"h{i}.{pick.choice(['org', 'net', 'net', 'com'])}" for i in range(40)]
    pages = []
    for i in range(300):
        host, path = pick.choice(hosts), pick.choice(["/", "/es/2", "/es/3", "/fr/3", "/de/4?x#y", ""])
        links = "".join(f'<a class=x href="https://{pick.choice(hosts).upper()}/p?q">x</a><a href=/own>' for _ in range(pick.randrange(3)))
        pages.append((i, f"http://{host}{path}", f"<body>{links}</body>"))
    pages += [(900, None, None), (901, "no scheme", "<a href='//h1.org/'>"), (902, "HTTP://H1.ORG", None), (903, "x://a.net/es/?://b", None), (None, "http://h2.org/x", "")] * 2
    want = plain(pages, URL_RULES)
    assert run(spark, pages, few_hosts=few) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}


def test_distrust_goes_against_links_and_trust_along(spark):
    farm = [(i, f"http://farm{i}.org/x", "<a href='http://bad.net/es/'>") for i in range(3)]
    bad = [(10 + i, f"http://bad.net/es/{i}", "") for i in range(30)] + [(50, "http://bad.net/other", "")]
    good = [(60 + i, f"http://good.com/{i}", "<a href=//farm0.org/>") for i in range(30)]
    verdicts = {r[0]: r[4] for r in run(spark, farm + bad + good)}
    assert [verdicts[i] for i in (0, 1, 2, 50)] == ["allow", "block", "block", "allow"]  # trust goes on by the first farm
    verdicts = {r[0]: r[4] for r in run(spark, farm + bad)}
    assert [verdicts[i] for i in (0, 1, 2, 50)] == ["block"] * 4


def test_rules(spark):
    urls = ["http://com/", "http://a.com/x", "http://acom/", "http://example.com/en/", "http://example.com/en", "http://www.example.com/en/1", "http://x.www.example.com/en/1", "http://a.net/fr/", "http://a.net:80/fr/", "http://A.NET/ES/", "http://a.com?x", "http://a.com#/en/"]
    got = {r[0]: (r[3], r[4]) for r in run(spark, [(i, u, None) for i, u in enumerate(urls)])}
    want = ["com/", "com/", None, "example.com/en/", "com/", "www.example.com/en/", "www.example.com/en/", "net/fr/", None, None, None, None]
    assert [got[i][0] for i in range(len(urls))] == want
    assert run(spark, []) == []
