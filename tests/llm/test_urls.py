import random

import pytest
from pyspark.sql import functions as F

from routeloom.llm import urls

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (
            "http://A.Example.COM/en/7?x=/y#z", "a.example.com", "/en/7"
        ), ("https://h", "h", ""), ("x://h?q", "h", ""), ("x://h#/f", "h", ""), ("://h/p", "h", "/p"),
        ("a://b://c", "b:", "//c"), ("no scheme", "", ""), (None, "", ""), ("", "", ""), ("x://", "", ""), ("x:///p", "", "/p"), ("x://É.com/É#", "É.com", "/É"), (
            "x://u@h:80/p", "u@h:80", "/p"
        ),
    ],
)
def test_host_and_path(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(
        urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    ).first()
    assert tuple(row) == (host, path)


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("x://b.example.com/en/6", "com/en/", "block"), (
            "x://b.example.com/en/71", "example.com/en/7", "allow"
        ), ("x://badexample.com/en/7", "com/en/", "block"), ("x://com/en/", "com/en/", "block"),
        ("x://telecom/en/", None, "allow"), ("x://a.net/de/1", "net/de/", "allow"), (
            "x://example.net/de/80", "example.net/de/8", "block"
        ), ("x://a.org/es/", "org/es/", "block"), ("x://a.org/es", None, "allow"), ("x://a.org/en/es/", None, "allow"),
    ],
)
def test_longest_rule_wins(spark, url, rule, verdict):
    row = urls.judge_urls(spark.createDataFrame([(1, url, None)], PAGES)).first()
    assert row["rule"] == rule
    assert row["verdict"] == verdict


def brute(pages, rules=urls.RULES, damping=urls.DAMPING):
    """Walks by dictionaries, to compare with."""
    import re

    rows = []
    for page, url, html in pages:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = max(
            (r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])),
            key=lambda r: len(r[0] + r[1]),
            default=None,
        )
        out = {
            m.split("://", 1)[1].split("/")[0].lower()
            for m in re.findall(r'href="([^"\s]*)"', html or "") if "://" in m
        }
        rows.append((page, host, path, fit, out - {""}))
    hosts = {h for _, h, _, _, _ in rows if h}
    seeds = {
        h: [
            sum(bool(f) and f[2] == v for _, x, _, f, _ in rows if x == h) / sum(x == h for _, x, _, _, _ in rows)
            for v in ("allow", "block")
        ]
        for h in hosts
    }
    links = {}
    for _, h, _, _, out in rows:
        for d in out if h else ():
            if d != h:
                links[h, d] = links.get((h, d), 0) + 1
    every = hosts | {x for pair in links for x in pair}
    seeds = {h: seeds.get(h, [0, 0]) for h in every}
    given = {h: sum(n for (a, _), n in links.items() if a == h) for h in every}
    taken = {h: sum(n for (_, b), n in links.items() if b == h) for h in every}
    trust, distrust = ({h: (1 - damping) * seeds[h][k] for h in every} for k in (0, 1))
    for _ in range(300):  # far beyond the tolerance
        trust, distrust = (
            {
                h: (1 - damping) * seeds[h][0] + damping * sum(
                    trust[a] * n / given[a] for (a, b), n in links.items() if b == h
                )
                for h in every
            },
            {
                h: (1 - damping) * seeds[h][1] + damping * sum(
                    distrust[b] * n / taken[b] for (a, b), n in links.items() if a == h
                )
                for h in every
            },
        )
    blocked = {
        h: distrust[h] >= urls.BLOCK_SHARE * (trust[h] + distrust[h] + (1 - damping) * (1 - sum(seeds[h]))) - urls.SLACK
        for h in every
    }
    return {
        p: (
            h,
            path,
            f and f[0] + f[1],
            f[2] if f else "block" if blocked.get(h) else "allow",
            round(trust.get(h, 0), 4),
            round(distrust.get(h, 0), 4),
        )
        for p, h, path, f, _ in rows
    }


def web(seed, n=120):
    rng = random.Random(seed)
    hosts = [f"{k}.example.{t}" for k in range(8) for t in ("com", "net", "org")]
    pages = []
    for k in range(n):
        host = rng.choice(hosts + hosts[:1] * 20)  # one host has half of all pages
        targets = rng.choices(hosts + ["elsewhere.test"], k=rng.randint(0, 4))
        html = "".join(
            f'<a href="https://{t.upper() if rng.random() < 0.2 else t}/x">x</a>' for t in targets
        ) + '<a href="/local">l</a>'
        pages.append((k, f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}", html))
    return pages


@pytest.mark.parametrize("seed", [1])
def test_walks_equal_brute_force(spark, seed):
    pages = web(seed)
    got = urls.judge_urls(spark.createDataFrame(pages, PAGES)).collect()
    want = brute(pages)
    assert {
        r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], round(r["trust"], 4), round(r["distrust"], 4))
        for r in got
    } == want
    assert len({v[3] for v in want.values()}) == 2


def test_query_walks_cycles_hubs_and_dangling_hosts_as_its_sql_does(spark, monkeypatch):
    """A ring of hosts fed by a trusted one, a hub that all link to, and hosts without links out, to convergence."""
    import duckdb

    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    ring = [f"r{k}.test" for k in range(5)]
    pages = [(k, f"http://{h}/p", link(ring[(k + 1) % 5])) for k, h in enumerate(ring)]
    pages += [(10, "http://good.net/de/1", link(ring[0], "hub.test")), (11, "http://bad.org/es/1", link("hub.test"))]
    pages += [(20 + k, f"http://leaf{k}.test/", link("hub.test", "bad.org")) for k in range(6)]
    pages += [(30, "http://hub.test/", link("good.net", "bad.org", "end.test")), (31, "http://end.test/", None)]
    df = spark.createDataFrame(pages, PAGES)
    monkeypatch.setattr(urls, "table", lambda s, d, n: df)
    got = {r["page_id"]: tuple(r) for r in urls.op1_urls(spark, "").collect()}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert {r[0]: r for r in con.execute(urls.OP1_SQL).fetchall()} == got
    want = brute(pages)
    assert {k: v[1:] for k, v in got.items()} == want
    assert sum(v[5] for k, v in got.items() if k < 5) > 0.2  # trust has gone round the ring many times
    assert urls.DAMPING ** urls.rounds_needed() <= urls.TOLERANCE


def test_distrust_goes_against_links_and_trust_along(spark):
    bad = [(k, "x://spam.org/es/", None) for k in range(4)]
    good = [(k + 10, "x://fine.net/de/", '<a href="x://friend.test/">f</a>') for k in range(4)]
    farm = [
        (20, "x://farm.test/", '<a href="x://spam.org/">a</a>'),
        (21, "x://friend.test/", None),
        (22, "x://spam.org/other", '<a href="x://victim.test/">v</a>'),
        (23, "x://victim.test/", None),
    ]
    got = {
        r["page_id"]: r
        for r in urls.judge_urls(spark.createDataFrame(bad + good + farm, PAGES), block_share=0.4).collect()
    }
    assert got[20]["verdict"] == "block" and got[20]["distrust"] > 0 and got[22]["verdict"] == "block"
    assert got[21]["trust"] > 0 and got[21]["verdict"] == "allow" and got[23]["verdict"] == "allow" and got[23]["distrust"] == 0


def test_odd_rows(spark):
    rows = [
        (1, None, None),
        (None, "x://a.org/es/1", None),
        (3, "nothing", '<a href="x://a.org/">'),
        (4, "x://a.org/es/1", ""),
        (4, "x://a.org/es/1", ""),
        (5, "x://" + "a" * 100_000 + "/p", "<a href=" + "x" * 100_000),
    ]
    pages = spark.createDataFrame(rows, PAGES).select(
        "*", *[F.lit("own").alias(c) for c in ("HOST", "rule", "__rule", "trust", "src")]
    )
    got = urls.judge_urls(pages).collect()
    assert len(got) == 6 and sorted(r["verdict"] for r in got) == ["allow"] * 3 + ["block"] * 3
    assert all(r["src"] == "own" for r in got)
    none = urls.judge_urls(spark.createDataFrame([], PAGES))
    assert none.count() == 0 and "verdict" in none.columns


def test_too_many_rules():
    with pytest.raises(ValueError, match="at most"):
        urls.rule_of(None, None, urls.RULES * 1000)
