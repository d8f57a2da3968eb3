import numpy as np
import pytest

from quillmark.llm import linkgraph

GOOD, BAD = "http://example.net/en/", "http://bad.net/"


def judged(spark, links, seeds=(GOOD, BAD)):
    """Verdict, trust and distrust by host, of hosts h<i>.info and seeds that link as `links` (src url, dst url) says."""
    urls = sorted({u for link in links for u in link} | {*seeds})
    pages = [(i, u, " ".join(f'<a href="{b}">' for a, b in links if a == u)) for i, u in enumerate(urls)]
    got = linkgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return {r.host: (r.verdict, r.trust, r.distrust) for r in got}


def exact(links, seed, damping=0.85):
    """Solves the PageRank equations, ranks of hosts without out-links going back to the seed."""
    names = sorted({x for link in links for x in link} | {seed})
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    p = np.zeros((n, n))
    for a, b in links:
        p[at[a], at[b]] += 1
    s = np.eye(n)[at[seed]]
    p = np.array([row / row.sum() if row.sum() else s for row in p])
    return dict(zip(names, np.linalg.solve(np.eye(n) - damping * p.T, (1 - damping) * s)))


def host(url):
    return url.split("/")[2]


def agrees(got, links):
    links = [(host(a), host(b)) for a, b in links if host(a) != host(b)]
    trust, distrust = exact(links, "example.net"), exact([(b, a) for a, b in links], "bad.net")
    for h, (verdict, t, d) in got.items():
        assert t == pytest.approx(trust.get(h, 0), rel=1e-6, abs=0) and d == pytest.approx(distrust.get(h, 0), rel=1e-6, abs=0)
        if h.startswith("h"):
            assert verdict == ("block" if distrust.get(h, 0) > trust.get(h, 0) else "allow")


def test_a_chain_of_more_than_eight_hosts_is_blocked_to_its_end(spark):
    chain = [*(f"http://h{i}.info/" for i in range(14)), BAD]
    links = list(zip(chain, chain[1:]))
    got = judged(spark, links)
    assert all(got[f"h{i}.info"][0] == "block" for i in range(14))
    agrees(got, links)


def test_graph_with_sinks_and_cycles_against_brute_force(spark):
    rng = np.random.default_rng(2)
    h = [f"http://h{i}.info/" for i in range(12)]
    links = [(h[a], h[b]) for a, b in zip(rng.integers(0, 8, 22), rng.integers(0, 12, 22)) if a != b]  # 8 to 11 are sinks
    links += [(GOOD, h[0]), (GOOD, h[9]), (h[1], BAD), (h[4], BAD), (h[3], GOOD)]
    got = judged(spark, links)
    agrees(got, links)
    assert {v[0] for k, v in got.items() if k.startswith("h")} == {"allow", "block"}
