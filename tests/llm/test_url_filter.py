"""URL filter: rules and trees against a brute-force version; held-out accuracy on a made-up labelling."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlens.llm import queries
from revlens.llm import url_filter as uf
from tests.conftest import SF001


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    return host, rest[end:].split("?")[0].split("#")[0] if end < len(rest) and rest[end] == "/" else ""


def rule_of(host, path, rules=uf.RULES):
    fits = [(len(r), r, v) for v, r in rules
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.find("/"):])]
    return max(fits)[1:] if fits else (None, None)


def features(url):
    url = url or ""
    host, path = parts(url)
    n, c = len(url), Counter(url)
    bits = -sum(c[x] / n * math.log2(c[x] / n) for x in sorted(c))
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    return [n, len(host), len(path), len([s for s in path.split("/") if s]), host.count(".") + 1 if host else 0, host.count("-"),
            sum(x in "0123456789" for x in url) * 1000 // n if n else 0, math.floor(bits * 1000 + 0.5), query.count("&") + 1 if query else 0]


def half_up(x):
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)


def brute(rows):
    """(host, path, rule, verdict) of (id, url) rows, all of the labelled ones being used."""
    facts = [(k, *parts(u), *rule_of(*parts(u)), features(u)) for k, u in rows]
    known = [(f, h.split(".")[-1], int(v == "block")) for _, h, _, _, v, f in facts if v]
    y = np.array([k[2] for k in known])
    prior, stats = y.mean(), defaultdict(lambda: [0, 0])
    for _, s, b in known:
        stats[s][0] += 1
        stats[s][1] += b
    share = lambda b, n: half_up((b + prior * uf.PRIOR_ROWS) * 1000 / (n + uf.PRIOR_ROWS))
    x = np.array([f + [stats[s][0], share(stats[s][1] - b, stats[s][0] - 1)] for f, s, b in known], float)
    cuts = [sorted(set(np.quantile(x[:, i], [j / uf.BINS for j in range(1, uf.BINS)]).tolist())) for i in range(x.shape[1])]
    all_x = np.array([f + [stats[h.split(".")[-1]][0], share(*stats[h.split(".")[-1]][::-1])] for _, h, _, _, _, f in facts], float)
    margin, result = np.full(len(x), math.log(prior / (1 - prior))), np.full(len(all_x), math.log(prior / (1 - prior)))

    def grow(mine, theirs, depth):
        """Adds leaf weights to both margins."""
        sums = {}
        for i, own in enumerate(cuts):
            at = np.searchsorted(own, x[mine, i], "left")
            for b in range(len(own) + 1):
                sel = at == b
                sums[i, b] = (int(g[mine][sel].sum()), int(h[mine][sel].sum()), int(sel.sum()))
        split = uf.best_split(sums, cuts) if depth else None
        if split is None:
            w = 0.0 if depth == uf.DEPTH else -uf.RATE * g[mine].sum() / (h[mine].sum() + uf.RIDGE * uf.UNIT)
            margin[mine] += w
            result[theirs] += w
            return
        f, b = split
        low, other = x[mine, f] <= cuts[f][b], all_x[theirs, f] <= cuts[f][b]
        grow(mine[low], theirs[other], depth - 1)
        grow(mine[~low], theirs[~other], depth - 1)

    for _ in range(uf.ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.array([half_up(v * uf.UNIT) for v in z]) for z in (p - y, p * (1 - p)))
        grow(np.arange(len(x)), np.arange(len(all_x)), uf.DEPTH)
    return {k: (h, p, r, v or ("block" if m >= 0 else "allow")) for (k, h, p, r, v, _), m in zip(facts, result)}


def test_query_against_brute_force(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.QUERIES["op3_url_filter"](spark, SF001).collect()}
    assert got == brute(rows)


def test_plan_has_no_python(spark):
    plan = queries.QUERIES["op3_url_filter"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def url_of(i):
    spam = i % 3 == 0
    host = f"{'win-' * (1 + i % 3) if spam else ''}site{i * 7919 % 97}.{['com', 'org', 'biz'][i % 7 % 3]}"
    return f"https://{host}/{'/'.join(['p'] * (i % 4))}{i * 104729 % 10**8 if spam else 'page'}?{'&'.join('abcd'[:1 + i % 4])}", int(spam)


def test_held_out_accuracy(spark):
    labelled = spark.createDataFrame([url_of(i) for i in range(600)], "url string, blocked int")
    fresh = [(i, url_of(i)) for i in range(600, 900)]
    pages = spark.createDataFrame([(i, u[0]) for i, u in fresh], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in uf.url_filter(pages, rules=[], labelled=labelled).collect()}
    right = sum((got[i] == "block") == bool(u[1]) for i, u in fresh)
    assert right > 0.97 * len(fresh)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?y=/z#://q"), (5, "http://net"), (5, "http://net/"), (None, "x://sub.net/"),
            (6, "http://notnet/"), (7, "http://example.com/de"), (8, "http://É.org/fr/"), (9, "ftp://h?x://example.net/en/"), (10, "a\n://h\n.net/\n"),
            (11, "http://" + "a." * 20_000 + "org/fr/"), (12, "://")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, n int, host string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"]) for r in uf.url_filter(df).collect()]
    assert sorted(got, key=str) == sorted(((k, *parts(u), rule_of(*parts(u))[0]) for k, u in rows), key=str)
    assert uf.url_filter(df.limit(0)).collect() == []
    one = uf.url_filter(df, rules=[("block", "net/")]).collect()
    assert {r["verdict"] for r in one} == {"block"}
    assert {r["verdict"] for r in uf.url_filter(df, rules=[]).collect()} == {"allow"}


def test_longest_rule_wins():
    assert rule_of("a.example.net", "/en/1") == ("example.net/en/", "allow")


@pytest.mark.parametrize("url", ["http://a.b/c?d#e", "x://y", "://", "http://h#/p", "http://H/p//?", "no"])
def test_parts(spark, url):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(*uf.host_and_path(df["url"])).first()) == parts(url)
