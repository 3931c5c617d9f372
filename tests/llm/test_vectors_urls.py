"""Searches against brute force; URLs against a plain reading of the rules."""

from collections import Counter

import numpy as np
import pytest

from maskloom.llm import urls, vectors

NAN, INF = float("nan"), float("inf")


def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[100][1]) for i in range(700, 900)]  # one vector, many times
    rows += [(900, None), (920, [0.0] * 16), (940, [NAN] * 16), (960, [None] + [1.0] * 15), (980, [INF] * 16), (None, [1.0] * 16), (1000, [])]
    rows += [(1020, [1.0, 2.0]), (1100, [2.0, 1.0]), (1101, [2.0, 3.0]), (20, rows[20][1])]
    return spark.createDataFrame([(i, v, 7, 0.0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, rank int"), rows


def brute(rows, every, k, score, zero):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, v in ok:
        if q % every == 0:
            near = sorted((-score(v, w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return out


def dot(v, w):
    total = 0.0
    for a, b in zip(v, w):
        total += float(np.float32(a)) * float(np.float32(b))
    return total


def whole(v, w):
    f = lambda x: int(np.floor(256 * float(np.float32(x))))
    return sum(f(a) * f(b) for a, b in zip(v, w))


@pytest.mark.parametrize("strip, block", [(64, 16), (64, 16384), (8192, 16384)])
def test_nearest(spark, strip, block):
    df, rows = table(spark)
    got = [tuple(r) for r in vectors.nearest(df, strip=strip, block=block).collect()]
    assert Counter(got) == Counter(brute(rows, 20, 20, dot, False))


@pytest.mark.parametrize("strip, block", [(64, 8), (64, 16384), (16384, 16384)])
def test_exact_top_k(spark, strip, block):
    df, rows = table(spark)
    got = [tuple(r) for r in vectors.exact_top_k(df, strip=strip, block=block).collect()]
    assert Counter(got) == Counter(brute(rows, 50, 5, whole, True))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.nearest(df).count() == 0 and vectors.exact_top_k(df).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert vectors.nearest(one).count() == 0 and vectors.exact_top_k(one).count() == 0


def test_kd_tree_bounds():
    rng = np.random.default_rng(8)
    points = rng.integers(-50, 50, (500, 6)).astype(float)
    tree = vectors.KdTree(points, np.arange(500), leaf=8)
    queries = rng.integers(-50, 50, (20, 6)).astype(float)
    bound = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.spans):
        inside = points[tree.order[a:b]]
        assert (inside @ queries.T <= bound[:, node] + 1e-9).all()


@pytest.mark.parametrize("size", [1e5, 1e6, 1e7, 1e13])
def test_large_components_are_exact(spark, size):
    """Products beyond 2**53, beyond 2**62, and beyond a long."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-9, 10, 64) * size + rng.integers(0, 3, 64)).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 330)]
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    f = lambda v: [clip(int(np.floor(256 * x))) for x in v]
    want = brute([(i, f(v)) for i, v in rows], 50, 5, lambda v, w: clip(sum(a * b for a, b in zip(v, w))), True)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.exact_top_k(df, strip=64, block=3).collect()]
    assert Counter(got) == Counter(want)


def reading(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    pages = [None, "", "no scheme/en/", "http://", "http://example.com", "http://EXAMPLE.com/en/71?x#y", "https://www.example.com/en/81", "http://notexample.com/en/7", "http://com/en/", "http://a.net/de/8",
             "http://b.example.net/de/8/x", "http://example.net?/de/8", "ftp://x.org/es/#q", "http://x.org/ES/", "http://x.org:80/es/", "a://b://c.com/en/", "http://é.com/en/", "http://x..com/en/1", "http://Ünï.ORG/es/"]
    rows = list(enumerate(pages)) + [(3, "http://example.com/en/7"), (None, "http://x.org/es/")]
    df = spark.createDataFrame([(i, u, "html", "clash") for i, u in rows], "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.filter_urls(df).collect())
    assert got == Counter((i, *reading(u), rule(*reading(u))[0]) for i, u in rows)
    for r in urls.filter_urls(df).collect():
        fixed = rule(r["host"], r["path"])[1]
        assert r["verdict"] in ("allow", "block") and (fixed is None or r["verdict"] == fixed)
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.one.com", 1)] * 200 + [("good.two.com", 0)] * 200 + [("few.one.com", 0), ("new.one.com", None), ("new.two.com", None), ("z", None), ("", 1)]
    got = {r["host"]: r for r in urls.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.one.com"]["lower"] > 0.9 and got["good.two.com"]["rate"] < 0.1
    assert 0 < got["few.one.com"]["rate"] < got["new.one.com"]["rate"] and got["new.two.com"]["rate"] < got["new.one.com"]["rate"]
    assert got["new.one.com"]["n"] == 0 and got["new.one.com"]["lower"] < got["new.one.com"]["rate"]
    assert len(got) == 7


def test_registered_domains(spark):
    want = {
        "example.com": ("example.com", "com"),
        "a.b.example.com:8080": ("example.com", "com"),
        "www.shop.co.uk": ("shop.co.uk", "co.uk"),
        "shop.co.uk": ("shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "uk": ("uk", "uk"),
        "me@x.gov.br.": ("x.gov.br", "gov.br"),
        "192.168.0.1": ("192.168.0.1", "(address)"),
        "10.0.0.1:80": ("10.0.0.1", "(address)"),
        "[::1]:80": ("[::1]", "(address)"),
        "co.example": ("co.example", "example"),
        "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = urls.registered(df["host"])
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == want
