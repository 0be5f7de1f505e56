"""Nearest neighbours and url rules."""

import random
from collections import defaultdict

import numpy as np
import pytest

from valora.llm import hnsw, url_filter


def exact(ids, x, k=20, every=20):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        own = x[ids.index(q)]
        score = (x * own).sum(axis=1)
        best = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:k]
        out[q] = best
    return out


def recall(rows, expected):
    got = defaultdict(list)
    for r in rows:
        got[r["query_id"]].append(r)
    hit = total = 0
    for q, best in expected.items():
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hit += len({r["vec_id"] for r in own} & {i for _, i in best})
        total += len(best)
    assert set(got) == {q for q in expected if expected[q]}
    return hit / total


def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    assert recall(hnsw.neighbours(df, shard_rows=200).collect(), exact(ids, x)) >= 0.9


def test_unequal_lengths_and_copies(spark):
    """Inner product, not angle; a vector with very many copies."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(1200, 16)) * rnd.random((1200, 1)) * 10
    x[300:700] = x[300]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(hnsw.neighbours(df).collect(), exact(list(range(1200)), x)) >= 0.95


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall_in_shards_far_above_the_beam(spark, kind):
    """7,000 vectors in one graph, 14 times the beam, and in two."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(7000, 64))
    if kind == "clusters":
        x = x * 0.3 + rnd.normal(size=(50, 64))[rnd.integers(0, 50, 7000)]
    ids = list(range(7000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    expected = exact(ids, x)
    assert 7000 > 10 * hnsw.EF_SEARCH
    assert recall(hnsw.neighbours(df).collect(), expected) >= 0.9
    assert recall(hnsw.neighbours(df, shard_rows=3500).collect(), expected) >= 0.9


def test_queries_as_a_stream(spark):
    """Batches of a few rows, several shards and copies of a shard, two lengths of vectors: the same rows."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=4 if i % 7 == 0 else 6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usual = sorted(map(tuple, hnsw.neighbours(df, every=3, shard_rows=200).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, hnsw.neighbours(df, every=3, shard_rows=200).collect())) == usual
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0] for r in usual} == set(range(0, 900, 3))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]),
            (100, [None, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, -1.0]), (120, []),
            (140, [1.0, 2.0, 3.0]), (160, [1.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, vec int, shard int")
    got = [tuple(r) for r in hnsw.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 0.0)]
    assert hnsw.neighbours(df.limit(0)).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"),
         ("example.com", "/de", "block"), ("org", "/fr/x", "allow"), ("org", "/fr/", "block"), ("org", "/fr/", "allow")]


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (r[0].count("."), len(r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark):
    rnd = random.Random(6)
    hosts = ["net", "example.net", "EXAMPLE.net", "a.example.net", "b.a.example.net", "xnet", "example.com", "x.org", "org", ""]
    tails = ["", "/", "/en/1", "/en", "/de", "/dex?q=/en/", "/fr/", "/fr/x#a", "/fr/xy/z", "?a=/b", "#/en/", "//en/"]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{t}" for h in hosts for t in tails]
    urls += [None, "", "no scheme", "a://b://net/x", "x\n://net/\ny", "://net/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, "http://net/", 2), (0, urls[0], 3)],
                               "page_id long, url string, host int")
    out = url_filter.filter_urls(df, RULES).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        assert tuple(r)[1:] == brute_url("http://net/" if r["page_id"] is None else urls[r["page_id"]], RULES)
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, [("x" * 9_000_000, "/", "block")])
