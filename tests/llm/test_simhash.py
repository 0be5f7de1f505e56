"""Covering hashing finds every link; components and representatives."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from valora.llm import simhash
from valora.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """Smallest node per fingerprint, over all pairs."""
    u = np.array(sorted(fps), np.uint64)
    root = np.arange(len(u))
    near = [np.flatnonzero(np.bitwise_count(u ^ x) <= radius) for x in u]
    changed = True
    while changed:
        new = np.array([root[n].min() for n in near])
        changed = (new != root).any()
        root = new
    return {int(a): int(u[r]) for a, r in zip(u, root, strict=True)}


def test_masks_cover_every_difference():
    rnd = random.Random(3)
    for level in range(3):
        masks = simhash.covering_masks(4, level)
        assert len(masks) == 31
        for _ in range(3000):
            d = sum(1 << p for p in rnd.sample(range(64), rnd.randrange(1, 5)))
            assert any(m & d == 0 for m in masks)


def test_links_with_small_buckets(spark, monkeypatch):
    """Clusters that overflow a bucket go through the finer levels."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rnd = random.Random(9)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for p in rnd.sample(range(64), rnd.randrange(1, 6)):
                x ^= 1 << p
            if rnd.random() < 0.3:
                x ^= rnd.getrandbits(64) & 0xFFF000
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long").repartition(4)
    edges = simhash.links(df, 4)
    found = {r["node"] & (1 << 64) - 1: r["root"] for r in components(edges).collect()}
    expected = brute_components(fps, 4)
    label = {}
    for x in fps:
        got = found.get(x, simhash._signed(x))
        assert label.setdefault(expected[x], got) == got
    assert len(set(label.values())) == len(label)


def test_large_buckets_over_batch_edges(spark, monkeypatch):
    """Every row of a large bucket goes on, also one that is alone in its batch."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    mask = simhash.covering_masks(4)[0]
    rnd = random.Random(4)
    free = [1 << p for p in range(64) if not mask >> p & 1]
    buckets = {rnd.getrandbits(64) & mask: rnd.randrange(1, 15) for _ in range(60)}
    rows = {k: [k | sum(b for i, b in enumerate(free) if j >> i & 1) for j in range(n)] for k, n in buckets.items()}
    df = spark.createDataFrame([(simhash._signed(mask), simhash._signed(x)) for v in rows.values() for x in v],
                               "mask long, fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sent = simhash._compare(df, 4, last=False).where("mask <> 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["a"] for r in sent) == sorted(simhash._signed(x) for v in rows.values() if len(v) > 8 for x in v)


def test_whole_table(docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    root = brute_components(set(fps.values()), 4)
    least = {}
    for i, x in fps.items():
        least[root[x]] = min(least.get(root[x], i), i)
    for i, x in fps.items():
        assert out[i]["fingerprint"] == f"{x:016x}" and out[i]["component_id"] == least[root[x]]
    kept = {r["doc_id"] for r in simhash.representatives(docs).collect()}
    assert kept == set(least.values())


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    out = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in out) == sorted(
        (str(r["doc_id"]), f"{brute_fingerprint(r['text']):016x}") for r in rows)
    zero = [r["component_id"] for r in out if r["fingerprint"] == "0" * 16]
    assert zero == [1, 1, 1]
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {4}
    kept = simhash.representatives(odd_docs)
    assert kept.schema.simpleString() == odd_docs.schema.simpleString()
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5} <= set(ids) and not {2, 3, 6, None} & set(ids)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.representatives(no_docs).count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(i, i + 1) for i in range(2000, 2060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {x: find(x) for x in root}
    assert all(got.get(x, x) == expected[x] for x in expected)
    none = spark.createDataFrame([(1, 1), (None, 2)], "u long, v long").where(F.lit(True))
    assert components(none).count() == 0
