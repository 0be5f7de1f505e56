"""Merkle manifest against a plain tree over all rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from valora.llm import merkle, queries


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """The root over ``nodes``, and for each node the siblings of every level and its place among them."""
    proofs = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at, strict=True):
            first = i - i % arity
            p.append((i - first, nodes[first:i] + nodes[i + 1:first + arity]))
        nodes = [h(nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], proofs


def brute(rows, arity=2):
    """Sorted result rows of the contract."""
    groups = defaultdict(list)
    for r in rows:
        leaf = h([field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        groups[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), leaf, r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in names:
        groups[g].sort(key=lambda x: x[0])
        found[g] = climb([leaf for _, leaf, _ in groups[g]], arity)
    root, tops = climb([found[g][0] for g in names], arity) if names else (None, [])
    out = []
    for g, top in zip(names, tops, strict=True):
        sub, proofs = found[g]
        for (_, leaf, r), proof in zip(groups[g], proofs, strict=True):
            path = proof + top
            own = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                own = h([field(r[c] + 1 if c == "n_chars" else r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
            for place, others in path:
                own = h([*others[:place], own, *others[place:]])
            out.append((r["doc_id"], leaf, sub, root, h([x for _, o in path for x in o]), own, own == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_query(spark, sf, docs):
    out = queries.op12_merkle_manifest(spark, sf)
    assert out.columns[:7] == NAMES
    assert sorted((tuple(r)[:7] for r in out.collect()), key=repr) == brute(docs.collect())


@pytest.mark.parametrize("arity,block,exchange,n", [(2, 2, 2, 57), (2, 4, 4, 200), (2, 1, 4, 71), (3, 3, 9, 140), (4, 16, 4, 130)])
def test_many_rounds(spark, arity, block, exchange, n):
    """Small blocks and small exchanges: several rounds, with empty seats."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
                                 F.when(F.col("id") % 3 > 0, F.lit("a")).when(F.col("id") % 9 > 0, F.lit("b")).alias("lang"),
                                 F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).repartition(5)
    made = merkle.fold(merkle.manifest(rows, arity=arity, block=block, exchange=exchange))
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in made.collect()}
    want = {r[0]: (*r[1:5], r[3]) for r in brute(rows.collect(), arity)}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = merkle.tamper_check(odd_docs).select(*NAMES).collect()
    rows = odd_docs.collect()
    want = brute(rows)
    # rows alike in every column have one leaf, but places of their own
    assert sorted(map(tuple, got), key=repr) == want and len(got) == len(rows)
    one = spark.createDataFrame([(5, "x", None, None, None)], no_docs.schema)
    assert [tuple(r) for r in merkle.tamper_check(one).select(*NAMES).collect()] == brute(one.collect())
    empty = merkle.tamper_check(no_docs)
    assert empty.count() == 0 and empty.columns[:7] == NAMES


def test_verify_against_a_kept_manifest(docs, scratch):
    merkle.manifest(docs).write.parquet(f"{scratch}/manifest")
    kept = docs.sparkSession.read.parquet(f"{scratch}/manifest")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    more = changed.unionByName(docs.limit(1).withColumn("doc_id", F.lit(10 ** 9)))
    out = {r["doc_id"]: r["verified"] for r in merkle.verify(more, kept).collect()}
    assert out == {r["doc_id"]: r["doc_id"] % 10 != 0 or r["text"] is None for r in docs.select("doc_id", "text").collect()} | {10 ** 9: False}


def test_powers_only(docs):
    with pytest.raises(ValueError):
        merkle.manifest(docs, block=1000)
