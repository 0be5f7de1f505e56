"""Suffix-array (bytes) and suffix-tree (words) removal against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from valora.llm import repeats, suffix_array, suffix_tree


def brute_bytes(rows):
    """``rows``: (order key, text); the order key sorts documents."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows):
    first = {}
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in rows]
    for k, w in split:
        for p in range(len(w) - 49):
            s = tuple(w[p:p + 50])
            first[s] = min(first.get(s, k[0]), k[0])
    out = {}
    for k, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p:p + 50])] < k[0]:
                gone[p:p + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def made_rows(seed, n=60):
    """Texts cut from few sources, with edits, runs and repeats inside."""
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("ab cd efg h ij é".split()) + str(rnd.randrange(40)) for _ in range(400)) for _ in range(3)]
    pool += ["aaaa" * 100, "x y " * 150]
    out = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randrange(1, 4)):
            s = rnd.choice(pool)
            a = rnd.randrange(len(s))
            text += s[a:a + rnd.randrange(900)] + rnd.choice(["", " ", " #%d " % rnd.randrange(5)])
        out.append(((i,), text))
    return out


def run_bytes(df):
    return [tuple(r) for r in suffix_array.deduplicate(df).collect()]


def run_words(df):
    return [tuple(r) for r in suffix_tree.deduplicate(df).collect()]


@pytest.mark.parametrize(("chunk", "batch"), [(4096, 10_000), (2, 7)])
def test_made_texts(spark, monkeypatch, chunk, batch):
    """Small chunks and batches force streams, blocks and the merge of blocks."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = made_rows(chunk)
        df = spark.createDataFrame([(k[0], t) for k, t in rows], "doc_id long, text string").repartition(5)
        assert {r[0]: r[1:] for r in run_bytes(df)} == {k[0]: v for k, v in brute_bytes(rows).items()}
        assert {r[0]: r[1:] for r in run_words(df)} == {k[0]: v for k, v in brute_words(rows).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_table(docs):
    rows = [((r["doc_id"],), r["text"] or "") for r in docs.collect()]
    assert {r[0]: r[1:] for r in run_bytes(docs)} == {k[0]: v for k, v in brute_bytes(rows).items()}
    assert {r[0]: r[1:] for r in run_words(docs)} == {k[0]: v for k, v in brute_words(rows).items()}


def test_odd_rows(odd_docs):
    small = odd_docs.where("text IS NULL OR length(text) < 100000")
    rows = small.select("doc_id", "text").collect()
    assert len(run_bytes(small)) == len(run_words(small)) == len(rows)
    words = {(r[0], r[3]): r[1:3] for r in run_words(small)}
    got = defaultdict(list)
    for (i, _), v in words.items():
        got[i].append(v)
    assert got[1] == got[2] == got[3] == [(0, 0)]
    assert got[10] == [(73, 0)] and got[11] == [(73, 70)] and got[12] == [(140, 140)]
    by = defaultdict(list)
    for r in run_bytes(small):
        by[r[0]].append(r[1:])
    assert by[1][0][:3] == (0, 0, 0) and by[7][0][:3] == (50_000, 50_000 - 1, 1)
    assert len(by[None]) == 2 and by[None][0] == by[None][1]


@pytest.mark.parametrize("batch", [10_000, 1])
def test_repeated_rows_are_one_document(spark, batch):
    """Rows with one id and text: nothing starts earlier in the other copy, be
    it in the same batch or in another one."""
    rnd = random.Random(17)
    alone, shared = ("".join(rnd.choice("abcdefgh ") for _ in range(700)) for _ in range(2))
    rows = [((1,), alone), ((2,), "zz" + shared), ((3,), shared[:400] + "q" + alone[200:]), ((4,), shared)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for parts in (1, 7):
            twice = [(k[0], t) for k, t in rows for _ in range(2)]
            out = run_bytes(spark.createDataFrame(twice, "doc_id long, text string").repartition(parts))
            expected = {k[0]: v for k, v in brute_bytes(rows).items()}
            assert expected[1][1] == 0 and expected[2][1] == 0
            assert sorted(out) == sorted((i, *v) for i, v in expected.items() for _ in range(2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_text_in_parts(spark, monkeypatch):
    """A text longer than a block, and its copy, cut elsewhere."""
    from valora.llm import text as tx
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [((1,), long), ((2,), "zz" + long[500:2500] + "q" + long[:300])]
    expected = brute_bytes(rows)
    monkeypatch.setattr(tx, "BLOCK_BYTES", 700)
    import pyarrow as pa
    parts = list(suffix_array._symbols(pa.array([t for _, t in rows])))
    assert len(parts) > 4 and {p[0] for p in parts} == {0, 1}
    covered = sum(max(0, len(h) - 99) for _, h, _, _ in parts)
    assert covered == sum(len(t) - 99 for _, t in rows)
    df = spark.createDataFrame([(k[0], t) for k, t in rows], "doc_id long, text string")
    assert {r[0]: r[1:] for r in run_bytes(df)} == {k[0]: v for k, v in expected.items()}


def test_empty(no_docs):
    assert run_bytes(no_docs) == [] and run_words(no_docs) == []


def test_shorten_keeps_clean_rows(odd_docs):
    small = odd_docs.where("text IS NULL OR length(text) < 100000")
    out = suffix_tree.shorten(small)
    assert out.schema.simpleString() == small.schema.simpleString()
    rows = defaultdict(list)
    for r in out.collect():
        rows[r["doc_id"]].append(r)
    assert 12 not in rows and rows[11][0]["text"] == "four five six" and rows[11][0]["n_chars"] == 13
    assert rows[1][0]["text"] is None and rows[3][0]["text"] == " \t\n " and len(rows[None]) == 2


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(200):
        t = np.array([rnd.randrange(rnd.choice([1, 2, 200])) for _ in range(rnd.randrange(1, 50))], np.uint8)
        order = suffix_array.suffix_array(t, 64).tolist()
        raw = t.tobytes()
        assert order == sorted(range(len(t)), key=lambda i: raw[i:])
        common = suffix_array.adjacent_prefixes(t, np.array(order), 64)
        for i in range(1, len(order)):
            a, b = raw[order[i - 1]:], raw[order[i]:]
            assert common[i] == next((k for k in range(64) if a[k:k + 1] != b[k:k + 1] or k >= len(b)), 64)


@pytest.mark.parametrize("most", [1, 4, 4096])
def test_suffix_tree_classes(monkeypatch, most):
    monkeypatch.setattr(suffix_tree, "SUBTREE", most)
    rnd = np.random.default_rng(most)
    for _ in range(60):
        base, symbols, n = rnd.integers(0, 3, 400).astype(np.uint64), [], []
        for _ in range(rnd.integers(1, 8)):
            w, s = int(rnd.integers(1, 30)), int(rnd.integers(0, 300))
            own = base[s:s + w + 49].copy()
            if rnd.random() < 0.4:
                own[rnd.integers(len(own))] = 9
            symbols.append(own.tobytes())
            n.append(w)
        which, place, group = suffix_tree.classes(symbols, np.array(n))
        equal, got = defaultdict(set), defaultdict(set)
        for c in range(len(n)):
            for k in range(n[c]):
                equal[symbols[c][8 * k:8 * k + 400]].add((c, k))
        for c, k, g in zip(which.tolist(), place.tolist(), group.tolist(), strict=True):
            got[g].add((c, k))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in equal.values() if len(v) > 1}


def test_repeated_words_in_bounded_memory(spark):
    """A million equal words, alone, beside others and in a later document."""
    import resource

    many, own = 1_000_000, " ".join(f"w{i}" for i in range(200))
    rows = [(1, f"{own} " + "la " * many), (2, "la " * 300_000 + own), (3, "lo " * many), (4, f"x {'la ' * 49} y {'lo ' * 50}")]
    rows.append((5, " ".join(["ab", "cd", "ef"] * 100_000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in suffix_tree.deduplicate(docs).collect()}
    assert out == {1: (many + 200, 0), 2: (300_200, 300_200), 3: (many, 0), 4: (101, 50), 5: (300_000, 0)}
    peak = spark.range(0, 64, 1, 16).mapInArrow(
        lambda it: (__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(
            [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], names=["kb"]) for _ in it), "kb long").agg({"kb": "max"}).first()[0]
    assert peak < 1_000_000


@pytest.mark.parametrize("batch", [1, 2, 7, 10_000])
def test_copies_within_a_document_and_across_batches(spark, batch):
    """Repeats inside documents, whose first place another document may have,
    with null ids as one document of many rows."""
    rnd = random.Random(batch)
    pool = [" ".join(f"{c}{i % 7}" for i in range(120)) for c in "abc"] + ["p q " * 60, "z " * 130]
    rows = []
    for i in range(24):
        text = " ".join(x for _ in range(rnd.randrange(1, 5)) for x in (rnd.choice(pool), f"#{rnd.randrange(3)}"))
        rows.append((None if i % 5 == 0 else rnd.randrange(8), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    big = repeats.NULL_ID
    want = brute_words([((big if i is None else i, t), t) for i, t in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in suffix_tree.deduplicate(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(((i, *want[(big if i is None else i, t)][:2]) for i, t in rows), key=repr)
