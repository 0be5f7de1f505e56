"""Boundary sets against sorted lists; fill-in-middle against plain slicing."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valora.llm import fill_middle as fm
from valora.llm import queries


def check(values):
    values = np.unique(np.asarray(values, np.int64))
    s = fm.BoundarySet(values)
    assert len(s) == len(values)
    assert (s.select(np.arange(len(values))) == values).all()
    probes = np.unique(np.concatenate([values, values + 1, values - 1, [0, 1, 65535, 65536, 1 << 40]]))
    probes = probes[probes >= 0]
    assert (s.rank(probes) == np.searchsorted(values, probes)).all()
    return s


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 300)), max_size=40))
def test_any_mixture_of_runs(spans):
    check(np.concatenate([np.zeros(0, np.int64), *[np.arange(a, a + n) for a, n in spans]]))


def test_all_kinds_of_containers():
    rng = np.random.default_rng(3)
    few = rng.choice(1 << 16, 900, replace=False)
    dense = (1 << 16) + rng.choice(1 << 16, 30_000, replace=False)
    runs = (3 << 16) + np.concatenate([np.arange(a, a + 900) for a in range(0, 60_000, 1000)])
    full = (4 << 16) + np.arange(1 << 16)
    s = check(np.concatenate([few, dense, runs, full, (900 << 16) + few]))
    assert s.kind.tolist() == [fm.ARRAY, fm.BITMAP, fm.RUNS, fm.RUNS, fm.ARRAY]
    check([])
    check([0])


def brute(id_, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    code = hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(code[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (id_, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (id_, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (id_, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("rate,spm,size", [(100, 50, fm.BATCH_BYTES), (60, 100, 1000), (100, 0, 1)])
def test_documents(docs, monkeypatch, rate, spm, size):
    monkeypatch.setattr(fm, "BATCH_BYTES", size)
    out = fm.transform(docs, rate=rate, spm=spm)
    assert result(out) == sorted((brute(r["doc_id"], r["text"], rate, spm) for r in docs.collect()), key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    more = [(20, "a\n\n\nb"), (21, "\n" * 100_000), (22, "x <S> y\nz\n"), (23, "<\n<S\nP>\n<M"), (24, "é\n漢\n\U0001F600"),
            (25, "\n"), (26, "a\r\nb"), (27, "x\n" * 40_000 + "end"), (None, "a\nb\nc"), (23, "again\n<\n")]
    more += [(i, f"<\nP>{i}\n<\n<\nS>\n") for i in range(100, 140)]
    odd = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = odd.collect()
    out = fm.transform(odd.withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y")}))
    assert result(out) == sorted((brute(r["doc_id"], r["text"]) for r in rows), key=repr)
    back = out.select("doc_id", fm.restore(F.col("output"), F.col("form")).alias("text"))
    assert result(back) == sorted(((r["doc_id"], r["text"] or "") for r in rows), key=repr)
    assert fm.transform(no_docs).count() == 0


def test_query_columns(spark, sf):
    out = queries.op13_fill_in_middle(spark, sf)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {r["form"] for r in out.select("form").distinct().collect()} >= {"psm", "spm"}
