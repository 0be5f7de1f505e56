"""Line dedup over sorted runs against plain counting."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from valora.llm import line_runs, queries

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_runs.UPPER, line_runs.UPPER.lower())


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, least=10, shortest=1, known=None):
    """Sorted ``id, n_lines, n_dropped, kept``; keys are counted in ``known`` or the rows."""
    split = [(r["doc_id"], (r["text"] or "").split("\n")) for r in rows]
    counts = Counter()
    for lines in [(r["text"] or "").split("\n") for r in known] if known is not None else [x for _, x in split]:
        counts.update({k for k in map(key, lines) if len(k) >= shortest})
    out = []
    for i, lines in split:
        kept = [x for x in lines if counts[key(x)] < least or len(key(x)) < shortest]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_columns(spark, sf, docs):
    out = queries.op11_line_dedup(spark, sf)
    assert out.columns[:4] == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs.collect())]
    assert result(out) == sorted(want, key=repr) and any(d for _, _, d, _ in want)


@pytest.mark.parametrize("batches,fanout,least", [(1, 2, 2), (7, 2, 10), (5, 3, 4)])
def test_batches_and_levels(spark, docs, scratch, batches, fanout, least):
    """Runs that merge over several levels give what one count gives."""
    parts = [docs.where(F.pmod("doc_id", F.lit(batches)) == b) for b in range(batches)]
    runs = line_runs.LineRuns(spark, f"{scratch}/runs-{batches}", least, 1, fanout, buckets=3)
    for i, p in enumerate(parts):
        runs.add(p)
        n, digits = i + 1, 0
        while n:
            n, digits = n // fanout, digits + n % fanout
        assert len(runs.runs) == digits  # of the number of batches, base fanout
    assert result(runs.strip(docs)) == brute(docs.collect(), least)
    runs.close()


def test_settled_keys_are_not_stored_again(spark, scratch):
    runs = line_runs.LineRuns(spark, f"{scratch}/settled", 3, 1, 10, buckets=2)
    one = spark.range(5).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common \nown "), "id").alias("text"))
    runs.add(one)
    runs.add(one.withColumn("text", F.lit("common\nfresh")).limit(1))
    rows = [sorted((r["n"], r["settled"]) for r in spark.table(t["table"]).collect()) for t in runs.runs]
    assert rows == [[(1, False)] * 5 + [(5, True)], [(1, False)]]
    assert {r[1] for r in runs._merged(runs.runs).select("h1", "n").collect()} == {1, 5}
    runs.close()


def test_going_on_after_a_restart(spark, docs, scratch):
    """A state that is opened again knows what was added; documents added
    later lose lines that only earlier ones made frequent."""
    early, late = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    first = line_runs.LineRuns(spark, f"{scratch}/again", 4, 1, 4, buckets=3)
    first.add(early)
    first.close()
    assert not spark.catalog.tableExists(first.runs[0]["table"])
    again = line_runs.LineRuns.open(spark, f"{scratch}/again")
    again.add(late)
    assert result(again.strip(late)) == brute(late.collect(), 4, known=docs.collect())
    again.close()


def test_hot_lines_and_null_ids(spark, monkeypatch):
    """A line of most documents goes by place; null ids of one text are one key."""
    rows = [(i if i % 3 else None, f"Hot line\nown {i % 7}\n\n hot LINE \t" if i % 3 else "hot line\nx") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = result(line_runs.deduplicate([docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")], least=50))
    assert out == brute(docs.collect(), 50)
    monkeypatch.setattr(line_runs, "HEAVY", 0)  # no key is hot: the other way gives the same
    assert result(line_runs.deduplicate([docs], least=50)) == out


def test_odd_rows(spark, odd_docs, no_docs):
    for least, shortest in ((2, 1), (3, 5), (1, 1)):
        assert result(line_runs.deduplicate([odd_docs], least, shortest)) == brute(odd_docs.collect(), least, shortest)
    empty = line_runs.deduplicate([no_docs])
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    many = spark.createDataFrame([(1, "\n" * 50_000 + "Ä\r"), (2, "ä\n" + " " * 200_000 + "x"), (3, "Ä \n\x0bX\n ")], "doc_id long, text string")
    assert result(line_runs.deduplicate([many], 2)) == brute(many.collect(), 2)


def test_no_python_in_tasks(spark, docs):
    plan = line_runs.deduplicate([docs])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
