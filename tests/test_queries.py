"""Every registered query against its DuckDB oracle on the smallest tables,
plus split properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare, duck
from valora.operators import split
from valora.operators.split import with_folds, with_split
from valora.sources.tables import sales_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SF, con)
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 25 and "median_target" in df.columns


def test_split_sizes_and_stability(spark):
    s = sales_table(spark, SF)
    n = s.count()
    sizes = {r["is_test"]: r["count"] for r in with_split(s, "o_orderkey").groupBy("is_test").count().collect()}
    assert sizes == {True: -(-n // 5), False: n - -(-n // 5)}
    folds = [r["count"] for r in with_folds(s, "o_orderkey", 7).groupBy("fold").count().collect()]
    assert len(folds) == 7 and sum(folds) == n and max(folds) - min(folds) <= 1
    one = with_split(s.repartition(1), "o_orderkey").where("is_test").select("o_orderkey")
    many = with_split(s.repartition(11), "o_orderkey").where("is_test").select("o_orderkey")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_split_of_odd_ids(spark):
    few = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "k string")
    assert with_split(few, "k").count() == 4 and with_split(few, "k").where("is_test IS NULL").count() == 0
    three = spark.createDataFrame([(i,) for i in range(3)], "k int")
    assert sorted(r["fold"] for r in with_folds(three, "k", 5).collect()) == [0, 1, 3]
    assert with_split(few.limit(0), "k").count() == 0 and with_folds(few.limit(0), "k").count() == 0
    assert with_split(three, "k").where("is_test").count() == 1


def test_cuts_are_ranks(spark, monkeypatch):
    """Places found level by level against a sort, with distinct hashes, with a
    third of the ids null, and with many ids to a hash."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"))
    ranks = [0, 5, 1500, 2000, 2001, 2999]
    whole = split.hash_int

    def check():
        own = sorted(tuple(r) for r in rows.select(split.hash_int(F.col("k"), "s"), split._id_text(F.col("k"))).collect())
        assert split._places_at(rows, "k", "s", lambda n: ranks) == (3000, [own[r] for r in ranks])

    check()
    monkeypatch.setattr(split, "CELLS", 16)
    check()
    monkeypatch.setattr(split, "hash_int", lambda c, salt: whole(c, salt) % 5)
    check()


def test_sales_table_shape(spark):
    s = sales_table(spark, SF)
    n = s.count()
    assert n == s.select("o_orderkey").distinct().count()
    assert s.where(F.col("n_lines").isNull()).count() > 0


def test_cuts_of_few_rows_take_two_passes(spark, monkeypatch):
    """Once the cells that hold the ranks have few rows, their ids are counted at once."""
    rows, passes = spark.range(20000).withColumnRenamed("id", "k"), []
    whole = type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *a: passes.append(a) or whole(self, *a))
    n, places = split._places_at(rows, "k", "s", lambda n: [4000, 15000])
    own = sorted(tuple(r) for r in rows.select(split.hash_int(F.col("k"), "s"), split._id_text(F.col("k"))).collect())
    assert (n, places) == (20000, [own[4000], own[15000]]) and len(passes) == 2
