"""The joins of the sales table hold no growing table in every task."""

from valora.plans.queries import queries


def _tables(spark, folder):
    rows = {
        "nation": ("n_nationkey long, n_name string", [(1, "A"), (2, "B")]),
        "customer": ("c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string",
                     [(k, k % 2 + 1, 1.5 * k, "S") for k in range(1, 7)] + [(9, 5, 1.0, "S")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string",
                   []),
        "lineitem": ("l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_linestatus string, l_shipdate date", []),
    }
    import datetime
    day = datetime.date(1995, 3, 1)
    rows["orders"][1].extend((k, [1, 2, 3, 9, None, 77][k % 6], "O", 10.0 * k, day, "1-URGENT") for k in range(1, 19))
    rows["lineitem"][1].extend((k, 2.0, 5.0, 0.1, 0.0, "F", day) for k in (1, 1, 2, 6, 7, 7, 7, None))
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_union_of_records_broadcasts_dimensions_only(spark, tmp_path):
    d = _tables(spark, str(tmp_path))
    out = queries()["source_records_union"](spark, d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.find("Initial Plan"):] if "Initial Plan" in plan else plan
    assert initial.count("SortMergeJoin") == 4 and initial.count("BroadcastHashJoin") <= 2
    got = sorted(map(tuple, out.collect()), key=str)
    expected = []
    for k in range(1, 19):
        cust = [1, 2, 3, 9, None, 77][k % 6]
        if cust not in (1, 2, 3):
            continue
        n = {1: 2, 2: 1, 6: 1, 7: 3}.get(k)
        expected += [(k, n, None if k % 17 == 0 else 1.5 * cust, None, None),
                     (k, None, None, "O", None if n is None else 2.0 * n)]
    assert got == sorted(expected, key=str)
