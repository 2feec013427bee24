"""Views over the test tables: parts of DISTINCT views grow in number, not in size."""

from fleetlens.sources import tables


def test_large_distinct_views_come_in_even_parts(spark, tmp_path, monkeypatch):
    made = spark.range(600).selectExpr(
        "id % 200 as l_orderkey", "id % 50 as l_partkey", "id % 20 as l_suppkey", "id % 7 as l_linenumber", "CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' END as l_returnflag", "'F' as l_linestatus"
    )
    made.union(made).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(tables, "ROWS_A_PART", 40, raising=False)
    t = tables.Tables(spark, str(tmp_path))
    plain = t._shape(tables.ADAPTERS["db_permissions"], t.base)
    got = t.db_permissions
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.columns == plain.columns
    # 1,200 rows, 40 a part: one exchange of 30 parts, and none after it
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in tree and "REPARTITION_BY_NUM" in tree and ", 30)" in tree
