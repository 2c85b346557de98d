import __spark_entry__


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 30
    r = q["heatmap_all"](spark, "/root/testdata/sf0.001")
    assert r.columns == ["bucket_index", "edge", "series", "ts", "value"] and r.count() > 0
