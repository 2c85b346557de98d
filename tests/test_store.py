from pyspark.sql import functions as F

from tidemark.plans.planner import Request
from tidemark.sources.store import Store

T0 = 1_787_918_400_000
SAMPLE = "ts_ms long, sub_us int, labels map<string,string>, fields map<string,struct<i:bigint,f:double,s:string,b:boolean>>"
ALL = Request(T0 - 30 * 86_400_000, T0 + 86_400_000)


def i(v):
    return (v, None, None, None)


def f(v):
    return (None, float(v), None, None)


def s(v):
    return (None, None, v, None)


def put(spark, store, source, rows):
    return store.write(source, spark.createDataFrame([(ts, 0, labels, fields) for ts, labels, fields in rows], SAMPLE))


def series(result):
    out = {}
    for r in result.rows.orderBy("ts").collect():
        out.setdefault(r.series, []).append((r.ts, r.value))
    return out


def test_two_hosts_and_matching(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = [(T0 + 1000 * k, {"host": h} if h else {}, {"inflight": i(10 * k)}) for k in range(10) for h in ("web1", "web2")]
    w = put(spark, store, "http", [*rows, (T0 + 500, {}, {"inflight": i(5)})])
    assert w.accepted == 21
    p = store.planner()
    got = series(p.run("FROM http SELECT inflight BY host", ALL))
    assert set(got) == {"web1 : inflight", "web2 : inflight", "host= : inflight"} and max(v for _, v in got["web1 : inflight"]) == 90
    none = p.run('FROM http SELECT inflight WHERE host = "typo"', ALL)
    assert none.rows.count() == 0 and "W201" in [n.code for n in none.notes]
    assert len(series(p.run('FROM http SELECT inflight SSE OFF WHERE host = "web1" OR MISSING host EVERY 1ms', ALL))["inflight"]) == 11
    folded = p.run("FROM http SELECT inflight WHERE host =~ /^web/", ALL)
    assert "W202" in [n.code for n in folded.notes]
    assert "W301" in [n.code for n in p.run("FROM http SELECT inflight", ALL).late_notes()]
    assert [r.value for r in p.run("LABELS host", ALL).rows.collect()] == ["web1", "web2"]
    assert p.run("FROM http SELECT inflight FORMAT logs LIMIT POINTS 3", ALL).rows.collect()[-1].inflight == 90
    # Written again, the same samples change nothing; the catalogue survives.
    put(spark, store, "http", rows)
    again = Store(spark, f"file://{tmp_path}")
    assert again.table("http").count() == 21 and again.catalogue.label_keys("http") == ["host"]


def test_metadata_and_refusals(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    put(spark, store, "http", [(T0, {"host": "a"}, {"reqs": i(100), "note": s("x")}), (T0 + 1000, {"host": "a"}, {"reqs": i(150)}), (T0 + 61_000, {"host": "a"}, {"reqs": i(7)})])
    store.catalogue.declare("http", "reqs", kind="counter", max_interval_ms=5000, limit_min=0.0)
    got = series(store.planner().run("FROM http SELECT reqs DELTA SSE OFF", Request(T0, T0 + 61_000)))
    assert got["reqs"] == [(T0 + 1000, 50.0), (T0 + 60_999, None), (T0 + 61_000, 7.0)]
    w = put(spark, store, "http", [(0, {}, {"reqs": i(1)}), (T0, {"host": ""}, {"reqs": i(1)}), (T0, {}, {"reqs": f("nan")}), (T0, {}, {}), (T0, {"reqs": "1"}, {"v": i(1)}), (T0 + 5, {}, {"reqs": (1, 1.0, None, None)}), (T0 + 7, {}, {"reqs": f(2.5)})])
    assert w.accepted == 1
    assert {r.reason for r in w.refused.collect()} == {"time out of range", "bad label value", "a value isn't finite", "no fields", "a name is label and field of the set", "a field needs exactly one value"}


def test_retention(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    put(spark, store, "http", [(T0, {"host": "a"}, {"v": i(1)}), (T0 - 10 * 86_400_000, {"host": "a"}, {"v": i(1)})])
    store.catalogue.known["http"].retention_ms = 48 * 3_600_000
    assert len(store.shards("http")) == 2 and store.sweep(T0) == {"http": 1} and len(store.shards("http")) == 1
    store.compact("http")
    assert store.table("http").count() == 1
    store.drop("http")
    assert store.catalogue.sets() == []


def test_heatmap(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    put(spark, store, "lat", [(T0 + 1000 * k, {"host": "a"}, {"b0": i(1), "b1": i(2)}) for k in range(200)])
    store.catalogue.declare_buckets("lat", "h", ["b0", "b1"], [0, 1])
    r = store.planner().run("FROM lat SELECT HISTOGRAM(h) BY host FORMAT heatmap", Request(T0, T0 + 200_000, 20)).rows
    assert {x.series for x in r.collect()} == {"a : 0", "a : 1"} and r.where("bucket_index = 0").count() == 20
    assert r.agg(F.sum("value")).first()[0] == 600.0
