import os

from tests.test_extract import SPEC

from tidemark.plans.spec import parse_spec
from tidemark.sources.files import lines
from tidemark.sources.store import Store
from tidemark.streaming.ingest import counted, finish, follow
from tidemark.streaming.tail import Tail, _Reader, advance


def test_follow_a_file_into_a_store(spark, tmp_path):
    log = tmp_path / "app.log"
    spark.dataSource.register(Tail)
    store, spec = Store(spark, f"file://{tmp_path}/store"), parse_spec(SPEC)

    def go():
        stream = spark.readStream.format("tail").option("path", str(log)).load()
        # A source that is asked for new rows again and again needs a trigger that does so.
        q = follow(stream, store, spec, spec.profiles[0], f"file://{tmp_path}/ck", processingTime="500 milliseconds")
        q.processAllAvailable()
        q.stop()

    log.write_text("03.05.2031 06:00:00 arm 1 lifts=1 load=7kg\n03.05.2031 06:00:01 halt: rope\n03.05.2031 06:00:02 arm 1 lifts=2 lo")
    go()
    assert store.table("lifting").count() == 1
    with open(log, "a") as f:
        f.write("ad=8kg\n03.05.2031 06:00:40 halt: rope\n")
    go()
    assert store.table("lifting").count() == 2 and store.catalogue.field("lifting", "lifts").kind == "counter"
    # One window over both batches, open until the end.
    assert finish(store, spec, spec.profiles[0], f"file://{tmp_path}/ck") == {"halted": 1}
    assert [r.stops for r in store.table("halted").collect()] == [2.0] and finish(store, spec, spec.profiles[0], f"file://{tmp_path}/ck") == {}


def test_tail_tells_rotation(tmp_path):
    p = tmp_path / "x.log"
    p.write_text("one\ntwo\nthr")
    got, state = advance(str(p), None, 1 << 20)
    assert [x for _, x in got] == ["one", "two"]
    assert advance(str(p), state, 1 << 20)[0] == []
    p.write_text("new one\nnew two\n")
    got, after = advance(str(p), state, 1 << 20)
    assert [x for _, x in got] == ["new one", "new two"]
    # A replay of that step gives the same, though the new file is longer than what was read of the old one.
    assert [r[2] for r in _Reader({"path": str(p)}).readBetweenOffsets({str(p): state}, {str(p): after})] == ["new one", "new two"]


def test_only_a_line_feed_ends_a_line(tmp_path, spark):
    p = tmp_path / "x.log"
    p.write_bytes(b"one\rtwo\nthree\r\n")
    assert [x for _, x in advance(str(p), None, 1 << 20)[0]] == ["one\rtwo", "three"]
    assert [r.line for r in lines(spark, f"file://{p}")[0].orderBy("ord").collect()] == ["one\rtwo", "three"]


def test_windows_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    for n, rows in enumerate([[("s", "a", 0, 0), ("s", "a", 5000, 1), ("s", "b", 9000, 2)], [("s", "a", 10_500, 3), ("s", "a", 30_000, 4)]]):
        spark.createDataFrame(rows, "stream string, key string, ts_ms long, ord long").coalesce(1).write.parquet(f"{folder}/b{n}")
        stream = spark.readStream.schema("stream string, key string, ts_ms long, ord long").parquet(f"{folder}/*")
        q = counted(stream, 10_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r.key, r.ts_ms, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 0, 2), ("a", 10_500, 1), ("b", 9000, 1)]


def test_files_are_listed_once(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_text("1\n2\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("3\n")
    (tmp_path / "c.tar").write_text("x")
    (tmp_path / "d.bin").write_bytes(b"a\0b\n")
    got, skipped = lines(spark, f"file://{tmp_path}", f"file://{tmp_path}/a.log")
    assert [r.line for r in got.orderBy("stream", "ord").collect()] == ["1", "2", "3"]
    assert sorted(r.reason for r in skipped.collect()) == ["archive", "binary"]
