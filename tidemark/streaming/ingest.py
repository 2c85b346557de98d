"""Streams of lines into a store.

follow() extracts each micro-batch and writes it; a ledger of batch ids makes a repeated batch harmless. Windows that a batch
leaves open are written beside the offsets and go on with the next batch, so that one batch and many give the same samples;
finish() closes them. WindowCounter does the same for counts alone inside Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.operators.extract import extracted, folded, plain_samples, window_samples
from tidemark.plans.spec import Profile, Spec
from tidemark.sources.checkpoints import checkpointed
from tidemark.sources.store import Store


def ingest_batch(store: Store, spec: Spec, profile: Profile, lines: DataFrame, year: int, opened: DataFrame | None = None, final: bool = True) -> tuple[dict[str, int], DataFrame | None]:
    """Extracts (stream, ord, line[, labels]) and writes the samples of each set; what was accepted, and windows still open."""
    # Records are written once: filters on their outcome would otherwise carry the extraction down again and again.
    records = checkpointed(extracted(lines, spec, profile, year))
    samples, windows = plain_samples(records), None
    if any(p.aggregate for p in profile.patterns):
        windows = checkpointed(folded(records, profile, opened, final))
        samples = samples.unionByName(window_samples(windows.where("closed"), profile))
    done = write_samples(store, spec, samples)
    return done, None if windows is None else windows.where("not closed")


def write_samples(store: Store, spec: Spec, samples: DataFrame) -> dict[str, int]:
    samples, done = checkpointed(samples), {}
    for r in samples.select("set").distinct().collect():
        keyed = spec.sets.get(r.set) is not None and spec.sets[r.set].key == "offset"
        rows = samples.where(F.col("set") == r.set)
        hint = F.concat_ws("/", "stream", F.col("ord").cast("string")) if keyed else F.lit(None).cast("string")
        done[r.set] = store.write(r.set, rows.withColumn("key_hint", hint)).accepted
    spec.declare(store.catalogue)
    store.save()
    return done


def _open_windows(store: Store, checkpoint: str, before: int | None = None) -> tuple[int | None, DataFrame | None]:
    """The windows that the latest batch (before one) left open, and its id."""
    fs, p = store._fs(f"{checkpoint}/open")
    ids = [int(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
    ids = [i for i in ids if (before is None or i < before) and fs.exists(store._fs(f"{checkpoint}/open/{i}/_SUCCESS")[1])]
    return (max(ids), store.spark.read.parquet(f"{checkpoint}/open/{max(ids)}")) if ids else (None, None)


def follow(stream: DataFrame, store: Store, spec: Spec, profile: Profile, checkpoint: str, year: int = 1970, **trigger) -> StreamingQuery:
    """A running query from a streaming DataFrame (stream, ord, line) to the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fs, p = store._fs(f"{checkpoint}/ledger/{batch_id}")
        if fs.exists(p):
            return
        if not batch.isEmpty():
            before, opened = _open_windows(store, checkpoint, batch_id)
            _, left = ingest_batch(store, spec, profile, batch, year, opened, final=False)
            if left is not None:
                left.write.mode("overwrite").parquet(f"{checkpoint}/open/{batch_id}")
        fs.create(p, True).close()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/offsets").trigger(**(trigger or {"availableNow": True})).start()


def finish(store: Store, spec: Spec, profile: Profile, checkpoint: str) -> dict[str, int]:
    """Closes the windows that a stopped follow() has open, as after its streams have ended or been idle for long."""
    n, opened = _open_windows(store, checkpoint)
    if opened is None:
        return {}
    opened = checkpointed(opened)
    done = write_samples(store, spec, window_samples(opened, profile))
    opened.limit(0).write.mode("overwrite").parquet(f"{checkpoint}/open/{n}")
    return done


class WindowCounter(StatefulProcessor):
    """Counts records of (stream) by key in anchored windows of ``every_ms``: rows (stream, key, ts_ms, n)."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle) -> None:
        self.open = handle.getMapState("open", "key string", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        """``rows``: key, ts_ms, ord."""
        batch = pd.concat(list(rows)).sort_values("ord")
        windows = {k[0]: [v[0], v[1]] for k, v in self.open.iterator()}
        out = []
        for name, ts in zip(batch["key"], batch["ts_ms"], strict=True):
            # A record closes every window of its stream that has ended by then, in the order of their ends.
            for other in sorted((k for k, w in windows.items() if ts >= w[0] + self.every_ms), key=lambda k: (windows[k][0], k)):
                start, n = windows.pop(other)
                self.open.removeKey((other,))
                out.append((key[0], other, start, n))
            w = windows.setdefault(name, [int(ts), 0])
            w[1] += 1
        for name, (start, n) in windows.items():
            self.open.updateValue((name,), (start, n))
        yield pd.DataFrame(out, columns=["stream", "key", "ts_ms", "n"])

    def close(self) -> None:
        pass


def counted(stream: DataFrame, every_ms: int) -> DataFrame:
    """Closed windows of a streaming DataFrame (stream, key, ts_ms, ord); needs the RocksDB state store."""
    return stream.groupBy("stream").transformWithStateInPandas(WindowCounter(every_ms), "stream string, key string, ts_ms long, n long", "Append", "None")
