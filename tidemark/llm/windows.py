"""Repeated windows of a fixed number of symbols in a corpus: what substring dedup by words and by bytes share.

Every window of ``W`` symbols has an anchor: of its K-grams the one with the least hash, the leftmost of equals. Equal
windows have equal anchors at equal places, wherever they stand. A segment is a run of consecutive windows of a document
with the same anchor. So windows only have to be compared within the segments of one anchor hash, its key, and

- a key that occurs once is done: its windows are unique;
- segments of equal content share all their windows: they are compared by a hash of their content;
- only where a key has segments of different contents (where copies begin, end or differ) are the windows themselves
  compared, once for each content, by an operator's resolve().

A row is known by its doc_id and a hash of its text, so that rows that share a doc_id, or have none, are each looked at
and cut alone; the doc_id itself only tells who is smaller. A null doc_id counts as the greatest. All shuffles carry
hashes and positions, but for the contents of the last kind, and texts of rows that have such contents or lose something.

The contents of a key that has very many are dealt out to blocks of ``Plan.block`` of them; what two blocks share is found by
digests of their windows. So no task holds more than a block of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Marks, batch, checkpointed, map_arrow

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Windows of a document that are handled at once.
PART = 1 << 22
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any range of a sequence of symbol hashes, in a few array operations each."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1])

    def ranges(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x[:n] if size == w else np.minimum(x[:n], x[w - size : w - size + n])


def segments(symbols: np.ndarray, w: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, content hash, first window, windows) of a document's segments, as arrays, part by part."""
    for first in range(0, len(symbols) - w + 1, PART):
        part = symbols[first : first + PART + w - 1]
        h = Hashes(part)
        grams = h.all(k)
        # The upper 40 bits rank K-grams; below them the place, so that the minimum is the leftmost.
        order = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        anchor = sliding_min(order, w - k + 1) & np.uint64((1 << 24) - 1)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        counts = np.diff(np.append(starts, len(anchor)))
        yield grams[anchor[starts].astype(np.int64)].view(np.int64), h.ranges(starts, counts + (w - 1)).view(np.int64), starts + first, counts


class Plan:
    """How an operator sees texts: their symbols, and how contents are compared and results made."""

    def __init__(self, w: int, k: int, block: int, symbols: Callable[[str], np.ndarray], slices: Callable[[str, list[tuple[int, int]]], list[bytes]]):
        self.w, self.k, self.block, self.symbols, self.slices = w, k, block, symbols, slices


def all_segments(docs: DataFrame, plan: Plan) -> DataFrame:
    """(key, content, doc_id, row, first, windows) of every document (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ("key", "content", "doc_id", "row", "first", "windows"), (*(pa.int64(),) * 5, pa.int32())
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            size = 0
            for doc, row, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not text:
                    continue
                for key, content, first, windows in segments(plan.symbols(text), plan.w, plan.k):
                    for c, x in zip(out, (key, content, np.full(len(key), doc, np.int64), np.full(len(key), row, np.int64), first, windows.astype(np.int32)), strict=True):
                        c.append(x)
                    size += len(key)
                if size > 200_000:
                    yield batch(names, [np.concatenate(c) for c in out], types)
                    out, size = [[], [], [], [], [], []], 0
            if size:
                yield batch(names, [np.concatenate(c) for c in out], types)

    return map_arrow(docs.select(*ROW, "text"), run, "key long, content long, doc_id long, row long, first long, windows int")


def repeated_segments(docs: DataFrame, plan: Plan, across: bool) -> DataFrame:
    """The segments whose key occurs again; in another document if ``across``. Written to the checkpoint folder.

    Only segments that Marks of the repeated keys let through are shuffled to these.
    """
    found = all_segments(docs, plan)
    if across:
        keys = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    else:
        keys = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = checkpointed(keys)
    return checkpointed(Marks(keys, "key").there(found).join(keys, "key", "left_semi"))


def contents(segments_: DataFrame, plan: Plan) -> DataFrame:
    """One row a content of each key: where it stands first, how often it occurs, its key's contents and blocks, its block."""
    each = segments_.groupBy("key", "content").agg(F.min(F.struct(*ROW, "first")).alias("at"), F.count("*").alias("n"), F.max("windows").alias("windows"))
    each = checkpointed(each.select("key", "content", F.col("at.doc_id").alias("owner"), F.col("at.row").alias("row"), F.col("at.first").alias("first"), "n", "windows"))
    many = each.groupBy("key").agg(F.count("*").alias("n_contents")).where("n_contents > 1")
    blocks = F.ceil(F.col("n_contents") / plan.block).cast("int")
    return checkpointed(each.join(checkpointed(many), "key", "left").withColumn("blocks", blocks).withColumn("block", F.pmod("content", blocks).cast("int")))


def with_bytes(docs: DataFrame, wanted: DataFrame, plan: Plan, columns: str) -> DataFrame:
    """``wanted`` (owner, row, first, windows, and ``columns``) with ``data``: the symbols of each segment as bytes.

    ``columns`` is the schema of what is carried along; its names are those of ``wanted``. Of equal rows one gives the bytes.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    wanted = wanted.withColumn("doc_id", F.col("owner"))
    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("first", "windows", *names)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a join leaves equal rows next to each other, mostly; resolve() may meet a content twice
        for b in batches:
            rows: list[dict] = []
            data: list[bytes] = []
            for doc, row, text, want in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if (doc, row) == last:
                    continue
                last = doc, row
                data += plan.slices(text or "", [(x["first"], x["windows"] + plan.w - 1) for x in want])
                rows += want
            kinds = {"long": pa.int64(), "int": pa.int32()}
            schema = {c.split()[0]: kinds[c.split()[1]] for c in columns.split(", ")}
            yield batch([*names, "windows", "data"], [*[[r[n] for r in rows] for n in names], [r["windows"] for r in rows], data], [*schema.values(), pa.int32(), pa.binary()])

    near = Marks(wanted, *ROW).there(docs.select(*ROW, "text"))
    return map_arrow(near.join(lists, ROW).select(*ROW, "text", "wanted"), run, f"{columns}, windows int, data binary")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Contents dealt to tasks by key and block, those of one side by side."""
    return rows.repartition("key", "block").sortWithinPartitions("key", "block")


def true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [a, b) in which flags are set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def coverage(n: int, runs: list, extra: int) -> np.ndarray:
    """Which of n symbols the windows of ``runs`` ([a, b) of window starts) cover, each reaching ``extra`` further."""
    change = np.zeros(n + 1, np.int64)
    for r in runs:
        a, b = min(r["a"], n), min(r["b"] + extra, n)
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def removed(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, text, runs): every document with the window ranges (doc_id, row, a, b) found in it; others aren't shuffled."""
    ranges = checkpointed(ranges)
    some, free = Marks(ranges, *ROW).split(docs)
    # A set: equal rows bring the same ranges each.
    lists = ranges.groupBy(*ROW).agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    found = some.join(lists, ROW, "left").drop("row")
    return found.unionByName(free.drop("row").withColumn("runs", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")))
