"""Suffix-array dedup of byte strings by anchors and prefix doubling (operator 6).

Bytes covered by a string of ``WINDOW`` bytes that starts anywhere else too are removed, in every place. Hashes that Spark
counts and groups stand in for rank rounds that it would sort; only the last step doubles, inside one worker:

- windows.py chooses an anchor of ``GRAM`` bytes for every window; Spark counts the anchors' hashes, and anchors that occur
  once end there with all windows around them;
- Spark groups by a hash of the anchor with what stands on both sides of it, as far as its windows reach; equal ones are
  equal in all their windows;
- what is left are anchors with different surroundings, once for each. Their windows are ranked by doubling within the
  anchor's group: ranks of 100 bytes, then pairs of ranks at offset 100, then at 200, dropping unique ones, to 400.

Doubling from single bytes over every position of the corpus would shuffle some 20 bytes a byte and round.

Null text: empty. Texts shorter than a window lose nothing. Matches never cross texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, ROW, batch, checkpointed, identified, map_arrow
from tidemark.llm.windows import Hashes, Plan, contents, coverage, in_blocks, mix, removed, repeated_segments, true_runs, with_bytes

WINDOW, GRAM = 400, 200
#: Bytes of contents that are ranked together, and contents of a key that are: those of a key with more are dealt to several blocks.
SHARD, BLOCK = 4_000_000, 1024
#: Widths of the bands of resolve_blocks(), each a multiple of the next.
SPANS = (56, 8, 1)
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def symbols(text: str) -> np.ndarray:
    return TABLE[np.frombuffer(text.encode(), np.uint8)]


def slices(text: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    data = text.encode()
    return [data[a : a + n] for a, n in ranges]


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks, and how often each value occurs."""
    u, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return inverse, counts[inverse]


def repeated_windows(data: list[bytes], w: int = WINDOW) -> list[np.ndarray]:
    """For each content: which of its windows start anywhere else in these contents too, by prefix doubling."""
    sizes = np.array([len(d) for d in data])
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - w + 1, 0)
    which = np.repeat(np.arange(len(data)), windows)
    at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + first[which]
    out = np.zeros(len(which), bool)
    if len(at):
        h = w // 4
        # Ranks of h bytes at every position a pair can ask for; positions past a content's end are never asked for.
        every = Hashes(TABLE[np.frombuffer(b"".join(data), np.uint8)]).all(h)
        left = np.arange(len(at))
        now = every[at]
        for step in (h, 2 * h):
            rank, count = ranks(now)
            left, rank = left[count > 1], rank[count > 1]
            if not len(left):
                break
            here = at[left]
            ahead = every[here + step] if step == h else every[here + step] * np.uint64(0x9E3779B97F4A7C15) + every[here + step + h]
            now = mix(rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(ahead))
        if len(left):
            tail = w - 4 * h
            if tail:
                now = mix(now + every[at[left] + w - h])
            out[left[ranks(now)[1] > 1]] = True
    return np.split(out, np.cumsum(windows)[:-1])


def resolve(rows: DataFrame, w: int = WINDOW) -> DataFrame:
    """(key, content, a, b): windows of contents (key, block, content, data) that occur elsewhere in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple]) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for (key, _, content, _), flags in zip(group, repeated_windows([g[3] for g in group], w), strict=True):
                for a, b in true_runs(flags):
                    for c, v in zip(out, (key, content, a, b), strict=True):
                        c.append(v)
            return batch(("key", "content", "a", "b"), out, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))

        shard: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= SHARD and row[:2] != last:
                    yield settle(shard)
                    shard, size = [], 0
                shard.append(row)
                size += len(row[3])
                last = row[:2]
        if shard:
            yield settle(shard)

    return map_arrow(rows.select("key", "block", "content", "data"), run, "key long, content long, a long, b long")


def bands(data: bytes, w: int, k: int, span: int, wanted: list[int] | None, above: int) -> list[tuple]:
    """(band, top, a, b, k1, k2, u1, u2) of a content's windows [a, b) by bands of ``span`` places of the anchor in a window.

    k1 and k2 are digests of the bytes that all windows of a band share, u1 and u2 of those that this content's together
    have, which begin ``top`` bytes before the anchor. ``wanted`` names bands of width ``above``; None stands for all.
    """
    x = TABLE[np.frombuffer(data, np.uint8)]
    h1, h2 = Hashes(x), Hashes(mix(x + np.uint64(1)))
    n = len(x) - w + 1
    place = int((h1.all(k)[: w - k + 1] >> np.uint64(24)).argmin())
    low, high = place - n + 1, place
    all_ = range(low // span * span, high + 1, span)
    band = np.array(all_ if wanted is None else [y for z in wanted for y in range(z, z + above, span) if y + span > low and y <= high], np.int64)
    top, bottom = np.minimum(band + span - 1, high), np.maximum(band, low)
    key, size = place - band, np.full(len(band), w - span + 1)
    all_of, reach = place - top, top - bottom + w
    columns = (h.ranges(start, length).view(np.int64) for start, length in ((key, size), (all_of, reach)) for h in (h1, h2))
    return list(zip(*(c.tolist() for c in (band, top, place - top, place - bottom + 1, *columns)), strict=True))


def resolve_blocks(rows: DataFrame, w: int = WINDOW) -> DataFrame:
    """As resolve(), for what the blocks of a key share, by digests that Spark counts.

    Equal windows have the anchor at equal places. Windows are taken by bands of places: where a band's common bytes occur
    once, its windows do too; where all its bytes occur again, so do its windows. Only a band that shares its common bytes
    with others of other bytes, one for each, is looked at by narrower bands, to single windows.
    """
    names, types = ("key", "content", "band", "top", "a", "b", "k1", "k2", "u1", "u2"), (pa.int64(),) * 10
    found, wanted, above = None, rows.select("key", "content", "data").withColumn("bands", F.lit(None).cast("array<bigint>")), 0
    for span in SPANS:

        def run(batches: Iterator[pa.RecordBatch], span: int = span, above: int = above) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(key, content, *x) for key, content, data, some in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True) for x in bands(data, w, w // 2, span, some, above)]
                if out:
                    yield batch(names, list(zip(*out, strict=True)), types)

        each = checkpointed(map_arrow(wanted, run, ", ".join(f"{n} long" for n in names)))
        shared, whole = ["band", "k1", "k2"], ["band", "k1", "k2", "top", "b_a", "u1", "u2"]
        each = each.withColumn("b_a", F.col("b") - F.col("a"))
        groups = checkpointed(each.groupBy(*whole).agg(F.count("*").alias("n"), F.min(F.struct("key", "content")).alias("at")))
        again = each.join(groups.where("n > 1").select(*whole), whole, "left_semi").select("key", "content", "a", "b")
        found = again if found is None else found.unionByName(again)
        if span > 1:
            several = groups.groupBy(*shared).agg(F.count("*").alias("m")).where("m > 1").select(*shared)
            open_ = checkpointed(groups.join(several, shared, "left_semi").groupBy("at.key", "at.content").agg(F.collect_set("band").alias("bands")))
            wanted, above = rows.select("key", "content", "data").join(open_, ["key", "content"]).select("key", "content", "data", "bands"), span
    return found


def dedup(docs: DataFrame, w: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, runs): every document with the ranges of windows that start anywhere else too."""
    rows, p = identified(docs), Plan(w, w // 2, block, symbols, slices)
    found = repeated_segments(rows, p, across=False)
    each = contents(found, p)
    several = checkpointed(with_bytes(rows, each.where("n_contents > 1"), p, "key long, block int, blocks int, content long"))
    parts = resolve(in_blocks(several), w).unionByName(resolve_blocks(several.where("blocks > 1"), w))
    lists = parts.groupBy("key", "content").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    info = checkpointed(each.select("key", "content", "n").join(lists, ["key", "content"], "left").where("n > 1 or parts is not null"))
    seen = found.join(info, ["key", "content"])
    whole = seen.where("n > 1").select(*ROW, F.col("first").alias("a"), (F.col("first") + F.col("windows")).alias("b"))
    some = seen.where("n = 1").select(*ROW, "first", F.explode("parts").alias("x"))
    ranges = whole.unionByName(some.select(*ROW, (F.col("first") + F.col("x.a")).alias("a"), (F.col("first") + F.col("x.b")).alias("b")))
    return removed(rows, ranges)


def kept_bytes(text: str, runs: list | None, w: int = WINDOW) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, and the bytes that are left."""
    data = text.encode()
    if not runs:
        return len(data), 0, 0, data
    gone = coverage(len(data), runs, w - 1)
    return len(data), int(gone.sum()), len(true_runs(gone)), np.frombuffer(data, np.uint8)[~gone].tobytes()


def digests(found: DataFrame, w: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of dedup()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_bytes(t or "", r, w) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            ids = [None if x == NULL_ID else x for x in b.column(0).to_pylist()]
            yield batch(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), (ids, *[[g[k] for g in got] for k in range(3)], [hashlib.sha256(g[3]).hexdigest() for g in got]), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))

    return map_arrow(found.select("doc_id", "text", "runs"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
