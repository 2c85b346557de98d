"""Substring dedup by a compressed FM-index a shard (operator 2).

Windows of ``WINDOW`` words that also start in a document of smaller doc_id are removed. windows.py finds the candidate
segments and settles those of equal content. Where a key has several contents, shards of such contents get an FM-index:
the Burrows-Wheeler transform of their words in a wavelet matrix of packed bits with sampled counts. The contents are
streamed through it: backward search from each word gives its matching statistic, the length of the longest match that
ends there, up to the threshold; a match counts while one of its documents is smaller than the streamed one's, which a
range minimum over the suffixes' documents tells. Ends of statistics at the threshold are the reported intervals.

A literal index of every shard against every streamed document would take work that grows with the square of the corpus;
the segments route a passage to the one shard that can hold it, with the same result.

Null text: no words. Texts of fewer words than a window lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, ROW, batch, bounded_batches, cache_of, checkpointed, identified, map_arrow, word_hashes
from tidemark.llm.windows import Plan, contents, coverage, in_blocks, removed, repeated_segments, true_runs, with_bytes

WINDOW, GRAM = 50, 25
#: Words of a shard, and contents of a key that share a shard: those of a key with more are dealt to several.
SHARD, BLOCK = 150_000, 1024


def symbols(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))


def slices(text: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    words = text.encode().split()
    return [b" ".join(words[a : a + n]) for a, n in ranges]


class Wavelet:
    """Ranks of symbols in a sequence: a wavelet matrix of 64-bit words and a running count for each."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        n = len(x)
        for level in range(bits - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def ranks(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where place ``at`` goes on its way down by the bits of ``c``; differences of these are ranks."""
        at = at.astype(np.int64)
        for level in range(self.bits):
            block = at >> 6
            ones = self.counts[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(c >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at


class FmIndex:
    """Backward search over documents given as word numbers from 1; 0 parts them. Matches up to ``depth`` words are exact."""

    def __init__(self, docs: list[np.ndarray], owners: list[int], words: int, depth: int):
        text = np.concatenate([np.concatenate([d, [0]]) for d in docs])
        n = len(text)
        rank, h = text.astype(np.int64), 1
        while True:
            ahead = np.concatenate([rank[h:], np.full(min(h, n), -1)]) + 1
            pair = rank * (n + words + 2) + ahead
            order = pair.argsort(kind="stable")
            s = pair[order]
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            h *= 2
            if h > depth or rank[order[-1]] == n - 1:
                break
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words + 2))[:-1]])
        self.wavelet = Wavelet(before.astype(np.int64), max(1, int(words + 1).bit_length()))
        every = np.arange(words + 2)
        self.base = self.wavelet.ranks(np.zeros(words + 2, np.int64), every)
        # Range minima of the suffixes' owners.
        owner = np.repeat(np.asarray(owners, np.int64), [len(d) + 1 for d in docs])[order]
        self.least = [owner]
        while 2 << (len(self.least) - 1) <= n:
            x, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(x[:-half], x[half:]))
        self.n = n

    def minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner of suffixes lo to hi - 1, for hi > lo."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out

    def statistics(self, text: np.ndarray, ends: np.ndarray, floors: np.ndarray, below: np.ndarray, most: int) -> np.ndarray:
        """For each end: how many words up to it match in an owner below ``below``, at most ``most``, not past its floor."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        got = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(most):
            live = live[ends[live] - step >= floors[live]]
            if not len(live):
                break
            c = text[ends[live] - step]
            both = self.wavelet.ranks(np.concatenate([lo[live], hi[live]]), np.concatenate([c, c]))
            a = self.first[c] + both[: len(c)] - self.base[c]
            b = self.first[c] + both[len(c) :] - self.base[c]
            ok = b > a
            ok[ok] = self.minimum(a[ok], b[ok]) < below[live[ok]]
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            got[live] = step + 1
        return got


def earlier_windows(data: list[bytes], owners: list[int], w: int = WINDOW) -> list[np.ndarray]:
    """For each content of a shard: which of its windows a content of a smaller owner has."""
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(x, len(number) + 1) for x in d.split(b" ")], np.int64) for d in data]
    index = FmIndex(docs, owners, len(number), w)
    text = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - w + 1, 0)
    which = np.repeat(np.arange(len(docs)), windows)
    start = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + first[which]
    got = index.statistics(text, start + w - 1, first[which], np.asarray(owners, np.int64)[which], w)
    return np.split(got >= w, np.cumsum(windows)[:-1])


def resolve(rows: DataFrame, w: int = WINDOW) -> DataFrame:
    """(key, content, a, b): windows of contents (key, block, content, owner, data) that a smaller owner of their block has too.

    Rows of a block come one after the other; small blocks share a shard and its FM-index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple]) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for (key, _, content, *_), flags in zip(group, earlier_windows([g[4] for g in group], [g[3] for g in group], w), strict=True):
                for a, b in true_runs(flags):
                    for c, v in zip(out, (key, content, a, b), strict=True):
                        c.append(v)
            return batch(("key", "content", "a", "b"), out, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))

        shard: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= SHARD and row[:2] != last:
                    yield settle(shard)
                    shard, size = [], 0
                shard.append(row)
                size += row[4].count(b" ") + 2
                last = row[:2]
        if shard:
            yield settle(shard)

    return map_arrow(rows.select("key", "block", "content", "owner", "data"), run, "key long, content long, a long, b long")


def resolve_blocks(rows: DataFrame, w: int = WINDOW) -> DataFrame:
    """As resolve(), for what the blocks of a key share: by digests of the windows, pre-aggregated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, content, owner, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                words = data.split(b" ")
                for a in range(len(words) - w + 1):
                    for c, v in zip(out, (key, content, owner, a, b" ".join(words[a : a + w])), strict=True):
                        c.append(v)
            yield batch(("key", "content", "owner", "a", "window"), out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))

    each = map_arrow(rows.select("key", "content", "owner", "data"), run, "key long, content long, owner long, a long, window binary")
    each = each.select("key", "content", "owner", "a", F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(1), "window").alias("h2"))
    least = each.groupBy("h1", "h2").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("h1", "h2", "least")
    return each.join(least, ["h1", "h2"]).where("least < owner").select("key", "content", "a", (F.col("a") + 1).alias("b"))


def plan(w: int = WINDOW, block: int = BLOCK) -> Plan:
    return Plan(w, w // 2, block, symbols, slices)


def dedup(docs: DataFrame, w: int = WINDOW, block: int = BLOCK, rest: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, rest, runs): every document with the ranges of windows that start in a smaller document too."""
    rows, p = identified(docs, rest), plan(w, block)
    found = repeated_segments(rows, p, across=True)
    each = contents(found, p)
    several = checkpointed(with_bytes(rows, each.where("n_contents > 1"), p, "key long, block int, blocks int, content long, owner long"))
    parts = resolve(in_blocks(several), w).unionByName(resolve_blocks(several.where("blocks > 1"), w))
    lists = parts.groupBy("key", "content").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    info = checkpointed(each.select("key", "content", "owner").join(lists, ["key", "content"], "left"))
    seen = found.join(info, ["key", "content"])
    whole = seen.where(F.col("doc_id") > F.col("owner")).select(*ROW, F.col("first").alias("a"), (F.col("first") + F.col("windows")).alias("b"))
    some = seen.where((F.col("doc_id") == F.col("owner")) & F.col("parts").isNotNull()).select(*ROW, "first", F.explode("parts").alias("x"))
    ranges = whole.unionByName(some.select(*ROW, (F.col("first") + F.col("x.a")).alias("a"), (F.col("first") + F.col("x.b")).alias("b")))
    return removed(rows, ranges)


def kept_words(text: str, runs: list | None, w: int = WINDOW) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by a space."""
    words = text.encode().split()
    if not runs:
        return len(words), 0, b" ".join(words)
    gone = coverage(len(words), runs, w - 1)
    return len(words), int(gone.sum()), b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])


def digests(found: DataFrame, w: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of dedup()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_words(t or "", r, w) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            ids = [None if x == NULL_ID else x for x in b.column(0).to_pylist()]
            yield batch(("doc_id", "n_words", "n_removed", "kept_sha256"), (ids, [g[0] for g in got], [g[1] for g in got], [hashlib.sha256(g[2]).hexdigest() for g in got]), (pa.int64(), pa.int64(), pa.int64(), pa.string()))

    return map_arrow(found.select("doc_id", "text", "runs"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_text(text: Column, runs: Column, w: int = WINDOW) -> Column:
    """A text without the words that ``runs`` cover, the others joined by a space; as it is where nothing goes."""

    bounded_batches(SparkSession.active())

    @F.arrow_udf("string")
    def kept(t: pa.Array, r: pa.Array) -> pa.Array:
        cache_of(__name__)
        return pa.array([x if not y else kept_words(x or "", y, w)[2].decode() for x, y in zip(t.to_pylist(), r.to_pylist(), strict=True)], pa.string())

    return F.when(runs.isNull(), text).otherwise(kept(text, runs))


def clean(docs: DataFrame, w: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with the kept words of each text joined by a space; texts that lose nothing stay as they are."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = dedup(docs, w, block, rest)
    own = {"doc_id": F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": kept_text(F.col("text"), F.col("runs"), w).alias("text")}
    return found.select(*[own[c] if c in own else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
