"""N-gram Jaccard join by PartEnum signatures (operator 4).

A document's set holds its distinct 5-word shingles. Two sets of sizes a and b with a Jaccard similarity of at least t
differ in at most (a + b)(1 - t)/(1 + t) elements. Sizes fall into bands that grow by ``BAND``; similar sets lie in the same
or in adjacent bands, so each set signs for its own band and, where a partner can lie there, for the next. In a band whose
sets differ in at most k elements, the domain is cut by a hash into first-level partitions, and those into second-level ones;
a signature is what a set has in a subset of second-level partitions of one first-level partition. With (k2 + 1) * n1 > k
differences can't spoil every first-level partition by more than k2 second-level ones, so all similar pairs share a
signature. For large k the enumeration is cheapest with one subset a partition (n2 = 1, k2 = 0); small bands take subsets of
2 of 3 (n2 = 3, k2 = 1), which are more selective.

A partition that holds nothing of a set signs nothing: as long as a set fills more partitions than it can differ in, two
similar sets share one that isn't empty. The few sets that fill fewer sign their empty ones as well. Very frequent shingles
are left out of the domain as long as the others suffice, see signatures().

Only sets that can have a partner sign: where more than a fifth of a set's shingles occur in no other set, it has none, see
partnered(). Without that, passages that unrelated texts share chain ever more of them to one candidate component as the input
grows, whose verification is quadratic.

Sets stand for all documents that have them, so copies are one node; a set is known by 128 bits. Rows with the same
signature become a star to their least set, per task before the shuffle and per signature after it. The stars' components
hold all similar pairs. Within them an exact join verifies: sets fall into tiers by size, with those of the next tier that can be
similar as guests, and tiers into blocks of bounded size; two blocks are compared by counting the shingles that their sets
share. Verified links, as a spanning forest of each pair of blocks, give the final components.

Null or empty text: an empty set, linked with nothing, even with another. Fewer than five words: the whole sequence as one
shingle. A very long text is one set like any other. One row a row of input; rows of equal texts are linked. Rows without
doc_id link and pass links on as others do, but never are the least; where a component has none but them, its id is null.
Ties can't occur: of rows alike in doc_id and text each gets the same. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, ROW, Marks, batch, checkpointed, identified, map_arrow, word_hashes
from tidemark.llm.windows import Hashes, mix

WORDS, PERCENT, BAND = 5, 80, 1.6
#: Sets of a block of the exact join, and shingles of all its sets; signatures that a task holds before it sends them on.
BLOCK, ELEMENTS, HELD = 2048, 4_000_000, 600_000
#: Shingles that a round of the exact join deals out, as a multiple of those of all sets.
DEALT = 1.0
#: Frequent shingles: of a task, of all (8 bytes each in a broadcast), and how often one has to be seen.
HOT_TASK, HOT, HOT_LEAST = 1 << 15, 1 << 16, 32
#: Of so many shingles one is looked for in other sets; buckets that these are dealt to; sets that a task sends at once.
EVERY, BUCKETS, SENT = 3, 1024, 1 << 16


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = Hashes(np.fromiter(map(word_hashes.__getitem__, w), np.uint64, len(w)))
    return np.unique(h.all(min(words, len(w))))


def set_key(x: np.ndarray) -> bytes:
    """A hash of a set, of 16 bytes."""
    low = (int(mix(x).sum()) * 0x9E3779B97F4A7C15 + len(x)) % (1 << 64)
    high = (int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum()) + int(mix(x + np.uint64(0x2545F4914F6CDD1D)).max(initial=0))) % (1 << 64)
    return low.to_bytes(8, "little") + high.to_bytes(8, "little")


def node_of(key: bytes) -> int:
    """Half a set's hash as a signed long: what signatures carry. Sets that share it are compared like candidates."""
    return int.from_bytes(key[:8], "little", signed=True)


@cache
def band(size: int, percent: int = PERCENT) -> int:
    """The band of a set's size."""
    return floor(log(size) / log(BAND) + 1e-9)


@cache
def scheme(b: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of a band: its sets, and partners from the band below, differ in at most k elements."""
    most = ceil(BAND ** (b + 1))
    k = floor(2 * most * (100 - percent) / (100 + percent))
    n2, k2 = (3, 1) if k < 12 else (1, 0)
    return k, ceil((k + 1) / (k2 + 1)) + (2 if 0 < k < 12 else 0), n2, k2


def enumerate_subsets(x: np.ndarray, salt: np.uint64, n1: int, n2: int, most: int, empty: bool) -> tuple[np.ndarray, bool]:
    """Signatures of the elements x by n1 * n2 partitions, and whether a set that differs in ``most`` elements must share one.

    With n2 = 1 a signature is a partition; else all but one of n2 second-level partitions. ``empty``: where the answer is
    no, partitions that hold nothing sign too, which makes it yes.
    """
    where = mix(x ^ salt)
    cell = ((where >> np.uint64(33)) % np.uint64(n1) * np.uint64(n2) + (where & np.uint64(0xFFFF)) % np.uint64(n2)).astype(np.int64)
    total = np.zeros(n1 * n2, np.uint64)
    np.add.at(total, cell, mix(x))
    full = (np.bincount(cell, minlength=n1 * n2) > 0).reshape(n1, n2)
    total = total.reshape(n1, n2)
    names = np.arange(n1, dtype=np.uint64)
    # Differences spoil a first-level partition with one of n2 = 1, else with two in different second-level ones.
    sure = full.sum() > most if n2 == 1 else 2 * (full.sum(axis=1) >= 2).sum() > most
    out = []
    for left_out in range(n2):
        rest = [j for j in range(n2) if j != left_out] or [0]
        value = sum((total[:, j] * np.uint64(2 * j + 3) for j in rest), np.zeros(n1, np.uint64))
        keep = full[:, rest].any(axis=1) | (empty and not sure)
        tag = names[keep] * np.uint64(n2) + np.uint64(left_out)
        out.append(mix((value[keep] + tag) * np.uint64(0x9E3779B97F4A7C15) + tag ^ salt))
    return np.concatenate(out), bool(sure)


def signatures(x: np.ndarray, hot: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set.

    Very frequent shingles would give unrelated sets common signatures. Leaving any fixed elements ``hot`` (sorted) out of
    the domain only lowers differences, so first the others sign alone. Where they fill too few partitions to be sure, they
    sign by twice as many; where even that is too few, the set is nearly all hot, and the whole of it signs. Of two
    similar sets, either one is sure at a step, and the other takes that step as well, or both go on.
    """
    n = len(x)
    if not n:
        return np.empty(0, np.uint64)
    own = band(n)
    bands = [own]
    if n * 100 / percent >= BAND ** (own + 1) - 1:
        bands.append(own + 1)
    # What this set can differ in from any similar one, the larger ones included.
    most = floor((n + floor(n * 100 / percent)) * (100 - percent) / (100 + percent))
    rare = x
    if hot is not None and len(hot):
        rare = x[hot[np.minimum(hot.searchsorted(x), len(hot) - 1)] != x]
    out = []
    for b in bands:
        k, n1, n2, _ = scheme(b, percent)
        salts = mix(np.arange(3, dtype=np.uint64) + np.uint64(b * 7919 + 1))
        found, sure = enumerate_subsets(rare, salts[0], n1, n2, most, False)
        out.append(found)
        if not sure:
            found, sure = enumerate_subsets(rare, salts[1], 2 * (k + 1), 1, most, False)
            out.append(found)
        if not sure:
            out.append(enumerate_subsets(x, salts[2], n1, n2, most, True)[0])
    return np.unique(np.concatenate(out))


def sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row, set_key, node, n_shingles, hot, df) of every row of identified(); set_key is null for an empty set.

    Further rows have ``hot`` instead: shingles that a task has found frequent, at most HOT_TASK of them, and how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ("doc_id", "row", "set_key", "node", "n_shingles", "hot", "df"), (pa.int64(), pa.int64(), pa.binary(), *(pa.int64(),) * 4)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size, values, counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)

        def count() -> None:
            nonlocal held, size, values, counts
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c > 2
            u, c = np.concatenate([values, u[keep]]), np.concatenate([counts, c[keep]])
            values, inverse = np.unique(u, return_inverse=True)
            counts = np.bincount(inverse, c, len(values)).astype(np.int64)
            if len(values) > HOT_TASK:
                top = np.sort((-counts).argsort(kind="stable")[:HOT_TASK])
                values, counts = values[top], counts[top]
            held, size = [], 0

        for b in batches:
            got = [shingles(x, words) for x in b.column(2).to_pylist()]
            keys = [set_key(x) if len(x) else None for x in got]
            nodes = [node_of(k) if k else None for k in keys]
            none = pa.nulls(len(got), pa.int64())
            yield batch(names, (b.column(0), b.column(1), keys, nodes, [len(x) for x in got], none, none), types)
            for i, x in zip(nodes, got, strict=True):
                if i is not None and i not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(i)
                    held.append(x)
                    size += len(x)
                    if size > HELD:
                        count()
        if size:
            count()
        if len(values):
            none = pa.nulls(len(values), pa.int64())
            yield batch(names, (none, none, pa.nulls(len(values), pa.binary()), none, none, values.view(np.int64), counts), types)

    return map_arrow(rows.select(*ROW, "text"), run, "doc_id long, row long, set_key binary, node long, n_shingles long, hot long, df long")


def hot_shingles(found: DataFrame) -> np.ndarray:
    """The most frequent shingles of sets(), at most HOT of them: any choice gives the same links."""
    rows = found.where("hot is not null").groupBy("hot").agg(F.sum("df").alias("df")).where(F.col("df") >= HOT_LEAST).orderBy(F.desc("df"), "hot").limit(HOT).collect()
    return np.sort(np.array([r.hot for r in rows], np.int64).view(np.uint64))


def partnered(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of identified() but those whose set surely has no similar other one; of equal sets at least one row stays.

    What a set has alone, any other lacks, and a similar one may lack (100 - percent) of 100 at most. One of EVERY shingles
    is counted, the same in all sets: what it shows alone is a lower bound. So is what 42 bits of a hash tell apart. Shingles
    travel as 6 bytes each to their bucket, and the places of the lonely ones as 2 bytes each back to the sets sent together.
    """
    blob = "sent long, bucket int, data binary"
    types = (pa.int64(), pa.int32(), pa.binary())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        held: list[np.ndarray] = []
        heads: list[tuple[int, int, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            at = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            where = (x >> np.uint64(54)).astype(np.int64)
            order = where.argsort(kind="stable")
            x, at = x[order].astype(np.uint32), at[order]
            ends = np.searchsorted(where[order], np.arange(BUCKETS + 1))
            some = np.flatnonzero(np.diff(ends))
            data = [at[ends[k] : ends[k + 1]].tobytes() + x[ends[k] : ends[k + 1]].tobytes() for k in some]
            # The sets themselves pass through; a bucket past the others spreads them.
            head = BUCKETS + sent % BUCKETS
            return batch(("sent", "bucket", "data"), ([sent] * (len(some) + 1), [*some.tolist(), head], [*data, np.array(heads, np.int64).tobytes()]), types)

        for b in batches:
            for doc, row, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x = shingles(text, words)
                if not len(x) or (i := node_of(set_key(x))) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(i)
                held.append(x[(x >> np.uint64(32)) % np.uint64(EVERY) == 0])
                heads.append((doc, row, len(x)))
                size += len(held[-1])
                if size >= HELD or len(held) == SENT:
                    yield out()
                    held, heads, size, sent = [], [], 0, sent + 1
        if heads:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple[int, bytes]]) -> pa.RecordBatch:
            at = [np.frombuffer(d, np.uint16, len(d) // 6) for _, d in group]
            x = np.concatenate([np.frombuffer(d, np.uint32, len(d) // 6, len(d) // 6 * 2) for _, d in group])
            order = x.argsort(kind="stable")
            again = x[order][1:] == x[order][:-1]
            lonely = np.ones(len(x), bool)
            lonely[order[1:][again]] = lonely[order[:-1][again]] = False
            flags = np.split(lonely, np.cumsum([len(a) for a in at])[:-1])
            return batch(("sent", "bucket", "data"), ([s for s, _ in group], [0] * len(group), [a[f].tobytes() for a, f in zip(at, flags, strict=True)]), types)

        last, group = None, []
        for b in batches:
            for sent, bucket, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != last and group:
                    yield settle(group)
                    group = []
                last = bucket
                if bucket >= BUCKETS:
                    yield batch(("sent", "bucket", "data"), ([sent], [-1], [data]), types)
                else:
                    group.append((sent, data))
        if group:
            yield settle(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, lonely = np.empty((0, 3), np.int64), np.empty(0, np.int64)

        def kept() -> pa.RecordBatch:
            stay = heads[100 * lonely <= (100 - percent) * heads[:, 2]]
            return batch(ROW, (stay[:, 0], stay[:, 1]), (pa.int64(), pa.int64()))

        for b in batches:
            for bucket, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket < 0:  # first of what was sent together
                    yield kept()
                    heads = np.frombuffer(data, np.int64).reshape(-1, 3)
                    lonely = np.zeros(len(heads), np.int64)
                else:
                    lonely += np.bincount(np.frombuffer(data, np.uint16), minlength=len(heads))
        yield kept()

    met = map_arrow(map_arrow(rows.select(*ROW, "text"), send, blob).repartition("bucket").sortWithinPartitions("bucket"), meet, blob)
    stay = checkpointed(map_arrow(met.repartition("sent").sortWithinPartitions("sent", "bucket"), count, "doc_id long, row long"))
    return Marks(stay, *ROW).there(rows)


def stars(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows, sorted by signature and node, come first of their signature; and the edges of the others to those."""
    lead = np.concatenate([[True], signature[1:] != signature[:-1]])
    head = node[lead][np.cumsum(lead) - 1]
    edge = ~lead & (node != head)
    return lead, node[edge], head[edge]


def candidate_edges(rows: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: np.ndarray | None = None) -> DataFrame:
    """(u, v), u > v: stars that connect all sets with a common signature."""
    frequent = rows.sparkSession.sparkContext.broadcast(hot)
    names, types = ("signature", "v"), (pa.int64(), pa.int64())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            s, v = np.concatenate(held), np.concatenate(nodes)
            order = np.lexsort((v, s))
            s, v = s[order], v[order]
            lead, u, head = stars(s, v)
            s, v = s[lead], v[lead]
            if len(u):
                # An edge found here travels as two rows with a signature of its own, so that edges spread.
                pairs = np.unique(np.stack([u, head], 1), axis=0)
                own = mix(mix(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64))
                s, v = np.concatenate([s, own, own]), np.concatenate([v, pairs[:, 0], pairs[:, 1]])
            # Equal nodes side by side: the shuffle's compression halves their bytes.
            order = v.argsort(kind="stable")
            s, v = s[order], v[order]
            return batch(names, (s.view(np.int64), v), types)

        for b in batches:
            for text in b.column(0).to_pylist():
                x = shingles(text, words)
                if not len(x) or (i := node_of(set_key(x))) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(i)
                held.append(signatures(x, frequent.value, percent))
                nodes.append(np.full(len(held[-1]), i, np.int64))
                size += len(held[-1])
                if size >= HELD:
                    yield send()
                    held, nodes, size = [], [], 0
        if size:
            yield send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_s, last_v = None, None
        for b in batches:
            if not b.num_rows:
                continue
            s, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last_s is not None and s[0] == last_s:
                s, v = np.concatenate([[last_s], s]), np.concatenate([[last_v], v])
            lead, u, head = stars(s, v)
            last_s, last_v = s[-1], v[np.flatnonzero(lead)[-1]]
            found = np.unique(np.stack([u, head], 1), axis=0)
            yield batch(("u", "v"), (found.max(axis=1, initial=-(1 << 63)), found.min(axis=1, initial=(1 << 63) - 1)), types)

    signed = map_arrow(rows.select("text"), sign, "signature long, v long")
    met = map_arrow(signed.repartition("signature").sortWithinPartitions("signature", "v"), meet, "u long, v long")
    return checkpointed(met.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for all nodes of ``edges`` (u, v) but the roots themselves.

    Large star and small star in turn until nothing changes; roots keep their stars without a join.
    """
    now, before = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        roots = now.select(F.col("v").alias("x"), "u").join(least.select(F.col("u").alias("x"), "m"), "x", "left").select("u", F.coalesce("m", "x").alias("v"))
        large = roots.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def shared(row: np.ndarray, column: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many columns each row of ``left`` has in common with each of ``right``; row and column list what there is.

    Columns that many rows have are multiplied as matrices, those of few are counted pair by pair.
    """
    place = [np.full(int(row.max(initial=0)) + 1, -1, np.int64) for _ in "ab"]
    for p, m in zip(place, (left, right), strict=True):
        p[m[m < len(p)]] = np.flatnonzero(m < len(p))
    common = np.zeros((len(left), len(right)), np.int32)
    order = column.argsort(kind="stable")
    row, column = row[order], column[order]
    _, first, count = np.unique(column, return_index=True, return_counts=True)
    frequent = count > max(8, (len(left) + len(right)) // 32)
    for chosen in np.array_split(np.flatnonzero(frequent), max(1, -(-int(frequent.sum()) // 1024))):
        if len(chosen):
            at = np.concatenate([np.arange(first[c], first[c] + count[c]) for c in chosen])
            local = np.repeat(np.arange(len(chosen)), count[chosen])
            x = []
            for p, m in zip(place, (left, right), strict=True):
                x.append(np.zeros((len(m), len(chosen)), np.float32))
                here = p[row[at]]
                x[-1][here[here >= 0], local[here >= 0]] = 1
            common += (x[0] @ x[1].T).astype(np.int32)
    for d in np.unique(count[~frequent]):
        if d > 1:
            # All columns of d rows at once: d * d pairs each.
            rows = row[first[~frequent & (count == d)][:, None] + np.arange(d)]
            a, b = place[0][rows], place[1][rows]
            for k in range(0, len(rows), max(1, 4_000_000 // int(d * d))):
                part = slice(k, k + max(1, 4_000_000 // int(d * d)))
                i, j = np.broadcast_arrays(a[part, :, None], b[part, None, :])
                ok = (i >= 0) & (j >= 0)
                common += np.bincount(i[ok] * len(right) + j[ok], minlength=common.size).reshape(common.shape).astype(np.int32)
    return common


def similar(ids: list, contents: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple]:
    """A spanning forest of the pairs at the threshold between two sides (or within one, where all sides are 0)."""
    n = len(ids)
    sizes = np.array([len(c) for c in contents], np.int64)
    every = np.sort(np.concatenate(contents))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    at = [again.searchsorted(c) for c in contents]
    keep = [again[np.minimum(x, len(again) - 1)] == c for x, c in zip(at, contents, strict=True)] if len(again) else [np.zeros(len(c), bool) for c in contents]
    row = np.repeat(np.arange(n), [int(k.sum()) for k in keep])
    column = np.concatenate([x[k] for x, k in zip(at, keep, strict=True)])
    left = np.flatnonzero(side == 0) if side.any() else np.arange(n)
    right = np.flatnonzero(side) if side.any() else left
    common = shared(row, column, left, right)
    # 100 * common >= percent * (a + b - common), in whole numbers.
    i, j = np.nonzero((100 + percent) * common.astype(np.int64) >= percent * (sizes[left][:, None] + sizes[right][None, :]))
    parent = list(range(n))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            parent[a] = b
            out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return out


def verified(rows: DataFrame, members: DataFrame, candidates: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """(u, v): links between set keys that connect all similar sets of each candidate component.

    ``members``: (doc_id, row, set_key, node, n_shingles); ``candidates``: (node, root). A component that is no larger than a
    block is compared whole; of others, blocks of sets of similar size, each pair of them a task's work of bounded size.
    A text goes to every pair that its block is in, which grows with the square of a component. So the pairs are dealt to
    rounds, whose shuffle files are gone before the next: the disk that one takes follows the input.
    """
    roots = candidates.select(F.col("root").alias("node"), "root").distinct()
    nodes = candidates.unionByName(roots)
    each = members.where("set_key is not null").groupBy("set_key").agg(F.min("node").alias("node"), F.min("n_shingles").alias("n"), F.min(F.struct(*ROW)).alias("at"))
    wanted = checkpointed(each.join(nodes, "node").select("root", "set_key", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row")))
    blocks = lambda sets_, total: F.ceil(F.greatest(sets_ / block, total / elements)).cast("int")
    whole = wanted.groupBy("root").agg((blocks(F.count("*"), F.sum("n")) <= 1).alias("whole"))
    # Tier t has sizes from 2**t on; a set is a guest in the tier below its own if a set of that can be similar to it.
    t = F.length(F.bin("n")) - 1
    guest = F.col("n") * percent <= 100 * (F.pow(F.lit(2.0), t).cast("long") - 1)
    tiers = F.when(F.col("whole"), F.array(F.lit(-1))).otherwise(F.when(guest, F.array(t, t - 1)).otherwise(F.array(t)))
    placed = wanted.join(whole, "root").select("root", "set_key", "n", *ROW, F.explode(tiers).alias("tier"))
    sized = placed.groupBy("root", "tier").agg(blocks(F.count("*"), F.sum("n")).alias("blocks"))
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    # A block meets itself and every other of its tier.
    pair = lambda k: F.struct("root", "tier", F.least(own, k).alias("a"), F.greatest(own, k).alias("b"), F.when(own <= k, 0).otherwise(1).alias("side"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)
    wanted = checkpointed(placed.join(sized, ["root", "tier"]).select("root", "tier", "set_key", "n", "blocks", *ROW))
    dealt_out, all_ = wanted.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0, each.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, ceil(dealt_out / max(1, DEALT * all_)))

    def dealt(k: int) -> DataFrame:
        here = F.filter(cells, lambda c: F.pmod(F.xxhash64(c.root, c.tier, c.a, c.b), F.lit(rounds)) == k)
        some = wanted.select("set_key", *ROW, here.alias("cells")).where("size(cells) > 0")
        # Rows alike in doc_id and text give the same set; dropped where they meet.
        near = Marks(some, *ROW).there(rows.select(*ROW, "text"))
        each_cell = near.join(some, ROW).select("text", "set_key", F.explode("cells").alias("c")).select("text", "set_key", "c.*")
        return each_cell.repartition("root", "tier", "a", "b").sortWithinPartitions("root", "tier", "a", "b", "set_key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: dict[bytes, tuple[np.ndarray, int]]) -> list[tuple]:
            return similar(list(group), [c for c, _ in group.values()], np.array([s for _, s in group.values()]), percent)

        last, group = None, {}
        for b in batches:
            edges: list[tuple] = []
            for text, key, *cell, side in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != last:
                    if len(group) > 1:
                        edges += settle(group)
                    last, group = cell, {}
                if key not in group:
                    group[key] = shingles(text, words), side
            yield batch(("u", "v"), ([e[0] for e in edges], [e[1] for e in edges]), (pa.binary(), pa.binary()))
        edges = settle(group) if len(group) > 1 else []
        yield batch(("u", "v"), ([e[0] for e in edges], [e[1] for e in edges]), (pa.binary(), pa.binary()))

    return reduce(DataFrame.unionByName, [checkpointed(map_arrow(dealt(k), compare, "u binary, v binary")) for k in range(rounds)])


def classes(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, least): every row of identified(), and the least (doc_id, row) of its component.

    ``least`` is null for an empty set.
    """
    found = checkpointed(sets(rows, words))
    members, hot = found.where("hot is null").drop("hot", "df"), hot_shingles(found)
    links = verified(rows, members, components(candidate_edges(partnered(rows, words, percent), words, percent, hot)), words, percent)
    found = components(links)
    # The least row of a set, then of a component: pre-aggregated before each shuffle.
    least = members.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(*ROW)).alias("least"))
    rooted = least.join(found.select(F.col("node").alias("set_key"), "root"), "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of_set = checkpointed(rooted.select("set_key", "root").join(of_root, "root").select("set_key", "least"))
    return members.join(of_set, "set_key", "left").select(*ROW, "n_shingles", "least")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    known = lambda c: F.when(c != NULL_ID, c)
    return classes(identified(docs), words, percent).select(known(F.col("doc_id")).alias("doc_id"), "n_shingles", known(F.coalesce("least.doc_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the least by doc_id, then by its text's hash; empty sets all stay.

    Of rows alike in doc_id and text one stays, the first by its other columns as JSON.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = identified(docs, rest)
    found = checkpointed(classes(rows, words, percent))
    own = F.struct(*ROW)
    gone = found.where(F.col("least").isNotNull() & (F.col("least") != own)).select(*ROW).distinct()
    twice = found.groupBy(*ROW).agg(F.count("*").alias("n")).where("n > 1").select(*ROW)
    gone = checkpointed(gone)
    some, free = Marks(gone.unionByName(twice), *ROW).split(rows)
    kept = some.join(gone, ROW, "left_anti")
    text = F.min("text").alias("text")
    kept = kept.groupBy(*ROW).agg(text, F.min_by("rest", F.to_json("rest")).alias("rest")) if rest else kept.groupBy(*ROW).agg(text)
    out = kept.select(*rows.columns).unionByName(free)
    own_columns = {"doc_id": F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": F.col("text")}
    return out.select(*[own_columns[c] if c in own_columns else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
