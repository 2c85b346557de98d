"""Best-fit packing of token sequences with swap-based local search (operator 5).

A text longer than a sequence is cut into whole sequences and one rest; only rests have to be packed. They are dealt at
random into groups of bounded size. A group is packed best fit, longest first; then a local search over all its underfull
bins moves a document, exchanges one for one or two for one wherever that raises the sum of squared fills, until nothing
does; bins run empty on the way. All bins with room go to the next round, dealt anew, until one group holds all of them or
a round saves no sequence. Then the packing before it stands, but for the emptiest quarter of each group's bins, which go
on, a quarter each round, until one group holds all of it. No task holds more than ``GROUP`` documents, and nothing is
collected.

Null or empty text: its end-of-text id alone, one piece of length 1. Repeated rows are packed each. Tables without rows
give none. Only doc_id and text are read; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cache_of, checkpointed, documents, map_arrow, texts, tokenizer_path
from tidemark.llm.units import RecurringCache, UnitCache, together

#: Tokens of a sequence, and documents of a group.
CAPACITY, GROUP = 4096, 8192
#: Words whose ids a worker with little memory may remember; characters of texts that it encodes at once.
CACHED, TOGETHER = 300_000, 500_000
#: A bin whose room is at most a share DONE of it is not packed again in the next round. Once packing all others again
#: saves nothing, one bin in REOPENED, the emptiest, is.
REOPENED, DONE = 4, 1 / 1024
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"


#: The vocabulary's pattern for lower-cased Latin-1, and the end of a word's last token.
PRETOKENS = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
END = "</w>"
#: The characters that byte level stands for bytes with; spaces stay.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
HIDDEN = [x for x in range(256) if x not in SHOWN]
LEVEL = np.array([x if x in SHOWN or x == 32 else 256 + HIDDEN.index(x) for x in range(256)], "<u4")


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def folds(path: str) -> bool:
    """Whether a vocabulary lower-cases, cuts by the pattern that PRETOKENS is of, and ends words by END, over all bytes."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    normalizers = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    m, characters = j["model"], [*map(chr, LEVEL[np.arange(256) != 32].tolist()), chr(256 + HIDDEN.index(32))]
    return (
        j["normalizer"] == {"type": "Sequence", "normalizers": normalizers} and j["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level]} and m["type"] == "BPE"
        and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")) and m["end_of_word_suffix"] == END and all(c in m["vocab"] and c + END in m["vocab"] for c in characters)
    )


def unit_ids(path: str):
    """encode(units) for a cache of units: packed ids of words between white space, many in one call of the library.

    NFC doesn't change Latin-1, and lower-casing it no lengths: where the vocabulary folds(), such units are cut by PRETOKENS
    here and go to the library's model without its normalizers and pattern, which take more time than the model. All others
    go through the whole of it.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    known = folds(path)
    model = Tokenizer(t.model)
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocabulary = t.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[k for x, k in vocabulary.items() if x.endswith(END)]] = True

    def plain(units: list[str]) -> list[bytes]:
        pretokens = PRETOKENS.findall(" ".join(units).lower())
        level = LEVEL[np.frombuffer(" ".join(pretokens).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(model.encode_batch_fast([level], add_special_tokens=False)[0].ids, "<u4")
        lengths = np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        last = lengths.searchsorted(np.cumsum(np.fromiter(map(len, units), np.int64, len(units))))
        cuts = [0, *(4 * np.flatnonzero(ends[ids])[last] + 4).tolist()]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def others(units: list[str]) -> list[bytes]:
        got = t.encode(" ".join(units), add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        starts = np.fromiter((x for x, _ in got.offsets), np.int64)
        cuts = [0, *starts.searchsorted(np.cumsum([len(u) + 1 for u in units]), "left").tolist()]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(units), 4096):
            some = units[k : k + 4096]
            if known and is_latin(" ".join(some)):
                out += plain(some)
                continue
            latin = [known and is_latin(u) for u in some]
            a = iter(plain([u for u, x in zip(some, latin, strict=True) if x]) if any(latin) else [])
            b = iter(others([u for u, x in zip(some, latin, strict=True) if not x]))
            out += [next(a if x else b) for x in latin]
        return out

    def whole(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode, whole


#: Characters that Python's split() takes for white space and the vocabulary's pattern doesn't: such texts go whole.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def _worker(path: str, cached: int | None):
    cache = cache_of(__name__)
    if (path, cached) not in cache:
        cache.clear()
        encode, whole = unit_ids(path)
        cache[path, cached] = RecurringCache(encode, cached) if cached else UnitCache(encode), whole, folds(path)
    return cache[path, cached]


def encode_texts(texts: list[str], cache: RecurringCache | UnitCache, whole, lower: bool = False) -> Iterator[bytes]:
    """Packed ids of texts, by a vocabulary that drops white space; with ``lower`` one that folds(), words alike but for case are one unit."""
    for run in together(texts, TOGETHER):
        units: list[str] = []
        ends: list[int | None] = []
        for x in run:
            if any(o in x for o in ODD):
                ends.append(None)
            else:
                units += (x.lower() if lower and is_latin(x) else x).split()
                ends.append(len(units))
        found = list(map(cache.get, units))
        missing = list(compress(range(len(units)), map(is_, found, repeat(None))))
        if missing:
            cache.fill({units[k] for k in missing})
            for k in missing:
                found[k] = cache[units[k]]
        at = 0
        for x, end in zip(run, ends, strict=True):
            if end is None:
                yield whole(x)
            else:
                yield b"".join(found[at:end])
                at = end


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, cached: int | None = None) -> DataFrame:
    """The pieces of every row's ids, cut at ``capacity``, with the checksum of their ids.

    ``cached``: words that a worker may remember; None for units.CACHE, which takes more memory and less time. Results don't depend on it.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, whole, lower = _worker(path, cached)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(b.column(0).to_pylist(), encode_texts(texts(b), cache, whole, lower), strict=True):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, x in zip(out, (doc, k, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield batch(("doc_id", "piece", "start", "length", "ids_crc32"), out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))

    return map_arrow(documents(docs), run, PIECE)


class Bins:
    """Bins of one capacity, found by their room: a bitmap of the rooms that occur, and the bins of each."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0

    def put(self, i: int, room: int) -> None:
        self.by_room[room].add(i)
        self.rooms |= 1 << room
        self.room[i] = room

    def take(self, i: int) -> None:
        room = self.room[i]
        self.by_room[room].discard(i)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)

    def tightest(self, size: int) -> int | None:
        """A room of at least ``size``, the least."""
        x = self.rooms >> size
        return size + (x & -x).bit_length() - 1 if x else None

    def add(self, k: int, size: int) -> None:
        room = self.tightest(size)
        if room is None:
            self.items.append([k])
            self.room.append(0)
            self.put(len(self.items) - 1, self.capacity - size)
        else:
            i = min(self.by_room[room])
            self.take(i)
            self.items[i].append(k)
            self.put(i, room - size)


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices: best fit, longest first, then local search."""
    bins = Bins(capacity)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        bins.add(k, sizes[k])
    search(bins, sizes)
    return [x for x in bins.items if x]


class Takers:
    """What bins with room could give back for what they get: nothing, one document, or two. Only appended to.

    An entry has the sum given back, the most that its bin may get for it, and the table of a source's offers to look
    into: 0 for one document, 1 for one or two, which only one document is exchanged for. A changed bin's entries go dead.
    """

    def __init__(self, capacity: int):
        self.capacity, self.end, self.live = capacity, 0, 0
        self.most, self.back, self.bin = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.places: dict[int, tuple[int, int]] = {}

    def drop(self, i: int) -> None:
        a, b = self.places.pop(i, (0, 0))
        self.bin[a:b] = -1
        self.live -= b - a

    def put(self, i: int, sizes: np.ndarray, room: int) -> None:
        one, two = offers(sizes)
        back = np.concatenate([[0], two, one])
        table = np.concatenate([np.zeros(1 + len(two), np.int64), np.full(len(one), self.capacity + 1)])
        n = len(back)
        if self.end + n > len(self.bin):
            size = max(2 * len(self.bin), self.end + n)
            self.most, self.back, self.bin = (np.resize(x, size) for x in (self.most, self.back, self.bin))
        at = slice(self.end, self.end + n)
        self.most[at], self.back[at], self.bin[at] = table + back + room, back, i
        self.places[i] = self.end, self.end + n
        self.end += n
        self.live += n

    def compact(self) -> np.ndarray:
        """Dead entries go; new places of old ones."""
        kept = self.bin[: self.end] >= 0
        moved = np.concatenate([[0], np.cumsum(kept)])
        n = int(moved[-1])
        for x in (self.most, self.back, self.bin):
            x[:n] = x[: self.end][kept]
        self.places = {i: (int(moved[a]), int(moved[b])) for i, (a, b) in self.places.items()}
        self.end = n
        return moved


def offers(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of one document, and of two, that a bin has. A bin has few different sizes, as they add up to its capacity."""
    u, n = np.unique(sizes, return_counts=True)
    x, y = np.triu_indices(len(u), 1)
    return u, np.unique(np.concatenate([u[x] + u[y], 2 * u[n > 1]]))


def pick(items: list[int], sizes: list[int], total: int, most: int) -> list[int]:
    """One document of that size, or else two if ``most`` is 2."""
    if not total:
        return []
    where: dict[int, int] = {}
    for k in items:
        if sizes[k] == total:
            return [k]
    if most == 2:
        for k in items:
            if total - sizes[k] in where:
                return [where[total - sizes[k]], k]
            where[sizes[k]] = k
    raise AssertionError("no such documents")


def search(bins: Bins, sizes: list[int]) -> None:
    """Moves, one-for-one and two-for-one exchanges between bins with room while the sum of squared fills grows.

    For bins of fills f and g, shifting d tokens from g to f changes the sum by 2d(f - g + d). Sources go from the emptiest
    on, and all are tried, against all bins with room, until none has a gain; one that had none only looks at bins that
    have changed since. While all rooms together are less than a bin, no bin can be saved, and it ends.
    """
    cap, items, room = bins.capacity, bins.items, bins.room
    loose = {i for i in range(len(items)) if items[i] and room[i] > 0}
    total = sum(room[i] for i in loose)
    if total < cap or len(loose) < 2:
        return
    takers = Takers(cap)
    for i in sorted(loose, key=lambda i: (room[i], i)):
        takers.put(i, np.array([sizes[k] for k in items[i]]), room[i])
    seen = dict.fromkeys(loose, 0)
    gained = True
    while gained:
        gained = False
        for source in sorted(loose, key=lambda i: (-room[i], i)):
            while source in loose and seen[source] < takers.end:
                got = best_shift(source, np.array([sizes[k] for k in items[source]]), room[source], takers, seen[source])
                seen[source] = takers.end
                if got is None:
                    break
                to, given, returned, two = got
                give = pick(items[source], sizes, given, 2 if two else 1)
                back = pick(items[to], sizes, returned, 1 if two else 2)
                items[source] = [k for k in items[source] if k not in give] + back
                items[to] = [k for k in items[to] if k not in back] + give
                room[source] += given - returned
                room[to] -= given - returned
                gained = True
                for i in (to, source):
                    takers.drop(i)
                    seen[i] = 0
                    if items[i] and room[i] > 0:
                        takers.put(i, np.array([sizes[k] for k in items[i]]), room[i])
                    else:
                        loose.discard(i)
                if not items[source]:
                    total -= cap
                    if total < cap:
                        return
                if takers.end > 4096 and takers.end > 2 * takers.live:
                    moved = takers.compact()
                    seen = {i: int(moved[x]) for i, x in seen.items()}


def best_shift(source: int, own: np.ndarray, room: int, takers: Takers, since: int) -> tuple[int, int, int, bool] | None:
    """(bin, sum given, sum given back, whether two may be given) of the shift out of a source that gains most, if one does."""
    cap = takers.capacity
    one, two = offers(own)
    most, back, bins = takers.most[since : takers.end], takers.back[since : takers.end], takers.bin[since : takers.end]
    # The largest offer of at most x, by one document, and by one or two.
    least = np.zeros((2, cap + 1), np.int64)
    least[:, one] = one
    two = two[two <= cap]
    least[1, two] = two
    given = np.maximum.accumulate(least, axis=1).ravel()[most]
    d = given - back
    exchange = most > cap
    f_g = room - (most - exchange * (cap + 1) - back)
    gain = np.where((d > 0) & (bins >= 0) & (bins != source), d * (f_g + d), 0)
    k = int(gain.argmax())
    return (int(bins[k]), int(given[k]), int(back[k]), bool(exchange[k])) if gain[k] > 0 else None


def pack_groups(items: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """One packing of each of ``groups`` even groups; ``done``: next to full, or of the only group; ``emptiest``: of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(list(batches)) if groups else None
        if t is None or not t.num_rows:
            return
        sizes = t.column("length").to_pylist()
        base = (level << 56) + (TaskContext.get().partitionId() << 24)
        order, sequence, offset, done, emptiest = [], [], [], [], []
        bins = pack(sizes, capacity)
        fills = [sum(sizes[k] for k in b) for b in bins]
        last = set(sorted(range(len(bins)), key=lambda i: (fills[i], i))[: -(-len(bins) // REOPENED)])
        for i, bin_ in enumerate(bins):
            at = 0
            full = groups == 1 or capacity - fills[i] <= capacity * DONE
            for k in bin_:
                order.append(k)
                sequence.append(base + i)
                offset.append(at)
                done.append(full)
                emptiest.append(i in last)
                at += sizes[k]
        t = t.take(pa.array(order)).combine_chunks()
        columns = [t.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield batch([*("doc_id piece start length ids_crc32 sequence_id offset done emptiest".split())], [*columns, sequence, offset, done, emptiest], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()])

    return map_arrow(items.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(groups), run, f"{PLACED}, done boolean, emptiest boolean")


def best_fit(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP, end_id: int = 1, cached: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``."""
    cut = checkpointed(pieces(docs, path, capacity, end_id, cached))
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out, left, level = [full], cut.where(F.col("length") < capacity), 1
    n, before, open_bins, narrow = left.count(), None, None, False
    while n:
        groups = -(-n // group)
        placed = checkpointed(pack_groups(left, groups, capacity, level))
        if open_bins is not None:
            made = placed.where("offset = 0").count()
            if groups == 1 and made > open_bins or narrow and n >= before:
                out.append(left)
                break
            if groups > 1 and not narrow and made >= open_bins:  # nothing saved: what was there stays
                narrow, placed = True, left
        if groups == 1:
            out.append(placed)
            break
        again = ~F.col("done") & F.col("emptiest") if narrow else ~F.col("done")
        out.append(placed.where(~again))
        left = placed.where(again)
        before, n, open_bins, level = n, left.count(), left.where("offset = 0").count(), level + 1
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x.drop("done", "emptiest"))
    return result
