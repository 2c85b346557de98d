"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (operator 7).

The bytes of pre-tokens are a linked list. For every adjacent pair that the vocabulary can merge, its position goes to
the bucket of its rank; a bitmap of three levels of 64 bits marks the ranks whose buckets hold something, so that three
find-first-set steps give the lowest. A bucket skips stale positions, whose pair has changed since, and merges the others
from left to right. Each merge touches two neighbours, so n bytes take O(n log n) steps however long a pre-token is. All
pre-tokens that a worker's caches lack share one queue: a bucket's merges are made by array operations.

Texts are cut at spaces first; a worker keeps a bounded cache of the ids of such units. Texts in which the pattern joins
white space across such cuts take the pattern over the whole text.

Null or empty text: no ids, and the digests of no bytes. One row a row of input; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import batch, cache_of, documents, map_arrow, texts, tokenizer_path
from tidemark.llm.units import JOINED, TOGETHER, UnitCache, together

#: The pattern of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker keeps.
CACHE = 600_000


HIGH = regex.compile("[\u0500-\U0010ffff]")


def adjusted(pattern: str) -> str:
    """``pattern`` with the code points on which regex and tiktoken differ put right in its classes."""
    import tiktoken

    points = [chr(c) for c in range(0x500, 0x110000) if not 0xD800 <= c < 0xE000]
    bytes_only = {bytes([i]): i for i in range(256)}
    own = {}
    for name in (r"\p{L}", r"\p{N}"):
        e = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=bytes_only, special_tokens={})
        here = regex.compile(name)
        theirs = {c for k in range(0, len(points), 4096) for c in e.decode_bytes(e.encode_ordinary("".join(points[k : k + 4096]))).decode()}
        wrong = "".join(regex.escape(c) for c in points if c not in theirs and here.match(c))
        lacks = "".join(regex.escape(c) for c in points if c in theirs and not here.match(c))
        own[name] = (f"[{name}--[{wrong}]]" if wrong else name) if not lacks else f"[[{name}--[{wrong}]]||[{lacks}]]"
    return regex.sub(r"\\p\{[LN]\}", lambda m: own[m[0]], pattern)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank. Three bitmap levels: 64 ranks a word, 64 words a word, and a top word."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Deals positions out to the buckets of their ranks."""
        if len(ranks) > 1:
            order = ranks.argsort(kind="stable")
            ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist(), strict=False):
            self.push(r, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank, by three find-first-set steps, and its bucket."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = self.low[b]
        rank = b << 6 | (w & -w).bit_length() - 1
        self.low[b] = w = w & (w - 1)
        if not w:
            self.mid[a] = m = m & (m - 1)
            if not m:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Encoder:
    """Encodes and decodes by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern, self.plain, self.exact = ranks, pattern, regex.compile(pattern).findall, None
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        # Pairs of ids whose bytes together are in the vocabulary, sorted, and their ranks.
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([r for _, r in pairs] + [-1], np.int64)
        # Where no merge can make a pair of its own rank or a lower one, all of a bucket's entries can be taken at once.
        left, right = self.pairs[:-1] // self.size, self.pairs[:-1] % self.size
        lengths = np.zeros(self.size, np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        #: Ranks at which a merge may lead to an equal or lower rank: there a pre-token's entries are taken one by one.
        self.careful = frozenset(x for x in np.unique(np.concatenate([left[(lengths[left] > 1) & (left >= self.merged[:-1])], right[(lengths[right] > 1) & (right >= self.merged[:-1])]])).tolist())
        self.words: dict[str, bytes] = {}

    def find(self, text: str) -> list[str]:
        """Pre-tokens. Past U+0500, letters and numbers are what tiktoken takes for them, whatever Unicode regex knows."""
        if text.isascii() or not HIGH.search(text):
            return self.plain(text)
        if self.exact is None:
            self.exact = regex.compile("(?V1)" + adjusted(self.pattern)).findall
        return self.exact(text)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = self.pairs.searchsorted(key)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def early(self, r: int, at: np.ndarray, token: np.ndarray, before: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
        """Whether merges of rank ``r`` at these entries would make a pair of an equal or lower rank, in any entry of them."""
        left, right = before[at], after[after[at]]
        low = np.zeros(len(at), bool)
        for there, a, b in ((left >= 0, token[left], np.full(len(at), r)), (right < n, np.full(len(at), r), token[right])):
            x = np.where(there, self.rank_of(np.maximum(a, 0), np.maximum(b, 0)), -1)
            low |= (x >= 0) & (x <= r)
        both = self.rank_of(np.array([r]), np.array([r]))[0]
        return np.full(len(at), True) if low.any() or 0 <= both <= r else low

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, all in one queue; no pair reaches across two of them.

        The lowest rank of the queue is the lowest of every pre-token that has it, so their merges can be made together.
        Entries of one pre-token that overlap are taken alternately from the left, as one by one.
        """
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        last = first + sizes - 1
        after = np.arange(1, n + 1)
        after[last] = n
        before = np.arange(-1, n)  # before[n] takes what is written past the end
        before[first] = -1
        rank_at = np.full(n + 1, -1, np.int64)
        rank_at[:-1][: n - 1] = self.rank_of(token[:-1], token[1:])
        rank_at[last] = -1
        alive = np.ones(n, bool)
        word = np.repeat(np.arange(len(pieces)), sizes) if self.careful else None
        token = np.append(token, -1)
        after = np.append(after, n)
        queue = RankQueue(self.size)
        some = np.flatnonzero(rank_at >= 0)
        if len(some):
            queue.push_all(rank_at[some], some)
        while (got := queue.pop()) is not None:
            r, at = got
            at = at[rank_at[at] == r]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                linked = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if linked.any():
                    k = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(linked, 0, k))
                    at = at[(k - start) % 2 == 0]
                if r in self.careful:
                    lead = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                    if not lead.all():
                        wait = self.early(r, at, token, before, after, n) & ~lead
                        if wait.any():
                            wait = np.isin(word[at], word[at[wait]]) & ~lead
                            queue.push(r, at[wait])
                            at = at[~wait]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            token[at] = r
            after[at] = then
            before[then] = at
            before[n] = -1
            rank_at[gone] = -1
            alive[gone] = False
            left = before[at]
            left = left[left >= 0]
            changed = np.unique(np.concatenate([at, left])) if len(at) > 1 else np.concatenate([at, left])
            right = after[changed]
            new = np.where(right < n, self.rank_of(token[changed], token[right]), -1)
            rank_at[changed] = new
            keep = new >= 0
            if keep.any():
                queue.push_all(new[keep], changed[keep])
        ids = token[:-1][alive].astype("<u4").tobytes()
        counts = np.add.reduceat(alive.astype(np.int64), first)
        ends = (np.cumsum(counts) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> None:
        """Sees to it that ``self.words`` has these pre-tokens; it is emptied when full."""
        missing = [w for w in words if w not in self.words]
        if len(self.words) + len(missing) > CACHE:
            self.words.clear()
            missing = list(words)
        pieces = [w.encode() for w in missing]
        ids = [self.ranks.get(p) for p in pieces]
        rest = iter(self.merge_all([p for p, i in zip(pieces, ids, strict=True) if i is None]))
        self.words.update(zip(missing, (next(rest) if i is None else pack([i]) for i in ids), strict=True))

    def units(self, units: list[str]) -> list[bytes]:
        """Packed ids of units with their leading space: encode() of a UnitCache."""
        rows = [self.find(" " + u) for u in units]
        self.learn({w for r in rows for w in r})
        get = self.words.__getitem__
        return [b"".join(map(get, r)) for r in rows]

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if a.itemsize != 4:
        raise RuntimeError("unsigned int has not 32 bits here")
    if __import__("sys").byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpack(ids: bytes) -> array:
    a = array("I")
    a.frombytes(ids)
    if __import__("sys").byteorder == "big":
        a.byteswap()
    return a


def encode_texts(texts: list[str], encoder: Encoder, cache: UnitCache) -> list[bytes]:
    """Packed ids of texts."""
    out = []
    for run in together(texts, 4 * TOGETHER):
        rows = [(x.split(" ") if not JOINED.search(x) else None) if x else [] for x in run]
        units: set[str] = set()
        whole: set[str] = set()
        for x, r in zip(run, rows, strict=True):
            if r is None:
                whole.update(encoder.find(x))
            elif r:
                units.update(r[1:])
                whole.update(encoder.find(r[0]))
        cache.fill(units)
        encoder.learn(whole)
        get, word = cache.__getitem__, encoder.words.__getitem__
        for x, r in zip(run, rows, strict=True):
            if r is None:
                out.append(b"".join(map(word, encoder.find(x))))
            else:
                out.append(b"".join(map(word, encoder.find(r[0]))) + b"".join(map(get, r[1:])) if r else b"")
    return out


def _worker(path: str) -> tuple[Encoder, UnitCache]:
    cache = cache_of(__name__)
    if path not in cache:
        cache.clear()
        e = Encoder(load_ranks(path))
        cache[path] = e, UnitCache(e.units)
    return cache[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the packed ids of every row's text."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, units = _worker(path)
        for b in batches:
            yield batch(("doc_id", "ids"), (b.column(0), encode_texts(texts(b), e, units)), (pa.int64(), pa.binary()))

    return map_arrow(documents(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, _ = _worker(path)
        for b in batches:
            yield batch(("doc_id", "bytes"), (b.column(0), [e.decode(unpack(x or b"")) for x in b.column(1).to_pylist()]), (pa.int64(), pa.binary()))

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding, then decoding of the ids, in one pass."""
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, units = _worker(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in encode_texts(texts(b), e, units):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(unpack(ids))).hexdigest())
            yield batch(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), (b.column(0), n, ids_sha, text_sha), (pa.int64(), pa.int64(), pa.string(), pa.string()))

    return map_arrow(documents(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
