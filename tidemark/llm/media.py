"""Media columns: interleaved document sequences (operator 9).

A page's HTML becomes an ordered sequence of structs, each a text or a reference to media with its position, digest and
caption. A store holds the media by the digest of their payload; joins on the digest resolve the references, and position
and caption stay beside what they belong to. Payloads never travel with the references: what is asked of a payload is
computed where it is stored, once a stored copy, and only those small rows are joined.

A payload of bytes is stored losslessly as a PNG of 8-bit grey samples, 64 a row.

Null or empty text: a payload of 64 zero bytes. Null HTML: an empty sequence. A reference whose digest the store lacks
stays, with nulls. One row a row of input for the query; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, checkpointed, documents, map_arrow, texts

WIDTH = 64
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of ``width``."""
    return data + bytes(-len(data) % width if data else width)


def png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey 8-bit PNG of rows of ``width`` samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def samples(stored: bytes) -> np.ndarray:
    """The samples of a PNG as png() writes it, row by row; ValueError for anything else."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            w, h, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey PNG without interlacing")
            size = h, w
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None:
        raise ValueError("the PNG has no header")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    if rows[:, 0].any():
        raise ValueError("the PNG's rows are filtered")
    return rows[:, 1:]


def feature(x: np.ndarray) -> str:
    """Height, mean, deviation, entropy and mean step between neighbours of the samples."""
    counts = np.bincount(x.ravel(), minlength=256)
    n = int(counts.sum())
    values = np.arange(256)
    mean = int((counts * values).sum()) / n
    deviation = math.sqrt(max(0.0, int((counts * values * values).sum()) / n - mean * mean))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    step = float(np.abs(np.diff(x.astype(np.int16), axis=1)).mean())
    return f"h={len(x)};mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};step={step:.4f}"


class _Parser(HTMLParser):
    """Collects texts, media and captions in their order."""

    MEDIA = ("img", "video", "audio", "source", "embed")
    BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 td th tr section article header footer blockquote pre br hr figure ul ol table body main aside nav".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.hidden = self.figure = 0
        self.caption: list[str] | None = None
        self.in_figure: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA:
            source = a.get("src") or ""
            self.flush()
            self.items.append({"kind": "media", "text": source or None, "digest": source[len(SCHEME) :] if source.startswith(SCHEME) else None, "caption": a.get("alt") or None})
            if self.figure:
                self.in_figure.append(len(self.items) - 1)
        if tag == "figure":
            self.flush()
            self.figure += 1
            self.in_figure = []
        elif tag in self.BLOCKS and self.caption is None:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            for k in self.in_figure:
                self.items[k]["caption"] = caption or self.items[k]["caption"]
        elif tag == "figure":
            self.flush()
            self.figure, self.in_figure = max(0, self.figure - 1), []
        elif tag in self.BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The ordered items of a page."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": k} | x for k, x in enumerate(p.items)]


_ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): the sequence of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch((key, "items"), (b.column(0), [sequence(x) for x in b.column(1).to_pylist()]), (pa.int64(), _ITEMS))

    return map_arrow(pages.select(F.col(key).cast("long").alias(key), F.col(html).alias("html_")), run, f"`{key}` long, items array<{ITEM}>")


def references(sequences: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, digest, caption) of every media item."""
    return sequences.select(key, F.explode("items").alias("x")).where(F.col("x.kind") == "media").select(key, "x.position", "x.digest", "x.caption")


def read_back(store: DataFrame) -> DataFrame:
    """What the stored bytes (digest, media) hold: one small row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(digest)
                x = samples(media)
                payload = x.tobytes()
                for c, v in zip(out, (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(x)), strict=True):
                    c.append(v)
            yield batch(("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), out, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))

    read = map_arrow(store.select("digest", "media"), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def resolve(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """References with what the store has for their digests; a digest that very many share is split by the join."""
    return refs.join(checkpointed(resolved), "digest", "left")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html, digest, media): each text as stored media and a page that refers to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                data = text.encode()
                payload = pad(data)
                digest = hashlib.sha256(payload).hexdigest()
                html = f'<article><p>{escape(str(doc))}</p><figure><img src="{SCHEME}{digest}"><figcaption>{len(data)}</figcaption></figure></article>'
                for c, v in zip(out, (len(data), html, digest, png(payload)), strict=True):
                    c.append(v)
            yield batch(("doc_id", "n_bytes", "html", "digest", "media"), (b.column(0), *out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))

    return map_arrow(documents(docs), run, "doc_id long, n_bytes long, html string, digest string, media binary")


def media_columns(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract: every text is stored as media, its page parsed, and the reference resolved."""
    stored = checkpointed(store_texts(docs))
    refs = references(interleave(stored, "doc_id"), "doc_id")
    found = resolve(refs, read_back(stored))
    # The caption stays with its reference; here it says how many bytes the text has without padding.
    return found.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
