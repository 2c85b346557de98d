"""Token counts by a map-side two-tier lookup (operator 3).

A text is cut at its spaces into units: a space with the run of pre-tokens up to the next space. The pattern of a
byte-level BPE never joins characters across such a cut, except in runs of white space, so the token count of a text is
the sum of its units' counts; texts with such runs or with special strings go to the library whole.

Tier one is a compact table of the lengths of the most frequent units, broadcast to every worker. Its size is bounded by
``TABLE_SIZE`` entries of ``UNIT_CHARS`` characters. Which units are frequent comes from bounded sketches of all texts; it
changes the speed only. Tier two is a bounded cache in each Python worker in front of the library. No unit is shuffled,
but for the sketches' candidates.

Null or empty text: 0 bytes, 0 tokens. One row a row of input, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cache_of, documents, map_arrow, texts, tokenizer_path
from tidemark.llm.units import UnitCache, cut, split_by_offsets, together

#: Entries of the broadcast table, characters of an entry, entries of a task's sketch.
TABLE_SIZE, UNIT_CHARS, SKETCH = 1 << 16, 32, 1 << 14


def load(path: str):
    """count(text) of the library that a vocabulary file is for."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(piece.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def separable(path: str) -> bool:
    """Whether texts can be cut at spaces: byte-level BPE without a prefix space or a normalizer."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j.get("pre_tokenizer") or {}
    return j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and j["model"]["type"] == "BPE"


def unit_counter(path: str):
    """encode(units) for UnitCache: token counts of units, each with its leading space, many in one call of the library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def encode(units: list[str]) -> list[int]:
        out = [0] * len(units)
        plain = [i for i, u in enumerate(units) if u and not u[0].isspace()]
        for i in set(range(len(units))) - set(plain):
            out[i] = len(t.encode(" " + units[i], add_special_tokens=False).ids)
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            joined = "".join([" " + units[i] for i in some])
            starts = np.fromiter((x for x, _ in t.encode(joined, add_special_tokens=False).offsets), np.int64)
            for i, n in zip(some, split_by_offsets(starts, [len(units[i]) + 1 for i in some]).tolist(), strict=True):
                out[i] = n
        return out

    return encode


def _worker(path: str, packed, name: str):
    """This worker's library and cache, kept between tasks of the same table."""
    key, kept = (path, name), cache_of(__name__)
    if key not in kept:
        kept.clear()
        cache = None
        if packed is not None:
            joined, lengths = packed.value
            cache = UnitCache(unit_counter(path), dict(zip(joined.split(" "), lengths, strict=True)) if lengths else {})
        kept[key] = load(path), cache
    return kept[key]


def count_texts(texts: list[str], count, cache: UnitCache | None) -> list[int]:
    """Token counts of texts; ``cache`` is None where the vocabulary doesn't allow cuts at spaces."""
    if cache is None:
        return [count(x) if x else 0 for x in texts]
    out = []
    for run in together(texts):
        rows = [cut(x) if x else [] for x in run]
        units: set[str] = set()
        for r in rows:
            if r:
                units.update(r[1:])
        cache.fill(units)
        get = cache.__getitem__
        for x, r in zip(run, rows, strict=True):
            out.append(count(x) if r is None else (count(r[0]) if r[0] else 0) + sum(map(get, r[1:])) if r else 0)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for text in texts(b):
            counts.update(text.split(" ")[1:])
            if len(counts) > 16 * SKETCH:
                counts = Counter(dict(counts.most_common(4 * SKETCH)))
    top = [(u, n) for u, n in counts.most_common(SKETCH) if 0 < len(u) <= UNIT_CHARS and n > 1]
    yield batch(("unit", "n"), ([u for u, _ in top], [n for _, n in top]), (pa.string(), pa.int64()))


def frequent_units(docs: DataFrame, path: str, size: int = TABLE_SIZE):
    """The broadcast table: frequent units joined by spaces, and their token counts as bytes."""
    spark = docs.sparkSession
    rows = map_arrow(documents(docs).select("text"), _sketch, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(size).collect()
    units = [r.unit for r in rows]
    lengths = unit_counter(path)(units)
    return spark.sparkContext.broadcast((" ".join(units), lengths))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text, ...).

    ``path``: a .json vocabulary of tokenizers or a .model of sentencepiece, which must lie on every worker.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    packed = frequent_units(docs, path, table_size) if separable(path) else None
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cache = _worker(path, packed, name)
        for b in batches:
            n = count_texts(texts(b), count, cache)
            size = pc.fill_null(pc.cast(pc.binary_length(b.column(1)), pa.int64()), 0)
            yield batch(("doc_id", "n_bytes", "n_tokens", "over_limit"), (b.column(0), size, n, [x > limit for x in n]), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))

    return map_arrow(documents(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
