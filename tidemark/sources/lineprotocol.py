"""Samples as lines: ``<set> <label=value,...|-> <field=value,...> [ts_ms]``.

A backslash escapes the next character; double quotes protect separators. A quoted value is a text, any other is an integer,
a double or a text. Without a time the arrival is taken, and the label ts_source says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import FIELD, LABEL, MAX_TS, coerce

RESERVED = "_ingest"
_VALUE = pa.struct([("i", pa.int64()), ("f", pa.float64()), ("s", pa.string()), ("b", pa.bool_())])
SCHEMA = "set string, ts_ms bigint, sub_us int, labels map<string,string>, fields map<string,struct<i:bigint,f:double,s:string,b:boolean>>, key_hint string, reason string, line string"


class BadLine(ValueError):
    """A line that isn't taken."""


def split(text: str, separator: str) -> list[str]:
    """Parts between separators that are neither escaped nor quoted; escapes and quotes stay."""
    out, part, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            part += text[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if c == separator and not quoted:
            out.append(part)
            part = ""
        else:
            part += c
        i += 1
    if quoted:
        raise BadLine("an unclosed quote")
    return [*out, part]


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def pairs(text: str) -> Iterator[tuple[str, str]]:
    for p in split(text, ","):
        kv = split(p, "=")
        if len(kv) != 2 or not kv[0] or not kv[1]:
            raise BadLine(f"expected key=value, found {p!r}")
        yield plain(kv[0]), kv[1]


def value(text: str) -> int | float | str:
    if text.startswith('"'):
        if len(text) < 2 or not text.endswith('"'):
            raise BadLine(f"a badly quoted value {text!r}")
        return plain(text[1:-1])
    return coerce(plain(text))


def parse(line: str, arrival_ms: int | None = None) -> dict:
    """Set, time, labels and fields of a line; BadLine otherwise."""
    parts = [p for p in split(line.strip(), " ") if p]
    if len(parts) not in (3, 4):
        raise BadLine("expected set, labels, fields, and maybe a time")
    source = plain(parts[0])
    if not re.match(LABEL, source) or source.startswith(RESERVED):
        raise BadLine(f"bad set {source!r}")
    labels = {} if parts[1] == "-" else {k: plain(v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v) for k, v in pairs(parts[1])}
    fields = {k: value(v) for k, v in pairs(parts[2])}
    if bad := [k for k in labels if not re.match(LABEL, k)] + [k for k in fields if not re.match(FIELD, k)]:
        raise BadLine(f"bad name {bad[0]!r}")
    if both := set(labels) & set(fields):
        raise BadLine(f"{both.pop()!r} is label and field")
    if any(isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) for v in fields.values()):
        raise BadLine("a value isn't finite")
    if len(parts) == 4:
        if not re.fullmatch(r"\d{1,15}", parts[3]) or not 1 <= int(parts[3]) <= MAX_TS:
            raise BadLine(f"bad time {parts[3]!r}")
        ts = int(parts[3])
    elif arrival_ms is None:
        raise BadLine("no time")
    else:
        ts, labels = arrival_ms, labels | {"ts_source": "receiver"}
    return {"set": source, "ts_ms": ts, "labels": labels, "fields": fields}


def samples(lines: DataFrame, column: str = "value", arrival: str | None = None) -> DataFrame:
    """Samples of lines; those that aren't taken have a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for line, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    s = parse(line or "", at)
                    fields = [(k, {"i": v if type(v) is int else None, "f": v if type(v) is float else None, "s": v if type(v) is str else None, "b": None}) for k, v in s["fields"].items()]
                    rows.append((s["set"], s["ts_ms"], 0, list(s["labels"].items()), fields, None, None, line))
                except BadLine as e:
                    rows.append((None, None, None, None, None, None, str(e), line))
            types = (pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), _VALUE), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["set", "ts_ms", "sub_us", "labels", "fields", "key_hint", "reason", "line"])

    return lines.select(F.col(column).cast("string").alias("l"), (F.col(arrival) if arrival else F.lit(None)).cast("long").alias("a")).mapInArrow(run, SCHEMA)
