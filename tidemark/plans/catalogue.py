"""What is known of sets: observed and declared columns, bucket sets, first and last instants, label values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from tidemark.lang.check import FieldInfo

STALE_MS = 7 * 86_400_000
MAX_CONFLICTS = 64


@dataclass
class BucketSet:
    buckets: list[str]
    edges: list[float]
    unit: str = ""


@dataclass
class SetInfo:
    labels: dict[str, int] = field(default_factory=dict)
    #: Observed fields: type (long, double, string, boolean) and when last seen.
    types: dict[str, str] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    declared: dict[str, dict] = field(default_factory=dict)
    buckets: dict[str, BucketSet] = field(default_factory=dict)
    first_ts: int | None = None
    last_ts: int | None = None
    retention_ms: int = 0
    shard_ms: int = 86_400_000
    conflicts: list[str] = field(default_factory=list)


#: How column types widen when rows disagree.
_RANK = {"boolean": 0, "long": 1, "double": 2, "string": 3}


class Catalogue:
    """All sets; saved as one JSON document. Answers the questions that checks and plans ask."""

    def __init__(self, sets: dict[str, SetInfo] | None = None, version: int = 0):
        self.known, self.version = sets or {}, version

    def sets(self) -> list[str]:
        return sorted(self.known)

    def has_label(self, source: str, name: str) -> bool:
        return source in self.known and name in self.known[source].labels

    def label_keys(self, source: str) -> list[str]:
        return sorted(self.known[source].labels)

    def field(self, source: str, name: str) -> FieldInfo | None:
        s = self.known.get(source)
        if s is None or (name not in s.types and name not in s.declared):
            return None
        meta = {k: v for k, v in s.declared.get(name, {}).items() if k in {f.name for f in fields(FieldInfo)}}
        old = s.last_ts is not None and name in s.seen and s.last_ts - s.seen[name] > STALE_MS
        return replace(FieldInfo(), **meta, stale=old or name not in s.types)

    def field_names(self, source: str) -> list[str]:
        s = self.known[source]
        return sorted({*s.types, *s.declared})

    def type_of(self, source: str, name: str) -> str | None:
        return self.known[source].types.get(name)

    def bucket_set(self, source: str, name: str) -> BucketSet | None:
        s = self.known.get(source)
        return s.buckets.get(name) if s else None

    def declare(self, source: str, name: str, **meta) -> None:
        """Metadata of a field; the last writer wins and a changed kind or unit is noted as a conflict."""
        s = self.known.setdefault(source, SetInfo())
        if name in s.labels:
            raise ValueError(f"{name!r} is a label of {source!r}")
        if meta.get("kind", "gauge") not in ("counter", "gauge", "delta", "string"):
            raise ValueError(f"unknown kind {meta['kind']!r}")
        old = s.declared.get(name, {})
        for k, v in meta.items():
            if k in old and old[k] != v and len(s.conflicts) < MAX_CONFLICTS:
                s.conflicts.append(f"{name}.{k}: {old[k]!r} became {v!r}")
        if (new := old | meta) != old:
            s.declared[name] = new
            self.version += 1

    def declare_buckets(self, source: str, name: str, buckets: list[str], edges: list[float], unit: str = "") -> None:
        if len(buckets) != len(edges) or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError("edges must ascend, one a bucket")
        s = self.known.setdefault(source, SetInfo())
        if len(s.buckets) >= 64 and name not in s.buckets:
            raise ValueError("a set has at most 64 bucket sets")
        s.buckets[name] = BucketSet(list(buckets), list(map(float, edges)), unit)
        self.version += 1

    def observe(self, source: str, labels: list[str], types: dict[str, str], first: int, last: int) -> None:
        s = self.known.setdefault(source, SetInfo())
        for k in labels:
            s.labels[k] = max(last, s.labels.get(k, last))
        for k, t in types.items():
            s.types[k] = max(t, s.types.get(k, t), key=_RANK.__getitem__)
            s.seen[k] = max(last, s.seen.get(k, last))
        s.first_ts = first if s.first_ts is None else min(first, s.first_ts)
        s.last_ts = last if s.last_ts is None else max(last, s.last_ts)
        self.version += 1

    def dumps(self) -> str:
        return json.dumps({"version": self.version, "sets": {k: asdict(v) for k, v in self.known.items()}}, sort_keys=True)

    @staticmethod
    def loads(text: str) -> Catalogue:
        j = json.loads(text)
        sets = {k: SetInfo(**(v | {"buckets": {n: BucketSet(**b) for n, b in v["buckets"].items()}})) for k, v in j["sets"].items()}
        return Catalogue(sets, j["version"])
