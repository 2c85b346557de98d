"""Extraction specs: what makes samples out of lines. A YAML document or a dict, checked strictly."""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import MISSING, dataclass, field, fields
from typing import Any

from tidemark.functions.regex import BadRegex, translate
from tidemark.lang.parse import milliseconds

MAX_REGEX, MAX_POW2 = 8192, 64
#: Go reference layouts and Java's patterns, longest first (fixed values).
LAYOUT = [("January", "MMMM"), ("Monday", "EEEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Z0700", "XX"), ("2006", "yyyy"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("_2", "d"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s")]
EPOCHS = {"epoch_s": 1_000_000, "epoch_ms": 1000, "epoch_us": 1, "epoch_ns": 0}


class BadSpec(ValueError):
    """A spec that can't be used."""


@dataclass(frozen=True)
class Lint:
    code: str
    message: str
    fatal: bool = False


def _strict(cls, x: Any, where: str):
    """A dataclass from a mapping that has none but its fields."""
    if not isinstance(x, dict):
        raise BadSpec(f"{where}: expected a mapping")
    known = {f.name: f for f in fields(cls) if not f.name.startswith("_")}
    if odd := sorted(set(x) - set(known)):
        raise BadSpec(f"{where}: unknown key {odd[0]!r}")
    if lacking := [n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING and n not in x]:
        raise BadSpec(f"{where}: {lacking[0]!r} is missing")
    return cls(**{k: v for k, v in x.items() if v is not None})


def regex(where: str, pattern: str) -> tuple[str, dict[str, int]]:
    if len(pattern.encode()) > MAX_REGEX:
        raise BadSpec(f"{where}: a regex is longer than {MAX_REGEX} bytes")
    try:
        return translate(pattern)
    except BadRegex as e:
        raise BadSpec(f"{where}: bad regex {pattern!r}: {e}") from None


def java_layout(layout: str) -> str:
    """Java's pattern of a reference layout; fractions become as many S."""
    out, i = "", 0
    while i < len(layout):
        if m := re.match(r"[.,]([09]+)", layout[i:]):
            out += layout[i] + "S" * len(m[1])
            i += m.end()
            continue
        for go, java in LAYOUT:
            if layout.startswith(go, i):
                out += java
                i += len(go)
                break
        else:
            c = layout[i]
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
    return out


@dataclass
class Format:
    layout: str
    regex: str

    @property
    def has_year(self) -> bool:
        return self.layout in EPOCHS or "2006" in self.layout or re.search(r"(?<!\d)06", self.layout) is not None

    @property
    def has_zone(self) -> bool:
        return bool(re.search(r"Z?-?07:?00|MST", self.layout))


@dataclass
class Timestamp:
    formats: list
    anchor: str = "anywhere"
    strip: bool = False
    on_parse_error: str = "count"

    def __post_init__(self):
        self.formats = [_strict(Format, f, "timestamp format") for f in self.formats]
        if not self.formats:
            raise BadSpec("timestamp: no formats")
        if self.anchor not in ("prefix", "anywhere"):
            raise BadSpec(f"timestamp: unknown anchor {self.anchor!r}")
        for f in self.formats:
            regex("timestamp", f.regex)


@dataclass
class Join:
    regex: str
    capture: int = 1


@dataclass
class Multiline:
    start_contains: str
    continue_regex: str
    join: list
    idle_timeout: str = "30s"

    def __post_init__(self):
        if not self.start_contains:
            raise BadSpec("multiline: start_contains is empty")
        regex("multiline", self.continue_regex)
        self.join = [_strict(Join, j, "multiline join") for j in self.join]
        for j in self.join:
            regex("multiline join", j.regex)
        if not self.join:
            raise BadSpec("multiline: no join rules")
        self.idle_ms = milliseconds(self.idle_timeout)


@dataclass
class Framing:
    record: str = "line"
    max_record_bytes: int = 1 << 20
    multiline: list = field(default_factory=list)

    def __post_init__(self):
        self.multiline = [_strict(Multiline, m, "multiline") for m in self.multiline]
        if self.record != "line":
            raise BadSpec(f"framing: unknown record {self.record!r}")


@dataclass
class Replace:
    regex: str
    sub: str

    def java(self) -> tuple[str, str]:
        pattern, names = regex("replace", self.regex)
        return pattern, re.sub(r"\$\{?(\w+)\}?", lambda m: f"${names.get(m[1], m[1])}", self.sub)


@dataclass
class Route:
    regex: str
    set: str


@dataclass
class Aggregate:
    every: str
    field: str
    mode: str
    on: list = field(default_factory=list)

    def __post_init__(self):
        self.every_ms = milliseconds(str(self.every))
        if self.every_ms <= 0:
            raise BadSpec("aggregate: every must be positive")
        if self.mode not in ("increment", "sum", "max", "last"):
            raise BadSpec(f"aggregate: unknown mode {self.mode!r}")


@dataclass
class Pattern:
    set: str = ""
    search: str = ""
    replace: list = field(default_factory=list)
    extract: list = field(default_factory=list)
    route: list = field(default_factory=list)
    labels: list = field(default_factory=list)
    default_values: dict = field(default_factory=dict)
    store_stream_label: str = ""
    bucket_set: str = ""
    aggregate: Any = None

    def __post_init__(self):
        self.replace = [_strict(Replace, r, "replace") for r in self.replace]
        self.route = [_strict(Route, r, "route") for r in self.route]
        self.branches = [(self.set, *regex("extract", e)) for e in self.extract] + [(r.set, *regex("route", r.regex)) for r in self.route]
        if not self.branches:
            raise BadSpec("a pattern has neither extract nor route")
        if self.extract and not self.set:
            raise BadSpec("a pattern with extract has no set")
        if self.aggregate is not None:
            self.aggregate = _strict(Aggregate, self.aggregate, "aggregate")

    def names(self) -> set[str]:
        return {n for _, _, names in self.branches for n in names}


@dataclass
class Buckets:
    name: str
    buckets: list
    parse: str = "paren_pairs"
    edges: str = "pow2"
    edge_unit: str = ""
    total_field: str = ""
    cumulative: bool = False
    tail: bool = False

    def __post_init__(self):
        self.buckets = list(map(str, self.buckets))
        if self.parse not in ("paren_pairs", "csv", "key_value", "json_object"):
            raise BadSpec(f"bucket set {self.name}: unknown parse {self.parse!r}")
        n = len(self.buckets)
        if not n or len(set(self.buckets)) < n:
            raise BadSpec(f"bucket set {self.name}: buckets must be distinct, and some")
        if self.edges == "pow2":
            if n > MAX_POW2:
                raise BadSpec(f"bucket set {self.name}: pow2 has at most {MAX_POW2} buckets")
            self.values = [float(2 ** (k - 1)) if k else 0.0 for k in range(n)]
        elif m := re.fullmatch(r"linear:\s*([0-9.eE+-]+)", self.edges):
            step = float(m[1])
            if not step > 0:
                raise BadSpec(f"bucket set {self.name}: the step must be positive")
            self.values = [k * step for k in range(n)]
        elif m := re.fullmatch(r"explicit:\s*\[(.*)\]", self.edges):
            self.values = [float(x) for x in m[1].split(",")]
        else:
            raise BadSpec(f"bucket set {self.name}: unknown edges {self.edges!r}")
        if len(self.values) != n or any(b <= a for a, b in zip(self.values, self.values[1:], strict=False)):
            raise BadSpec(f"bucket set {self.name}: edges must ascend, one a bucket")


@dataclass
class Selector:
    path_glob: list = field(default_factory=list)
    content_contains: list = field(default_factory=list)
    label_equals: dict = field(default_factory=dict)
    listener: str = ""
    scan_bytes: int = 65536

    def fits(self, path: str, head: str, labels: dict[str, str], listener: str) -> bool:
        names = (path, os.path.basename(path), path.replace("\\", "/"))
        return (
            (not self.path_glob or any(fnmatch.fnmatchcase(n, g) for g in self.path_glob for n in names))
            and (not self.content_contains or any(c in head[: self.scan_bytes] for c in self.content_contains))
            and all(labels.get(k) == v for k, v in self.label_equals.items())
            and (not self.listener or self.listener == listener)
        )


@dataclass
class FieldMeta:
    kind: str = "gauge"
    unit: str = ""
    unit_hint: str = ""
    description: str = ""
    max_interval: str = "0"
    limits: dict = field(default_factory=dict)

    def declaration(self) -> dict:
        return {"kind": self.kind, "unit": self.unit, "max_interval_ms": milliseconds(str(self.max_interval)), "limit_min": self.limits.get("min"), "limit_max": self.limits.get("max")}


@dataclass
class Profile:
    name: str
    timestamp: Any
    select: Any = field(default_factory=dict)
    framing: Any = field(default_factory=dict)
    labels: list = field(default_factory=list)
    fields: dict = field(default_factory=dict)
    patterns: list = field(default_factory=list)
    bucket_sets: list = field(default_factory=list)

    def __post_init__(self):
        self.timestamp = _strict(Timestamp, self.timestamp, f"profile {self.name}: timestamp")
        self.select = _strict(Selector, self.select, f"profile {self.name}: select")
        self.framing = _strict(Framing, self.framing, f"profile {self.name}: framing")
        self.fields = {k: _strict(FieldMeta, v or {}, f"field {k}") for k, v in self.fields.items()}
        self.patterns = [_strict(Pattern, p, f"profile {self.name}: pattern") for p in self.patterns]
        self.bucket_sets = [_strict(Buckets, b, f"profile {self.name}: bucket set") for b in self.bucket_sets]
        self.by_name = {b.name: b for b in self.bucket_sets}
        for p in self.patterns:
            if p.bucket_set and p.bucket_set not in self.by_name:
                raise BadSpec(f"profile {self.name}: unknown bucket set {p.bucket_set!r}")


@dataclass
class Identity:
    regex: str = ""
    match_path: str = ""
    scan_lines: int = 500

    def __post_init__(self):
        for r in (self.regex, self.match_path):
            if r:
                regex("identity", r)

    def labels(self, path: str, lines: list[str]) -> dict[str, str]:
        """Labels of a stream by its path and first lines."""
        found: dict[str, str] = {}
        if self.match_path:
            m = re.search(self.match_path, path)
            if not m:
                return {}
            found |= {k: v for k, v in m.groupdict().items() if v}
        if self.regex:
            for line in lines[: self.scan_lines]:
                if m := re.search(self.regex, line):
                    return found | {k: v for k, v in m.groupdict().items() if v}
        return found


@dataclass
class SetOptions:
    retention: str = ""
    shard: str = ""
    key: str = "content"

    @property
    def retention_ms(self) -> int:
        return milliseconds(self.retention) if self.retention else 0


@dataclass
class Spec:
    version: int
    profiles: list = field(default_factory=list)
    defaults: dict = field(default_factory=dict)
    identity: list = field(default_factory=list)
    sets: dict = field(default_factory=dict)
    include: list = field(default_factory=list)
    route_allow: list = field(default_factory=list)

    def __post_init__(self):
        if self.version != 1:
            raise BadSpec(f"unsupported version {self.version}")
        self.profiles = [p if isinstance(p, Profile) else _strict(Profile, p, "profile") for p in self.profiles]
        self.identity = [r if isinstance(r, Identity) else _strict(Identity, r, "identity") for r in self.identity]
        self.sets = {k: s if isinstance(s, SetOptions) else _strict(SetOptions, s or {}, f"set {k}") for k, s in self.sets.items()}
        stamp = self.defaults.get("timestamp") or {}
        self.timezone = stamp.get("timezone") or "UTC"
        self.assume_year = str(stamp.get("assume_year") or "now")
        if self.assume_year not in ("now", "file-mtime") and not (self.assume_year.isdigit() and 1970 <= int(self.assume_year) <= 9999):
            raise BadSpec(f"unknown assume_year {self.assume_year!r}")
        self.labels = list(self.defaults.get("labels") or [])
        if self.route_allow:
            for p in self.profiles:
                for t in p.patterns:
                    for r in t.route:
                        if r.set not in self.route_allow:
                            raise BadSpec(f"route to {r.set!r} isn't allowed")
        if fatal := [x for x in lint(self) if x.fatal]:
            raise BadSpec(f"{fatal[0].code}: {fatal[0].message}")

    def profile(self, path: str, head: str = "", labels: dict[str, str] | None = None, listener: str = "") -> Profile | None:
        return next((p for p in self.profiles if p.select.fits(path, head, labels or {}, listener)), None)

    def stream_labels(self, path: str, lines: list[str]) -> dict[str, str]:
        """Later rules overwrite earlier ones."""
        found: dict[str, str] = {}
        for rule in self.identity:
            found |= rule.labels(path, lines)
        return found

    def declare(self, catalogue) -> None:
        """Field metadata goes to every set whose branch captures the field; bucket sets to their patterns' sets."""
        for p in self.profiles:
            for t in p.patterns:
                for target, _, names in t.branches:
                    for n in ({t.aggregate.field} if t.aggregate else set(names)) & set(p.fields):
                        catalogue.declare(target, n, **p.fields[n].declaration())
                    if t.bucket_set:
                        b = p.by_name[t.bucket_set]
                        catalogue.declare_buckets(target, b.name, b.buckets, b.values, b.edge_unit)


def lint(spec: Spec) -> list[Lint]:
    """What is wrong with a spec that can be read; some of it stops it."""
    out = []
    for p in spec.profiles:
        captured: set[str] = set()
        for k, t in enumerate(p.patterns):
            labels = {*spec.labels, *p.labels, *t.labels}
            for j, earlier in enumerate(p.patterns[:k]):
                if earlier.search in t.search:
                    out.append(Lint("L001", f"profile {p.name}: pattern {k} is never reached, as pattern {j} takes all its lines", True))
                    break
            names = t.names()
            captured |= names | ({t.aggregate.field} if t.aggregate else set()) | set(t.default_values)
            for n in sorted(names - labels - set(p.fields) - {"buckets", "histogram"} - ({p.by_name[t.bucket_set].total_field} if t.bucket_set else set())):
                out.append(Lint("L002", f"profile {p.name}: capture {n!r} is neither label nor declared field and becomes an untyped gauge"))
            if t.store_stream_label and t.store_stream_label in names:
                out.append(Lint("L005", f"profile {p.name}: {t.store_stream_label!r} is captured and a stream label", True))
            if t.aggregate and (lost := names - labels - {t.aggregate.field}):
                out.append(Lint("L007", f"profile {p.name}: the aggregate of pattern {k} loses {', '.join(sorted(lost))}"))
            if clash := labels & set(p.fields):
                out.append(Lint("L008", f"profile {p.name}: {sorted(clash)[0]!r} is label and field", True))
            for _, r, _ in t.branches:
                if re.search(r"\([^()]*[+*][^()]*\)[+*]", r):
                    out.append(Lint("L009", f"profile {p.name}: a repeat inside a repeat in {r!r}"))
        out += [Lint("L003", f"profile {p.name}: field {f!r} is never captured") for f in p.fields if f not in captured]
        out += [Lint("L004", f"profile {p.name}: label {x!r} is never captured") for x in p.labels if x not in captured]
    return out


def read_yaml(text: str) -> Any:
    """A YAML document in which only true and false are booleans: ``on`` is a key of specs."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {c: [(tag, r) for tag, r in rules if tag != "tag:yaml.org,2002:bool"] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml.load(text, Loader)  # noqa: S506  a safe loader


def parse_spec(text: str | dict) -> Spec:
    """A spec without includes."""
    if isinstance(text, str):
        text = read_yaml(text)
    spec = _strict(Spec, text, "spec")
    if spec.include:
        raise BadSpec("include needs a file; use load_spec()")
    return spec


def load_spec(path: str) -> Spec:
    """A spec file with its includes: cycles are refused, a file that is included twice counts once."""
    done: set[str] = set()

    def load(p: str, above: tuple[str, ...]) -> dict:
        full = os.path.abspath(p)
        if full in above:
            raise BadSpec(f"include cycle at {full}")
        if full in done:
            return {}
        done.add(full)
        with open(full, encoding="utf-8") as f:
            d = read_yaml(f.read())
        for i in d.pop("include", None) or []:
            sub = load(os.path.join(os.path.dirname(full), i), (*above, full))
            for k in ("profiles", "identity"):
                d[k] = (d.get(k) or []) + (sub.get(k) or [])
            d["sets"] = (sub.get("sets") or {}) | (d.get("sets") or {})
            own, theirs = d.setdefault("defaults", {}), sub.get("defaults") or {}
            own["timestamp"] = (theirs.get("timestamp") or {}) | (own.get("timestamp") or {})
            own["labels"] = list(dict.fromkeys((own.get("labels") or []) + (theirs.get("labels") or [])))
        return d

    return parse_spec(load(path, ()))
