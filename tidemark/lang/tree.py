"""The query tree: what a text means, its JSON form, and its canonical text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

NAME = re.compile(r"[^\W\d][\w.\-]*")
VARIABLE = re.compile(r"\$([^\W\d][\w.\-]*)")
#: Reserved words (fixed values).
KEYWORDS = frozenset(
    "FROM SELECT WHERE BY EVERY FORMAT LIMIT AS AND OR NOT IN HAS MISSING DELTA PER SECOND RATE NEGATE REQUIRED GAP SSE CLAMP MIN MAX ELSE RAW BOUND REPEAT OFF SERIES POINTS HISTOGRAM SETS FIELDS LABELS LABEL KEYS".split()
)
FORMATS = ("timeseries", "table", "heatmap", "logs")
KINDS = ("query", "sets", "fields", "labels", "label_keys")
#: Milliseconds of a unit (fixed values).
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


class Problem(Exception):
    """A diagnostic that stops a query: a stable code, a text, and the place in the query if there is one."""

    def __init__(self, code: str, message: str, at: int | None = None):
        super().__init__(f"{code}" + (f" at {at}" if at is not None else "") + f": {message}")
        self.code, self.message, self.at = code, message, at


@dataclass(frozen=True)
class Note:
    """A diagnostic that travels with a result."""

    code: str
    message: str


@dataclass(frozen=True)
class Value:
    """A compared text; ``literal`` where it looks like a variable but isn't one."""

    text: str
    literal: bool = False

    @property
    def variable(self) -> str | None:
        m = None if self.literal else VARIABLE.fullmatch(self.text)
        return m[1] if m else None


@dataclass(frozen=True)
class Both:
    """All (``op`` and) or any (``op`` or) of the terms."""

    op: str
    terms: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    term: Any


@dataclass(frozen=True)
class Compare:
    """``op``: eq, ne, in, match, noMatch."""

    op: str
    label: str
    values: tuple[Value, ...]

    @property
    def regex(self) -> str:
        return self.values[0].text


@dataclass(frozen=True)
class Exists:
    name: str
    present: bool = True


@dataclass(frozen=True)
class Clamp:
    low: float | None = None
    high: float | None = None
    otherwise: str = "bound"


@dataclass(frozen=True)
class Padding:
    """What surrounds a point that stands alone: const with a value, repeat, or off."""

    mode: str = "const"
    value: float = 0.0


@dataclass(frozen=True)
class Pick:
    """A selected field or bucket set with its modifiers."""

    field: str = ""
    histogram: str = ""
    alias: str = ""
    delta: bool = False
    per_second: bool = False
    negate: bool = False
    required: bool = False
    gap_ms: int | None = None
    clamp: Clamp | None = None
    padding: Padding | None = None

    @property
    def name(self) -> str:
        return self.alias or self.histogram or self.field

    def modifiers(self) -> list[str]:
        rate = {(True, True): ["RATE"], (True, False): ["DELTA"], (False, True): ["PER SECOND"], (False, False): []}[self.delta, self.per_second]
        rest = {"NEGATE": self.negate, "CLAMP": self.clamp is not None, "GAP": self.gap_ms is not None, "SSE": self.padding is not None, "REQUIRED": self.required}
        return rate + [k for k, v in rest.items() if v]


@dataclass(frozen=True)
class Query:
    kind: str = "query"
    source: str = ""
    select: tuple[Pick, ...] = ()
    where: Any = None
    by: tuple[str, ...] = ()
    every_ms: int | None = None
    format: str = "timeseries"
    series: int | None = None
    points: int | None = None
    label: str = ""
    notes: tuple[Note, ...] = field(default=(), compare=False)


def nodes(e: Any) -> Iterator[Any]:
    """All nodes of a predicate, outermost first."""
    todo = [e] if e is not None else []
    while todo:
        x = todo.pop()
        yield x
        todo += reversed(x.terms) if isinstance(x, Both) else [x.term] if isinstance(x, Not) else []


def variables(q: Query) -> list[str]:
    """Names of variables in comparisons, each once, in their order."""
    found: dict[str, None] = {}
    for e in nodes(q.where):
        if isinstance(e, Compare):
            if e.op in ("match", "noMatch"):
                found.update(dict.fromkeys(regex_variables(e.regex)))
            else:
                found.update({v.variable: None for v in e.values if v.variable})
    return list(found)


def regex_variables(pattern: str) -> list[str]:
    """Variables in a regex: ``$name`` that no backslash precedes; a trailing dot or dash isn't part of a name."""
    return [m[1].rstrip(".-") for m in re.finditer(r"\\.|\$([^\W\d][\w.\-]*)", pattern, re.S) if m[1]]


def substitute(q: Query, values: dict[str, str | list[str]]) -> Query:
    """The query with variables put in; those without a value stay and are refused by check()."""
    from dataclasses import replace

    def one(v: Value) -> list[Value]:
        got = values.get(v.variable) if v.variable else None
        return [v] if got is None else [Value(x, True) for x in ([got] if isinstance(got, str) else got)]

    def walk(e: Any) -> Any:
        match e:
            case Both():
                return Both(e.op, tuple(map(walk, e.terms)))
            case Not():
                return Not(walk(e.term))
            case Compare(op="match" | "noMatch"):
                put = lambda m: m[0] if not m[1] or not isinstance(values.get(m[1].rstrip(".-")), str) else re.escape(values[m[1].rstrip(".-")]) + m[1][len(m[1].rstrip(".-")) :]
                return replace(e, values=(Value(re.sub(r"\\.|\$([^\W\d][\w.\-]*)", put, e.regex, flags=re.S)),))
            case Compare():
                put_in = tuple(x for v in e.values for x in one(v))
                return Compare("in" if len(put_in) > 1 and e.op == "eq" else e.op, e.label, put_in)
        return e

    return replace(q, where=walk(q.where))


# JSON: the keys are fixed values.


def predicate_json(e: Any) -> dict:
    match e:
        case Both():
            return {e.op: [predicate_json(x) for x in e.terms]}
        case Not():
            return {"not": predicate_json(e.term)}
        case Exists():
            return {"has" if e.present else "missing": e.name}
        case Compare(op="match" | "noMatch"):
            return {e.op: {"label": e.label, "regex": e.regex}}
        case Compare(op="in"):
            marks = [v.literal for v in e.values]
            return {"in": {"label": e.label, "values": [v.text for v in e.values]} | ({"literal": marks} if any(marks) else {})}
    v = e.values[0]
    return {e.op: {"label": e.label, "value": v.text} | ({"literal": True} if v.literal else {})}


def predicate_from(j: dict) -> Any:
    if not isinstance(j, dict) or len(j) != 1:
        raise Problem("E001", "a predicate node sets exactly one of and, or, not, eq, ne, in, match, noMatch, has, missing")
    ((key, x),) = j.items()
    match key:
        case "and" | "or":
            if not x:
                raise Problem("E001", f"an empty predicate node inside {key}")
            return Both(key, tuple(map(predicate_from, x)))
        case "not":
            return Not(predicate_from(x))
        case "has" | "missing":
            return Exists(x, key == "has")
        case "eq" | "ne":
            return Compare(key, x["label"], (Value(x["value"], bool(x.get("literal"))),))
        case "in":
            marks = x.get("literal") or []
            return Compare("in", x["label"], tuple(Value(v, bool(k < len(marks) and marks[k])) for k, v in enumerate(x["values"])))
        case "match" | "noMatch":
            return Compare(key, x["label"], (Value(x["regex"]),))
    raise Problem("E001", f"unknown predicate node {key!r}")


def to_json(q: Query) -> dict:
    def pick(p: Pick) -> dict:
        m: dict = {}
        for key, value in (("delta", p.delta), ("perSecond", p.per_second), ("negate", p.negate), ("required", p.required)):
            if value:
                m[key] = True
        if p.gap_ms is not None:
            m["gapMs"] = p.gap_ms
        if p.clamp:
            m["clamp"] = {k: v for k, v in (("min", p.clamp.low), ("max", p.clamp.high), ("else", p.clamp.otherwise)) if v is not None}
        if p.padding:
            m["sse"] = {"mode": p.padding.mode} | ({"value": p.padding.value} if p.padding.value else {})
        return {k: v for k, v in (("field", p.field), ("histogram", p.histogram), ("as", p.alias)) if v} | {"modifiers": m}

    j: dict = {"kind": q.kind, "from": q.source}
    if q.select:
        j["select"] = [pick(p) for p in q.select]
    if q.where is not None:
        j["where"] = predicate_json(q.where)
    if q.by:
        j["by"] = list(q.by)
    if q.every_ms is not None:
        j["everyMs"] = q.every_ms
    j["format"] = q.format
    j["limits"] = {k: v for k, v in (("series", q.series), ("points", q.points)) if v is not None}
    if q.label:
        j["label"] = q.label
    return j


def from_json(j: dict) -> Query:
    known = {"kind", "from", "select", "where", "by", "everyMs", "format", "limits", "label"}
    if odd := set(j) - known:
        raise Problem("E001", f"unknown key {sorted(odd)[0]!r}")

    def pick(x: dict) -> Pick:
        m = x.get("modifiers") or {}
        c, s = m.get("clamp"), m.get("sse")
        return Pick(
            x.get("field", ""), x.get("histogram", ""), x.get("as", ""), bool(m.get("delta")), bool(m.get("perSecond")), bool(m.get("negate")), bool(m.get("required")), m.get("gapMs"),
            None if c is None else Clamp(c.get("min"), c.get("max"), c.get("else") or "bound"), None if s is None else Padding(s.get("mode") or "const", s.get("value", 0.0)),
        )

    limits = j.get("limits") or {}
    where = j.get("where") or None
    return Query(j.get("kind") or "query", j.get("from", ""), tuple(map(pick, j.get("select") or ())), None if where is None else predicate_from(where), tuple(j.get("by") or ()), j.get("everyMs"), j.get("format") or "timeseries", limits.get("series"), limits.get("points"), j.get("label", ""))


# Canonical text: parse(text(q)) == q.


def quoted(s: str) -> str:
    return '"' + s.translate({ord("\\"): "\\\\", ord('"'): '\\"', 10: "\\n", 9: "\\t", 13: "\\r"}) + '"'


def name(s: str) -> str:
    return s if NAME.fullmatch(s) and s.upper() not in KEYWORDS else quoted(s)


def number(x: float) -> str:
    """The shortest decimal that reads back as ``x``."""
    if x != x:
        return "0"
    x = max(min(x, 1.7976931348623157e308), -1.7976931348623157e308)
    plain = format(__import__("decimal").Decimal(repr(float(x))), "f")
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return plain if len(plain) <= 24 else repr(float(x))


def duration(ms: int) -> str:
    if ms == 0:
        return "0"
    unit = next(u for u in ("d", "h", "m", "s", "ms") if ms % UNITS[u] == 0)
    return f"{ms // UNITS[unit]}{unit}"


def _predicate(e: Any, nested: bool = False) -> str:
    match e:
        case Both():
            s = f" {e.op.upper()} ".join(_predicate(x, True) for x in e.terms)
            return f"({s})" if nested else s
        case Not():
            return "NOT " + _predicate(e.term, True)
        case Exists():
            return ("HAS " if e.present else "MISSING ") + name(e.name)
        case Compare(op="match" | "noMatch"):
            # In a regex only the delimiter and what the lexer would decode need a backslash more.
            escaped = re.sub(r"\\([ntr\\/])|/|[\n\t\r]", lambda m: "\\\\" + m[1] if m[1] in tuple("ntr") else "\\\\\\\\" if m[1] == "\\" else "\\\\\\/" if m[1] == "/" else {"/": "\\/", "\n": "\\n", "\t": "\\t", "\r": "\\r"}[m[0]], e.regex)
            return f"{name(e.label)} {'=~' if e.op == 'match' else '!~'} /{escaped}/"
    values = [v.text if v.variable else quoted(v.text) for v in e.values]
    return f"{name(e.label)} IN ({', '.join(values)})" if e.op == "in" else f"{name(e.label)} {'=' if e.op == 'eq' else '!='} {values[0]}"


def _pick(p: Pick) -> str:
    out = [f"HISTOGRAM({name(p.histogram)})" if p.histogram else name(p.field)]
    for m in p.modifiers():
        match m:
            case "CLAMP":
                bounds = [f"{k} {number(v)}" for k, v in (("MIN", p.clamp.low), ("MAX", p.clamp.high)) if v is not None]
                m = f"CLAMP {', '.join(bounds)}" + " ELSE RAW" * (p.clamp.otherwise == "raw")
            case "GAP":
                m = f"GAP {duration(p.gap_ms)}"
            case "SSE":
                m = "SSE " + (p.padding.mode.upper() if p.padding.mode in ("repeat", "off") else number(p.padding.value))
        out.append(m)
    return " ".join(out + ([f"AS {quoted(p.alias)}"] if p.alias else []))


def text(q: Query) -> str:
    """The canonical text."""
    where = [f"WHERE  {_predicate(q.where)}"] if q.where is not None else []
    match q.kind:
        case "sets":
            return "SETS"
        case "fields":
            return f"FIELDS FROM {name(q.source)}"
        case "label_keys":
            return f"LABEL KEYS FROM {name(q.source)}"
        case "labels":
            return "\n".join([f"LABELS {name(q.label)}", *where])
    lines = [f"FROM   {name(q.source)}", "SELECT " + ",\n       ".join(map(_pick, q.select)), *where]
    if q.by:
        lines.append("BY     " + ", ".join(map(name, q.by)))
    if q.every_ms is not None:
        lines.append(f"EVERY  {duration(q.every_ms)}")
    if q.format != "timeseries":
        lines.append(f"FORMAT {q.format}")
    if limits := [f"{k} {v}" for k, v in (("SERIES", q.series), ("POINTS", q.points)) if v is not None]:
        lines.append("LIMIT  " + ", ".join(limits))
    return "\n".join(lines)
