"""The render walk: a series becomes the exact minimum and maximum of each window, with breaks where data is missing.

Points are dealt to tasks by series and sorted by series and instant; a task then goes through its batches once, in array
operations, and keeps only what is open: the last sample, the open window with its extremes and breaks, and the last point
drawn. Memory is a batch, whatever a series' length.

- samples of the same instant collapse to the first by their tie order;
- gap, delta and rate of a sample come from the sample before it;
- windows are anchored: one opens at the first accepted sample, the next at the first sample more than the width later;
- a window's minimum and maximum are the earliest of equals; of the breaks before, between and after them the last survives.
  A break in front of a sample that opens a window belongs to the window before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

PAD_MS = 500
NEVER = -(1 << 62)


@dataclass(frozen=True)
class Spec:
    """How one field is drawn."""

    delta: bool = False
    per_second: bool = False
    negate: bool = False
    gap_ms: int = 0
    low: float | None = None
    high: float | None = None
    raw_escape: bool = False
    padding: str = "const"
    padding_value: float = 0.0
    end_ms: int = 0


def single_window(range_ms: int, max_points: int, interval_ms: int) -> int:
    width = int(range_ms / max_points) if max_points > 0 else range_ms
    return max(0, min(width, interval_ms) if interval_ms > 0 else width)


def window_width(range_ms: int, max_points: int, interval_ms: int) -> int:
    """Twice the width of a point, as each window draws two."""
    return 2 * single_window(range_ms, max_points, interval_ms)


def openings(ts: np.ndarray, width: int, start: int | None = None, inclusive: bool = False) -> np.ndarray:
    """Which of the sorted instants open an anchored window, the window from ``start`` being open before.

    A window holds what is at most ``width`` after its start; ``inclusive``: what is less.
    """
    marks = np.zeros(len(ts), bool)
    side = "left" if inclusive else "right"
    k = 0 if start is None else int(ts.searchsorted(start + width, side))
    if width == 0 and not inclusive and start is None:
        marks[:] = True
        return marks
    while k < len(ts):
        marks[k] = True
        k = max(k + 1, int(ts.searchsorted(ts[k] + width, side)))
    return marks


def clamped(value: np.ndarray, raw: np.ndarray, spec: Spec) -> np.ndarray:
    if spec.low is not None:
        value = np.where(value < spec.low, raw if spec.raw_escape else float(spec.low), value)
    if spec.high is not None:
        value = np.where(value > spec.high, raw if spec.raw_escape else float(spec.high), value)
    return value


class Series:
    """One series on its way through the walk: add() takes sorted samples, finish() closes; both give drawn points."""

    def __init__(self, spec: Spec, width: int):
        self.spec, self.width = spec, width
        self.ts: int | None = None  # the last sample
        self.raw = 0.0
        #: The open window: start, lo, its instant, the last break before it, hi, and so on, the last break of all.
        self.open: tuple | None = None
        self.first, self.drawn = True, NEVER
        self.held: tuple | None = None  # the last point drawn, which waits for the next to know its room
        self.before: tuple[int, bool] | None = None

    def add(self, ts: np.ndarray, raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        new = np.concatenate([[self.ts is None or ts[0] != self.ts], ts[1:] != ts[:-1]])
        ts, raw = ts[new], raw[new]
        if not len(ts):
            return []
        s, known = self.spec, self.ts is not None
        before_ts = np.concatenate([[self.ts if known else 0], ts[:-1]])
        before_raw = np.concatenate([[self.raw], raw[:-1]])
        self.ts, self.raw = int(ts[-1]), float(raw[-1])
        value = raw - before_raw if s.delta else raw
        value = clamped(-value if s.negate else value, raw, s)
        gap = np.where(ts - before_ts > s.gap_ms, ts - 1, NEVER) if s.gap_ms else np.full(len(ts), NEVER)
        if s.per_second:
            with np.errstate(all="ignore"):
                value = value / ((ts - before_ts) / 1000.0)
        if not known:
            gap[0] = NEVER
            if s.delta or s.per_second:
                ts, value, gap = ts[1:], value[1:], gap[1:]
        return self._windows(ts, value, gap) if len(ts) else []

    def _windows(self, ts: np.ndarray, value: np.ndarray, gap: np.ndarray) -> list:
        marks = openings(ts, self.width, self.open[0] if self.open else None)
        starts = np.flatnonzero(marks)
        if self.open is not None and (not len(starts) or starts[0]):
            starts = np.concatenate([[0], starts])  # the first stretch goes on with the open window
        own = gap.copy()
        moved = marks.copy()
        if self.first and moved[0]:
            moved[0] = False  # there is no window before the first
        own[moved] = NEVER
        last = np.maximum.accumulate(own)
        n, at = len(starts), np.arange(len(ts))
        which = np.repeat(np.arange(n), np.diff(np.append(starts, len(ts))))
        ends = np.append(starts[1:], len(ts)) - 1
        # Breaks of earlier windows lie before the window's first sample; only its own break may do so in the first one.
        floor = np.where(marks[starts], ts[starts], NEVER + 1)
        if self.first and marks[0]:
            floor[0] = NEVER + 1
        if self.open is not None and not marks[0]:
            last = np.where(which == 0, np.maximum(last, self.open[7]), last)
        last = np.where(last > floor[which], last, NEVER)
        lo, hi = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
        first_of = lambda best: np.minimum.reduceat(np.where(value == best[which], at, len(ts)), starts)
        lo_at, hi_at = np.minimum(first_of(lo), ends), np.minimum(first_of(hi), ends)
        w = [ts[starts], lo, ts[lo_at], last[lo_at], hi, ts[hi_at], last[hi_at], last[ends]]
        if self.open is not None:
            o = self.open
            if marks[0]:
                w = [np.concatenate([[x], c]) for x, c in zip(o, w, strict=True)]
                after = np.concatenate([gap[starts], [NEVER]])
            else:
                w[0][0] = o[0]
                if not lo[0] < o[1]:
                    w[1][0], w[2][0], w[3][0] = o[1], o[2], o[3]
                if not hi[0] > o[4]:
                    w[4][0], w[5][0], w[6][0] = o[4], o[5], o[6]
                after = np.append(gap[starts[1:]], NEVER)
        else:
            after = np.append(gap[starts[1:]], NEVER)
        self.first = False
        self.open = tuple(x[-1].item() for x in w)
        return self._draw([x[:-1] for x in w], after[:-1])

    def _draw(self, w: list[np.ndarray], after: np.ndarray, tail: int | None = None) -> list:
        """The points of finished windows: break, extreme, break, extreme, break."""
        _, lo, lo_ts, lo_gap, hi, hi_ts, hi_gap, last = w
        early = lo_ts < hi_ts
        a, b = np.minimum(lo_ts, hi_ts), np.maximum(lo_ts, hi_ts)
        late = np.maximum(np.where(last > b, last, NEVER), after)
        ga, gb = np.where(early, lo_gap, hi_gap), np.where(early, hi_gap, lo_gap)
        one = lo_ts == hi_ts
        columns = [ga, a, np.where((gb > a) & (gb < b), gb, NEVER), np.where(one, NEVER, b), late]
        ts = np.stack(columns, 1).ravel() if len(a) else np.empty(0, np.int64)
        nothing = np.full(len(a), np.nan)
        value = np.stack([nothing, np.where(early, lo, hi), nothing, np.where(early, hi, lo), nothing], 1).ravel() if len(a) else np.empty(0)
        null = np.tile([True, False, True, False, True], len(a))
        keep = ts != NEVER
        ts, value, null = ts[keep], value[keep], null[keep]
        if tail is not None:
            ts, value, null = np.append(ts, tail), np.append(value, np.nan), np.append(null, True)
        return self._pad(ts, value, null)

    def _pad(self, ts: np.ndarray, value: np.ndarray, null: np.ndarray, end: bool = False) -> list:
        """A point between breaks or edges gets a neighbour on both sides, where there is room."""
        if self.held is not None:
            ts, value, null = np.append(self.held[0], ts), np.append(self.held[1], value), np.append(self.held[2], null)
        if not len(ts):
            return []
        if not end:
            self.held = ts[-1], value[-1], null[-1]
        n = len(ts) - (not end)
        if not n:
            return []
        prev_ts = np.concatenate([[self.before[0] if self.before else NEVER], ts[: n - 1]])
        prev_null = np.concatenate([[self.before[1] if self.before else True], null[: n - 1]])
        far = 1 << 62
        next_ts = np.append(ts[1:n], ts[n] if not end else far)
        next_null = np.append(null[1:n], null[n] if not end else True)
        ts, value, null = ts[:n], value[:n], null[:n]
        self.before = int(ts[-1]), bool(null[-1])
        if self.spec.padding != "off":
            alone = ~null & prev_null & next_null
            left, right = np.maximum(ts - PAD_MS, prev_ts + 1), np.minimum(ts + PAD_MS, next_ts - 1)
            shown = value if self.spec.padding == "repeat" else np.full(n, float(self.spec.padding_value))
            keep = np.stack([alone & (left < ts), np.ones(n, bool), alone & (right > ts)], 1).ravel()
            null = np.stack([np.zeros(n, bool), null, np.zeros(n, bool)], 1).ravel()[keep]
            value = np.stack([shown, value, shown], 1).ravel()[keep]
            ts = np.stack([left, ts, right], 1).ravel()[keep]
        return [(ts, value, null)]

    def finish(self) -> list:
        if self.open is None:
            return []
        s, o = self.spec, self.open
        w = [np.array([x]) for x in o]
        last = max(o[2], o[5], o[7] if o[7] > max(o[2], o[5]) else NEVER)
        tail = self.ts + s.gap_ms if s.gap_ms and s.end_ms > 0 and s.end_ms - self.ts > s.gap_ms and self.ts + s.gap_ms > last else None
        out = self._draw(w, np.array([NEVER]), tail)
        return out + self._pad(np.empty(0, np.int64), np.empty(0), np.empty(0, bool), end=True)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Where rows differ from the row before in any column; nulls are alike."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def walk(points: DataFrame, keys: list[str], spec: Spec, width: int) -> DataFrame:
    """(keys, ts, value, is_null) of points (keys, ts, tie, value); values are finite."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        series: Series | None = None
        names: list[tuple] = []
        made: list[tuple] = []
        types: list[pa.DataType] = []

        def take(found: list) -> None:
            for x in found:
                names.append(key)
                made.append(x)

        def send() -> pa.RecordBatch:
            sizes = [len(x[0]) for x in made]
            at = pa.array(np.repeat(np.arange(len(made)), sizes))
            ts, value, null = (np.concatenate([x[k] for x in made]) for k in range(3))
            bad = null | ~np.isfinite(value)
            out = [pa.array([k[j] for k in names], types[j]).take(at) for j in range(n)]
            names.clear()
            made.clear()
            return pa.RecordBatch.from_arrays([*out, pa.array(ts, pa.int64()), pa.array(value, pa.float64(), mask=bad), pa.array(bad)], names=[*keys, "ts", "value", "is_null"])

        for b in batches:
            if not b.num_rows:
                continue
            types = [c.type for c in b.columns[:n]]
            ts, value = b.column(n).to_numpy(), b.column(n + 1).to_numpy()
            starts = np.flatnonzero(changes(b.columns[:n]))
            for i, j in zip(starts, np.append(starts[1:], len(ts)), strict=True):
                own = tuple(c[int(i)].as_py() for c in b.columns[:n])
                if series is None or own != key:
                    if series is not None:
                        take(series.finish())
                    key, series = own, Series(spec, width)
                take(series.add(ts[i:j], value[i:j]))
            if made:
                yield send()
        if series is not None:
            take(series.finish())
            if made:
                yield send()

    columns = [F.col(f"`{k}`") for k in keys]
    dealt = points.select(*columns, "ts", "value", "tie").repartition(*columns).sortWithinPartitions(*columns, "ts", "tie").select(*columns, "ts", F.col("value").cast("double").alias("value"))
    schema = StructType([*[points.schema[k] for k in keys], StructField("ts", LongType()), StructField("value", DoubleType()), StructField("is_null", BooleanType())])
    return dealt.mapInArrow(run, schema)
