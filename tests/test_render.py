import random

from tidemark.operators.render import Spec, walk, window_width

KEYS = ["host", "field"]


def naive(points, s, width):
    """The walk, one sample after the other."""
    accepted, last, last_value = [], None, None
    for ts, _, raw in sorted(points, key=lambda p: (p[0], p[1])):
        if ts == last:
            continue
        gap = ts - 1 if last is not None and s.gap_ms and ts - last > s.gap_ms else None
        before, before_value, last, last_value = last, last_value, ts, raw
        v = raw
        if s.delta:
            if before is None:
                continue
            v = raw - before_value
        v = -v if s.negate else v
        if s.low is not None and v < s.low:
            v = raw if s.raw_escape else s.low
        if s.high is not None and v > s.high:
            v = raw if s.raw_escape else s.high
        if s.per_second:
            if before is None:
                continue
            v /= (ts - before) / 1000.0
        accepted.append((ts, v, gap))
    windows, start = [], None
    for ts, v, gap in accepted:
        if start is None or ts - start > width:
            if gap is not None and windows:
                windows[-1][1].append(gap)
                gap = None
            start = ts
            windows.append(([], []))
        if gap is not None:
            windows[-1][1].append(gap)
        windows[-1][0].append((ts, v))
    out = []
    for points_, gaps in windows:
        a, b = sorted([min(points_, key=lambda x: (x[1], x[0])), max(points_, key=lambda x: (x[1], -x[0]))])
        parts = [[g for g in gaps if g < a[0]], [g for g in gaps if a[0] < g < b[0]], [g for g in gaps if g > b[0]]]
        early, mid, late = ([(g, None) for g in p[-1:]] for p in parts)
        out += [*early, a, *mid, *([b] if b[0] != a[0] else []), *late]
    if out and s.gap_ms and s.end_ms > 0 and s.end_ms - last > s.gap_ms and last + s.gap_ms > out[-1][0]:
        out.append((last + s.gap_ms, None))
    if s.padding == "off":
        return out
    padded = []
    for i, (ts, v) in enumerate(out):
        first, final = i == 0, i == len(out) - 1
        alone = v is not None and (first or out[i - 1][1] is None) and (final or out[i + 1][1] is None)
        side = v if s.padding == "repeat" else s.padding_value
        left = ts - 500 if first else max(ts - 500, out[i - 1][0] + 1)
        right = ts + 500 if final else min(ts + 500, out[i + 1][0] - 1)
        padded += [(left, side)] * (alone and left < ts) + [(ts, v)] + [(right, side)] * (alone and right > ts)
    return padded


def drawn(spark, points, spec, width):
    rows = [("h", "v", ts, f"{i:03d}", float(v)) for i, (v, ts) in enumerate(points)]
    got = walk(spark.createDataFrame(rows, "host string, field string, ts long, tie string, value double"), KEYS, spec, width)
    return sorted((r.ts, r.value) for r in got.collect())


def test_random_series(spark):
    rng = random.Random(5)
    rows = []
    for k in range(25):
        ts = 1_700_000_000_000
        for i in range(rng.randint(1, 50)):
            ts += rng.choice([0, 500, 1000, 30_000, rng.randint(1, 150_000)])
            rows.append((f"s{k}" if k % 7 else None, f"v{k}", ts, f"{i:04d}", float(rng.choice([0, 1, 2, 5, rng.randint(0, 1000)]))))
    df = spark.createDataFrame(rows, "host string, field string, ts long, tie string, value double").cache()
    by = {}
    for host, field, ts, tie, v in rows:
        by.setdefault((host, field), []).append((ts, tie, v))
    for _ in range(5):
        s = Spec(rng.random() < 0.5, rng.random() < 0.4, rng.random() < 0.3, rng.choice([0, 10_000, 60_000]), rng.choice([None, 0.0, 10.0]), rng.choice([None, 100.0]), rng.random() < 0.5, rng.choice(["off", "const", "repeat"]), 0.0, rng.choice([0, 1_700_010_000_000]))
        width = rng.choice([0, 1000, 60_000, 600_000])
        got = {}
        for r in walk(df, KEYS, s, width).collect():
            got.setdefault((r.host, r.field), []).append((r.ts, r.value))
        for k, points in by.items():
            expected, found = naive(points, s, width), sorted(got.get(k, []))
            assert [x[0] for x in expected] == [x[0] for x in found], (s, width)
            assert all((a[1] is None) == (b[1] is None) and (a[1] is None or abs(a[1] - b[1]) < 1e-9) for a, b in zip(expected, found, strict=True))


def test_fixtures(spark):
    off = {"padding": "off"}
    assert (59_999, None) in drawn(spark, [(1, 1000), (2, 2000), (3, 60_000), (4, 61_000)], Spec(gap_ms=10_000, **off), 0)
    resets = [(100, 1000), (150, 2000), (7, 3000)]
    assert drawn(spark, resets, Spec(delta=True, low=0.0, raw_escape=True, **off), 0)[-1] == (3000, 7.0)
    assert drawn(spark, resets, Spec(delta=True, low=0.0, **off), 0)[-1] == (3000, 0.0)
    assert (2000, 9.0) in drawn(spark, [(5, 1000), (9, 2000), (9, 3000), (5, 4000)], Spec(**off), 10_000)
    assert drawn(spark, [(42, 5000)], Spec(), 60_000) == [(4500, 0.0), (5000, 42.0), (5500, 0.0)]
    assert drawn(spark, [(42, 5000)], Spec(padding="repeat"), 60_000) == [(4500, 42.0), (5000, 42.0), (5500, 42.0)]
    assert drawn(spark, [(1, 1000), (2, 1000), (3, 1000), (4, 40_000)], Spec(gap_ms=5000, **off), 0) == [(1000, 1.0), (39_999, None), (40_000, 4.0)]
    assert drawn(spark, [(1, 1000), (1, 2000), (1, 3000)], Spec(gap_ms=2000, end_ms=63_000, **off), 0)[-1] == (5000, None)
    assert drawn(spark, [(5, 1000)], Spec(per_second=True, gap_ms=10, end_ms=100_000), 0) == []


def test_window_width():
    assert [window_width(*x) for x in ((3_600_000, 1200, 60_000), (3_600_000, 1200, 1000), (100, 1200, 0))] == [6000, 2000, 0]


def test_a_series_in_pieces_is_the_same():
    """Batches end anywhere in a series; the walk must not show it."""
    import numpy as np

    from tidemark.operators.render import Series

    rng = np.random.default_rng(6)
    for t in range(300):
        n = int(rng.integers(1, 60))
        ts, value = np.sort(rng.integers(1, 4000, n)) * 50, rng.integers(-5, 6, n).astype(float)
        spec = Spec(delta=t % 2 == 1, per_second=t % 3 == 1, negate=t % 5 == 1, gap_ms=int(rng.choice([0, 300, 5000])), low=[None, -2.0][t % 2], raw_escape=t % 4 == 1, padding=["const", "repeat", "off"][t % 3], padding_value=1.5, end_ms=int(rng.choice([0, 300_000])))
        width = int(rng.choice([0, 1, 700, 20_000, 10**9]))

        def drawn(cuts, spec=spec, width=width, ts=ts, value=value):
            s, out = Series(spec, width), []
            for a, b in zip([0, *cuts], [*cuts, len(ts)], strict=True):
                if b > a:
                    out += s.add(ts[a:b], value[a:b])
            out += s.finish()
            return [(int(x), None if z else float(y), bool(z)) for p in out for x, y, z in zip(*p, strict=True)]

        whole = drawn([])
        assert drawn(sorted(rng.integers(0, n + 1, 4).tolist())) == whole == drawn(list(range(1, n)))
        assert [x for x, _, _ in whole] == sorted({x for x, _, _ in whole})
