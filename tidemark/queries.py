"""Queries over the test tables, as sets of samples, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.render import Spec
from tidemark.plans.catalogue import Catalogue
from tidemark.plans.planner import Planner, Request

LAST_MS = 253402300799999
HOUR, DAY = 3_600_000, 86_400_000
EDGES = [0.0, 25.0, 50.0, 75.0, 100.0]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Epoch milliseconds of a timestamp, whatever its kind and the session's zone."""
    return F.expr(f"floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) / 1000)").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set ``events``: labels event_type and user_id, field value, and a count for each bucket of value."""
    value = F.col("value")
    buckets = [F.when((value >= lo) & ((value < hi) if hi is not None else F.lit(True)), 1).cast("long").alias(f"b{k}") for k, (lo, hi) in enumerate(zip(EDGES, [*EDGES[1:], None], strict=True))]
    return read(spark, sf_dir, "events").select(
        millis("ts").alias("ts_ms"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("pk"), "event_type", F.col("user_id").cast("string").alias("user_id"), value,
        F.when(value > 50, F.col("event_type")).alias("loud"), *buckets,
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set ``orders``: labels status and priority, field total; a day has many samples of the same instant."""
    return read(spark, sf_dir, "orders").select(
        millis("o_orderdate").alias("ts_ms"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("pk"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total")
    )


def catalogue() -> Catalogue:
    c = Catalogue()
    c.observe("events", ["event_type", "user_id", "loud"], {"value": "double"} | {f"b{k}": "long" for k in range(len(EDGES))}, 1, LAST_MS)
    c.declare_buckets("events", "amount", [f"b{k}" for k in range(len(EDGES))], EDGES)
    c.observe("orders", ["status", "priority"], {"total": "double"}, 1, LAST_MS)
    return c


def planner(spark: SparkSession, sf_dir: str) -> Planner:
    return Planner(catalogue(), lambda s: {"events": events, "orders": orders}[s](spark, sf_dir))


#: Name: query text; see SERIES and the SQL below for the same by hand.
TEXTS: dict[str, str] = {
    "series_by_type": "FROM events SELECT value BY event_type EVERY 1h",
    "series_all": "FROM events SELECT value SSE OFF EVERY 6h",
    "series_zero_window": 'FROM events SELECT value SSE OFF WHERE user_id = "7" EVERY 1ms',
    "series_delta": "FROM events SELECT value DELTA BY event_type EVERY 2h",
    "series_rate_gap": "FROM events SELECT value RATE GAP 10m BY event_type EVERY 1h",
    "series_per_second": "FROM events SELECT value PER SECOND GAP 30m SSE REPEAT BY event_type EVERY 3h",
    "series_negate": "FROM events SELECT value NEGATE GAP 1h BY user_id EVERY 1d",
    "series_clamp_bound": "FROM events SELECT value CLAMP MIN 10, MAX 60 BY event_type EVERY 1h",
    "series_clamp_raw": "FROM events SELECT value DELTA CLAMP MIN 0 ELSE RAW GAP 5m SSE 1.5 BY event_type EVERY 30m",
    "series_isolated": "FROM events SELECT value GAP 2h BY user_id EVERY 12h",
    "series_absent_label": "FROM events SELECT value BY loud EVERY 1d",
    "series_two_fields": "FROM events SELECT value, b3 AS third BY event_type EVERY 1d",
    "series_interleaved": "FROM orders SELECT total BY status EVERY 30d",
    "series_limit": "FROM events SELECT value BY user_id EVERY 1d LIMIT SERIES 5",
    "where_equal": 'FROM events SELECT value WHERE event_type = "click" BY user_id EVERY 1d',
    "where_not_equal": 'FROM events SELECT value WHERE loud != "click" BY event_type EVERY 1d',
    "where_in": 'FROM events SELECT value WHERE event_type IN ("click", "view", "nothing") BY event_type EVERY 1d',
    "where_match": "FROM events SELECT value WHERE event_type =~ /^(c|v)/ BY event_type EVERY 1d",
    "where_no_match": "FROM events SELECT value WHERE loud !~ /i/ BY event_type EVERY 1d",
    "where_has": "FROM events SELECT value WHERE HAS loud AND HAS b3 BY event_type EVERY 1d",
    "where_missing": 'FROM events SELECT value WHERE MISSING loud OR event_type = "click" BY event_type EVERY 1d',
    "where_not": 'FROM events SELECT value WHERE NOT (loud = "click" OR user_id =~ /1$/) BY event_type EVERY 1d',
    "required": "FROM events SELECT value, b4 REQUIRED BY event_type EVERY 1d",
    "heatmap": "FROM events SELECT HISTOGRAM(amount) BY event_type EVERY 6h FORMAT heatmap",
    "heatmap_all": "FROM events SELECT HISTOGRAM(amount) EVERY 1d FORMAT heatmap",
    "table": "FROM events SELECT value, b3 BY event_type, loud FORMAT table LIMIT POINTS 200",
    "logs": "FROM events SELECT value BY event_type FORMAT logs LIMIT POINTS 300",
    "table_strings": "FROM orders SELECT total, status AS state BY priority FORMAT table LIMIT POINTS 150",
    "labels": "LABELS event_type",
    "labels_where": "LABELS user_id WHERE event_type = \"click\" AND MISSING loud",
    "sets": "SETS",
    "fields": "FIELDS FROM events",
    "label_keys": "LABEL KEYS FROM events",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: planner(spark, sf_dir).run(text, Request(0, LAST_MS)).rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(text) for name, text in TEXTS.items()}


# The same in SQL.

_EVENTS = (
    "ev AS (SELECT epoch_us(ts) // 1000 AS ts_ms, lpad(CAST(event_id AS VARCHAR), 12, '0') AS pk, event_type, CAST(user_id AS VARCHAR) AS user_id, value, CASE WHEN value > 50 THEN event_type END AS loud, "
    + ", ".join(f"CASE WHEN value >= {lo}" + (f" AND value < {hi}" if hi is not None else "") + f" THEN 1 END AS b{k}" for k, (lo, hi) in enumerate(zip(EDGES, [*EDGES[1:], None], strict=True)))
    + " FROM events)"
)
_ORDERS = "od AS (SELECT epoch_us(o_orderdate) // 1000 AS ts_ms, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS pk, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total FROM orders)"


def walk_sql(by: list[str], fields: dict[str, str], width: int, spec: Spec | None = None, where: str = "true", source: str = "ev", only: str = "true") -> str:
    """The render walk in SQL: windows by a recursive query, the rest by window functions. ``fields``: shown name to column."""
    s = spec or Spec(end_ms=LAST_MS)
    keys = [*by, "field"]
    k, same = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in keys)
    value = "raw - pr" if s.delta else "raw"
    if s.negate:
        value = f"-({value})"
    for bound, op in ((s.low, "<"), (s.high, ">")):
        if bound is not None:
            value = f"CASE WHEN ({value}) {op} {bound} THEN {'raw' if s.raw_escape else f'{bound}::DOUBLE'} ELSE ({value}) END"
    if s.per_second:
        value = f"({value}) / ((ts - pt) / 1000.0::DOUBLE)"
    gap = f"CASE WHEN ts - pt > {s.gap_ms} THEN ts - 1 END" if s.gap_ms else "CAST(NULL AS BIGINT)"
    taken = "pt IS NOT NULL" if s.delta or s.per_second else "true"
    over = f"OVER (PARTITION BY {k} ORDER BY ts)"
    points = " UNION ALL ".join(f"SELECT {', '.join([*by, ''])}'{n}' AS field, ts_ms AS ts, pk AS tie, CAST({c} AS DOUBLE) AS value FROM {source} WHERE ({where}) AND {c} IS NOT NULL" for n, c in fields.items())
    tail = f"UNION ALL SELECT {k}, lt + {s.gap_ms}, NULL, true FROM w WHERE newest = lt AND {s.end_ms} - lt > {s.gap_ms} AND lt + {s.gap_ms} > greatest(b, coalesce(late, b))" if s.gap_ms and s.end_ms else ""
    pad = "SELECT * FROM o"
    if s.padding != "off":
        alone = "NOT is_null AND coalesce(pn, true) AND coalesce(nn, true)"
        shown = "value" if s.padding == "repeat" else f"{s.padding_value}::DOUBLE"
        pad = f"""SELECT {k}, ts, value, is_null FROM oo
        UNION ALL SELECT {k}, l, {shown}, false FROM (SELECT *, greatest(ts - 500, coalesce(pts + 1, ts - 500)) AS l FROM oo WHERE {alone}) WHERE l < ts
        UNION ALL SELECT {k}, r, {shown}, false FROM (SELECT *, least(ts + 500, coalesce(nts - 1, ts + 500)) AS r FROM oo WHERE {alone}) WHERE r > ts"""
    legend = " || ' : ' || ".join([*[f"coalesce({b}, '{b}=')" for b in by], "field"])
    return f"""WITH RECURSIVE {_EVENTS if source == "ev" else _ORDERS},
    p0 AS ({points}), p AS (SELECT * FROM p0 WHERE {only}),
    d AS (SELECT {k}, ts, arg_min(value, tie) AS raw FROM p GROUP BY {k}, ts),
    g AS (SELECT *, lag(ts) {over} AS pt, lag(raw) {over} AS pr, max(ts) OVER (PARTITION BY {k}) AS lt FROM d),
    v AS (SELECT {k}, ts, lt, {value} AS val, {gap} AS gap FROM g WHERE {taken}),
    st AS (SELECT {k}, min(ts) AS wid FROM v GROUP BY {k} UNION ALL SELECT {", ".join("st." + x for x in keys)}, min(v.ts) FROM st JOIN v ON {same("st", "v")} AND v.ts > st.wid + {width} GROUP BY {", ".join("st." + x for x in keys)}, st.wid),
    a AS (SELECT v.*, max(st.wid) OVER (PARTITION BY {", ".join("v." + x for x in keys)} ORDER BY v.ts) AS wid FROM v LEFT JOIN st ON {same("v", "st")} AND v.ts = st.wid),
    m AS (SELECT *, ts = wid AND lag(wid) {over} IS NOT NULL AS moved FROM a),
    n AS (SELECT *, lead(CASE WHEN moved THEN gap END) {over} AS aft, CASE WHEN NOT moved THEN gap END AS own FROM m),
    x AS (SELECT {k}, wid, arg_min(ts, (val, ts)) AS lo_ts, min(val) AS lo, arg_max(ts, (val, -ts)) AS hi_ts, max(val) AS hi, max(aft) AS aft, max(lt) AS lt, max(ts) AS newest FROM n GROUP BY {k}, wid),
    y AS (SELECT *, least(lo_ts, hi_ts) AS a, greatest(lo_ts, hi_ts) AS b FROM x),
    z AS (SELECT {", ".join("n." + c for c in keys)}, n.wid, max(CASE WHEN own < a THEN own END) AS early, max(CASE WHEN own > a AND own < b THEN own END) AS mid, max(CASE WHEN own > b THEN own END) AS rest FROM n JOIN y ON {same("n", "y")} AND n.wid = y.wid GROUP BY {", ".join("n." + c for c in keys)}, n.wid),
    w AS (SELECT y.*, z.early, z.mid, CASE WHEN z.rest IS NULL THEN y.aft WHEN y.aft IS NULL THEN z.rest ELSE greatest(z.rest, y.aft) END AS late FROM y JOIN z ON {same("y", "z")} AND y.wid = z.wid),
    o AS (SELECT {k}, early AS ts, CAST(NULL AS DOUBLE) AS value, true AS is_null FROM w WHERE early IS NOT NULL
        UNION ALL SELECT {k}, a, CASE WHEN lo_ts < hi_ts THEN lo ELSE hi END, false FROM w
        UNION ALL SELECT {k}, mid, NULL, true FROM w WHERE mid IS NOT NULL
        UNION ALL SELECT {k}, b, CASE WHEN lo_ts > hi_ts THEN lo ELSE hi END, false FROM w WHERE lo_ts <> hi_ts
        UNION ALL SELECT {k}, late, NULL, true FROM w WHERE late IS NOT NULL {tail}),
    oo AS (SELECT *, lag(ts) {over} AS pts, lag(is_null) {over} AS pn, lead(ts) {over} AS nts, lead(is_null) {over} AS nn FROM o),
    f AS ({pad})
    SELECT {k}, {legend} AS series, ts, value, is_null FROM f"""


def _heatmap_sql(by: list[str], width: int) -> str:
    cells = " UNION ALL ".join(f"SELECT {', '.join([*by, ''])}{i} AS bucket_index, CAST({e} AS DOUBLE) AS edge, '{e:g}' AS shown, ts_ms - ts_ms % {width} AS ts, b{i} AS v FROM ev WHERE b{i} IS NOT NULL" for i, e in enumerate(EDGES))
    k = ", ".join([*by, "bucket_index", "edge", "shown", "ts"])
    legend = " || ' : ' || ".join([*[f"coalesce({b}, '{b}=')" for b in by], "shown"])
    return f"WITH {_EVENTS}, c AS ({cells}), s AS (SELECT {k}, CAST(sum(v) AS DOUBLE) AS value FROM c GROUP BY {k}) SELECT {', '.join([*by, ''])}CAST(bucket_index AS INTEGER) AS bucket_index, edge, {legend} AS series, ts, value FROM s"


def oracle_sql() -> dict[str, str]:
    s = lambda **k: Spec(**({"end_ms": LAST_MS} | k))
    t, v = ["event_type"], {"value": "value"}
    where = lambda by, condition: walk_sql(by, v, DAY, where=condition)
    first_five = "user_id IN (SELECT user_id FROM (SELECT user_id, min((ts, tie)) AS f FROM p0 GROUP BY user_id) ORDER BY f LIMIT 5)"
    return {
        "series_by_type": walk_sql(t, v, HOUR),
        "series_all": walk_sql([], v, 6 * HOUR, s(padding="off")),
        "series_zero_window": walk_sql([], v, 1, s(padding="off"), "user_id = '7'"),
        "series_delta": walk_sql(t, v, 2 * HOUR, s(delta=True)),
        "series_rate_gap": walk_sql(t, v, HOUR, s(delta=True, per_second=True, gap_ms=600_000)),
        "series_per_second": walk_sql(t, v, 3 * HOUR, s(per_second=True, gap_ms=1_800_000, padding="repeat")),
        "series_negate": walk_sql(["user_id"], v, DAY, s(negate=True, gap_ms=HOUR)),
        "series_clamp_bound": walk_sql(t, v, HOUR, s(low=10.0, high=60.0)),
        "series_clamp_raw": walk_sql(t, v, 1_800_000, s(delta=True, low=0.0, raw_escape=True, gap_ms=300_000, padding_value=1.5)),
        "series_isolated": walk_sql(["user_id"], v, 12 * HOUR, s(gap_ms=2 * HOUR)),
        "series_absent_label": walk_sql(["loud"], v, DAY),
        "series_two_fields": walk_sql(t, {"value": "value", "third": "b3"}, DAY),
        "series_interleaved": walk_sql(["status"], {"total": "total"}, 30 * DAY, source="od"),
        "series_limit": walk_sql(["user_id"], v, DAY, only=first_five),
        "where_equal": where(["user_id"], "event_type = 'click'"),
        "where_not_equal": where(t, "loud IS NOT NULL AND loud <> 'click'"),
        "where_in": where(t, "event_type IN ('click', 'view', 'nothing')"),
        "where_match": where(t, "regexp_matches(event_type, '^(c|v)')"),
        "where_no_match": where(t, "loud IS NOT NULL AND NOT regexp_matches(loud, 'i')"),
        "where_has": where(t, "loud IS NOT NULL AND b3 IS NOT NULL"),
        "where_missing": where(t, "loud IS NULL OR event_type = 'click'"),
        "where_not": where(t, "NOT (coalesce(loud = 'click', false) OR regexp_matches(user_id, '1$'))"),
        "required": walk_sql(t, {"value": "value", "b4": "b4"}, DAY, where="b4 IS NOT NULL"),
        "heatmap": _heatmap_sql(t, 6 * HOUR),
        "heatmap_all": _heatmap_sql([], DAY),
        "table": f"WITH {_EVENTS} SELECT ts_ms AS time, event_type, coalesce(loud, '') AS loud, value, CAST(b3 AS DOUBLE) AS b3 FROM ev WHERE value IS NOT NULL OR b3 IS NOT NULL ORDER BY ts_ms, pk LIMIT 200",
        "logs": f"WITH {_EVENTS} SELECT ts_ms AS time, event_type, value FROM ev WHERE value IS NOT NULL ORDER BY ts_ms DESC, pk DESC LIMIT 300",
        "table_strings": f"WITH {_ORDERS} SELECT ts_ms AS time, priority, total, status AS state FROM od ORDER BY ts_ms, pk LIMIT 150",
        "labels": "SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL",
        "labels_where": f"WITH {_EVENTS} SELECT DISTINCT user_id AS value FROM ev WHERE event_type = 'click' AND loud IS NULL",
        "sets": "SELECT * FROM (VALUES ('events'), ('orders')) AS t(name)",
        "fields": "SELECT field, 'gauge' AS kind, '' AS unit, CAST(0 AS BIGINT) AS max_interval_ms FROM (VALUES ('b0'), ('b1'), ('b2'), ('b3'), ('b4'), ('value')) AS t(field)",
        "label_keys": "SELECT * FROM (VALUES ('event_type'), ('loud'), ('user_id')) AS t(label)",
    }
