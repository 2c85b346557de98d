import pytest

from tidemark.operators.extract import aggregated, extracted, folded, report
from tidemark.sources.checkpoints import checkpointed
from tidemark.plans.spec import BadSpec, java_layout, lint, load_spec, parse_spec, read_yaml
from tidemark.sources.lineprotocol import BadLine, parse, samples

SPEC = r"""
version: 1
defaults: {timestamp: {timezone: UTC, assume_year: "2031"}}
identity: [{match_path: '/(?P<quay>q\d+)/crane[^/]*$'}]
profiles:
  - name: cranes
    select: {path_glob: ['*/crane*']}
    timestamp:
      formats: [{layout: '02.01.2006 15:04:05', regex: '\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d'}, {layout: epoch_s, regex: '@\d+'}, {layout: epoch_us, regex: '\d{16}'}]
      anchor: prefix
      strip: true
    framing: {multiline: [{start_contains: 'manifest', continue_regex: '^ +box ', join: [{regex: 'box (\w)', capture: 1}]}]}
    labels: [arm, fault, berth]
    fields: {lifts: {kind: counter, max_interval: 45s}, load_kg: {kind: gauge}, stops: {kind: delta}}
    patterns:
      - {set: lifting, search: 'arm ', extract: ['arm (?P<arm>\d+) lifts=(?P<lifts>\d+) load=(?P<load_kg>[\d.]+)kg']}
      - {set: halted, search: 'halt:', extract: ['halt: (?P<fault>\w+)'], aggregate: {every: 1m, on: [fault], field: stops, mode: increment}}
      - {set: waits, search: 'waited', bucket_set: minutes, extract: ['waited at (?P<berth>\S+) of (?P<ships>\d+): (?P<buckets>.*)']}
      - {set: manifests, search: 'manifest', extract: ['manifest (?P<boxes>\w+)']}
      - {search: 'wind', route: [{regex: 'wind (?P<speed>\d+) knots', set: wind_kn}, {regex: 'wind (?P<speed>\d+) m/s', set: wind_ms}]}
    bucket_sets: [{name: minutes, buckets: [short, fair, long], edges: 'linear: 20', parse: key_value, total_field: ships, cumulative: true, tail: true}]
"""
LINES = [
    "03.05.2031 06:00:00 arm 4 lifts=120 load=8200.5kg", "fog over the quay", "03.05.2031 06:00:30 fog over the quay", "03.05.2031 06:01:00 halt: brake", "03.05.2031 06:01:20 halt: brake", "03.05.2031 06:01:59 halt: rope",
    "03.05.2031 06:02:00 halt: brake", "1935727500000000 waited at B7 of 30: short=12 fair:9 odd=1 long=4", "03.05.2031 06:10:00 manifest x", "   box a", "   box c", "03.05.2031 06:11:00 wind 12 m/s",
]


def test_lines_become_samples(spark):
    spec = parse_spec(SPEC)
    profile = spec.profile("logs/q3/crane-1")
    assert spec.stream_labels("logs/q3/crane-1", []) == {"quay": "q3"} and spec.profile("logs/q3/tide") is None
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(LINES)], "stream string, ord long, line string")
    records = checkpointed(extracted(d, spec, profile))
    rows = aggregated(records, profile).collect()
    got = {r.set: r for r in rows if r.set != "halted"}
    plain = {k: {n: v.i if v.i is not None else v.f if v.f is not None else v.s for n, v in r.fields.items()} for k, r in got.items()}
    assert plain["lifting"] == {"lifts": 120, "load_kg": 8200.5} and got["lifting"].labels == {"arm": "4"} and got["lifting"].ts_ms == 1_935_554_400_000
    assert plain["waits"] == {"ships": 30, "short": 12, "fair": 9, "long": 4, "tail": 5, "longplus": 9, "fairplus": 18, "shortplus": 30} and got["waits"].labels == {"berth": "B7"}
    assert plain["manifests"] == {"boxes": "xac"}
    assert plain["wind_ms"] == {"speed": 12} and "wind_kn" not in plain
    # The brake's window ends at 06:02:00, where the next one opens; the rope's is closed by the record of 06:10.
    assert sorted((r.labels["fault"], r.ts_ms - 1_935_554_400_000, r.fields["stops"].i) for r in rows if r.set == "halted") == [("brake", 60_000, 2), ("brake", 120_000, 1), ("rope", 119_000, 1)]
    assert {r.outcome: r["count"] for r in report(records).where("pattern is null").collect()} == {"no timestamp": 1, "unmatched": 1}


def test_windows_in_record_order(spark):
    spec = parse_spec(SPEC)
    profile = spec.profiles[0]
    said = ["06:00:00 halt: brake", "06:00:50 halt: brake", "05:59:00 halt: brake", "06:01:00 arm 1 lifts=1 load=1kg", "06:00:30 halt: brake", "06:09:00 halt: rope"]
    d = spark.createDataFrame([("f", i, f"03.05.2031 {x}") for i, x in enumerate(said)], "stream string, ord long, line string")
    records = checkpointed(extracted(d, spec, profile))  # as ingest does: each use would else extract again
    whole = sorted((r.ts_ms - 1_935_554_400_000, r.fields["stops"].i) for r in aggregated(records, profile).where("set = 'halted'").collect())
    # A late record counts in the open window; any record of the stream closes what has ended; then a late one opens a window.
    assert whole == [(0, 3), (30_000, 1), (540_000, 1)]
    # The same in two calls, the first of which leaves a window open.
    first = folded(records.where("ord < 2"), profile, final=False)
    assert [r.closed for r in first.collect()] == [False]
    then = folded(records.where("ord >= 2"), profile, first)
    assert sorted((r.start - 1_935_554_400_000, r.n) for r in then.collect()) == whole
    assert sorted((r.start - 1_935_554_400_000, r.n) for r in folded(records, profile, most=1).collect()) == whole


def test_years_wrap(spark):
    spec = parse_spec({"version": 1, "defaults": {"timestamp": {"assume_year": "2024"}}, "profiles": [{"name": "y", "timestamp": {"formats": [{"layout": "Jan _2 15:04:05", "regex": r"^\w{3} [ \d]\d \d\d:\d\d:\d\d"}]}, "patterns": [{"set": "y", "extract": [r"n=(?P<n>\d+)"]}]}]})
    d = spark.createDataFrame([("f", 0, "Dec 31 23:59:59 n=1"), ("f", 1, "Jan  1 00:00:01 n=2")], "stream string, ord long, line string")
    assert [r.ts_ms for r in extracted(d, spec, spec.profiles[0], 2024).orderBy("ord").collect()] == [1_735_689_599_000, 1_735_689_601_000]


def test_specs_are_strict(tmp_path):
    d = read_yaml(SPEC)
    for change in ({"version": 2}, {"typo": 1}, {"profiles": [d["profiles"][0] | {"bucket_sets": []}]}, {"route_allow": ["x"]}):
        with pytest.raises(BadSpec):
            parse_spec(d | change)
    patterns = d["profiles"][0]["patterns"]
    with pytest.raises(BadSpec, match="L001"):
        parse_spec(d | {"profiles": [d["profiles"][0] | {"patterns": [{"set": "all", "extract": ["(?P<z>.)"]}, *patterns]}]})
    assert {x.code for x in lint(parse_spec(d))} >= {"L002"}
    (tmp_path / "a.yaml").write_text("version: 1\ninclude: [b.yaml]\n")
    (tmp_path / "b.yaml").write_text(SPEC)
    assert [p.name for p in load_spec(str(tmp_path / "a.yaml")).profiles] == ["cranes"]
    (tmp_path / "b.yaml").write_text("version: 1\ninclude: [a.yaml]\n")
    with pytest.raises(BadSpec, match="cycle"):
        load_spec(str(tmp_path / "a.yaml"))
    assert java_layout("Jan _2 15:04:05.000 Z07:00") == "MMM d HH:mm:ss.SSS XXX" and java_layout("2006-01-02T15:04:05") == "yyyy-MM-dd'T'HH:mm:ss"


def test_line_protocol(spark):
    s = parse('tide gauge=north,sea=baltic cm=412,rate=0.25,note="high, rising" 1893456000000')
    assert s == {"set": "tide", "ts_ms": 1_893_456_000_000, "labels": {"gauge": "north", "sea": "baltic"}, "fields": {"cm": 412, "rate": 0.25, "note": "high, rising"}}
    assert parse("tide - cm=3", 5)["labels"] == {"ts_source": "receiver"} and parse(r"tide place=a\ b\,c\=d cm=1 1")["labels"] == {"place": "a b,c=d"}
    bad = ["tide", "tide gauge=n", "tide gauge= cm=1 1", "tide - cm=1 1 more", "_ingest - cm=1 1", 'tide - note="open 1', "tide cm=1 cm=2 1", "tide - cm=inf 1"]
    for line in bad:
        with pytest.raises(BadLine):
            parse(line, 1)
    df = samples(spark.createDataFrame([("tide g=a cm=3,rate=0.5 7",), ("ebb",)], "value string"))
    rows = sorted(df.collect(), key=lambda r: r.set or "")
    assert rows[0].reason and rows[1].fields["cm"].i == 3 and rows[1].fields["rate"].f == 0.5
