"""From lines to samples, in column expressions: one pass for a profile's patterns, windows for what needs order.

Lines are rows (stream, ord, line): ``ord`` orders the lines of a stream. Results are rows (stream, ord, set, ts_ms, sub_us,
labels, fields), and an outcome for lines that give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.functions.values import DECIMAL, coerced
from tidemark.plans.spec import EPOCHS, Buckets, Format, Pattern, Profile, Spec, java_layout, regex

VALUE = "struct<i:bigint,f:double,s:string,b:boolean>"
HALF_YEAR_US = 183 * 86_400_000_000
FAR_US = 253402300799999 * 1000
#: A year that has every day, in which dates without a year are read first.
LEAP = 2000


def capped(line: Column, most: int) -> Column:
    """A line cut to a number of bytes, without a torn last character."""
    cut = F.rtrim(F.decode(F.substring(F.encode(line, "utf-8"), 1, most), "utf-8"), F.lit("�"))
    return F.when(F.octet_length(line) > most, cut).otherwise(line)


def _micros(text: Column, f: Format, zone: str) -> Column:
    """Epoch microseconds of a matched text, in the year LEAP where it has none; null where it doesn't parse."""
    if f.layout in EPOCHS:
        n = F.when(text.rlike(r"^-?\d{1,18}$"), text.cast("long"))
        us = F.floor(n / 1000).cast("long") if f.layout == "epoch_ns" else n.try_cast("decimal(38,0)") * EPOCHS[f.layout]
        return F.when((us > 0) & (us <= FAR_US), us.cast("long"))
    pattern = java_layout(f.layout)
    if not f.has_year:
        text, pattern = F.concat(F.lit(f"{LEAP} "), text), f"yyyy {pattern}"
    # Blanks that pad a day of one digit are dropped on both sides.
    text = F.regexp_replace(text, r"\s+", " ")
    when = F.try_to_timestamp(text, F.lit(" ".join(pattern.split())))
    if f.has_zone:
        return F.unix_micros(when)
    wall = F.convert_timezone(F.lit(zone), F.lit("UTC"), when.cast("timestamp_ntz"))
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), wall)


def stamped(lines: DataFrame, spec: Spec, profile: Profile, year: int) -> DataFrame:
    """``lines`` with ``us``, and ``text``: the line without its timestamp if the profile strips it."""
    t = profile.timestamp
    us, text = F.lit(None).cast("long"), F.col("line")
    yearless = any(not f.has_year for f in t.formats)
    free = F.lit(False)
    for f in reversed(t.formats):
        pattern = regex("timestamp", f.regex)[0]
        pattern = f"^(?:{pattern})" if t.anchor == "prefix" else pattern
        found = F.regexp_extract(F.col("line"), pattern, 0)
        got = F.when(found != "", _micros(found, f, spec.timezone))
        at = F.position(found, F.col("line"))
        rest = F.concat(F.substr(F.col("line"), F.lit(1), at - 1), F.substr(F.col("line"), at + F.length(found))) if t.strip else F.col("line")
        us, text, free = F.when(got.isNotNull(), got).otherwise(us), F.when(got.isNotNull(), rest).otherwise(text), F.when(got.isNotNull(), F.lit(not f.has_year)).otherwise(free)
    d = lines.withColumn("us_", us).withColumn("text", text).withColumn("free_", free)
    if not yearless:
        return d.withColumnRenamed("us_", "us").drop("free_")
    # A step of more than half a year between neighbours is a change of year; their running sum is the year to add.
    over = Window.partitionBy("stream").orderBy("ord")
    before = F.last(F.when(F.col("free_"), F.col("us_")), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("us_") - before < -HALF_YEAR_US, 1).when(F.col("us_") - before > HALF_YEAR_US, -1).otherwise(0)
    d = d.withColumn("step_", F.when(F.col("free_"), step).otherwise(0)).withColumn("years_", F.sum("step_").over(over))
    moved = F.unix_micros(F.timestamp_micros("us_") + F.make_interval(F.col("years_") + F.lit(year - LEAP)))
    return d.withColumn("us", F.when(F.col("free_"), moved).otherwise(F.col("us_"))).drop("us_", "free_", "step_", "years_")


def joined(lines: DataFrame, profile: Profile) -> DataFrame:
    """Continuation lines appended to the record that they follow; lines are stamped already."""
    for m in profile.framing.multiline:
        start = F.col("line").contains(m.start_contains)
        rules = [regex("join", j.regex)[0] for j in m.join]
        # Nested, so that the first rule that matches decides.
        piece = reduce(lambda rest, r: F.when(F.col("line").rlike(r[0]), F.regexp_extract(F.col("line"), r[0], r[1])).otherwise(rest), list(zip(rules, [j.capture for j in m.join], strict=True))[::-1], F.lit(None).cast("string"))
        more = ~start & F.col("line").rlike(regex("multiline", m.continue_regex)[0])
        over = Window.partitionBy("stream").orderBy("ord")
        d = lines.withColumn("start_", start).withColumn("more_", more).withColumn("piece_", F.when(more, piece))
        d = d.withColumn("record_", F.sum(F.when(F.col("start_"), 1).otherwise(0)).over(over))
        part = d.where((F.col("start_") | F.col("more_")) & (F.col("record_") > 0))
        first = lambda c: F.min_by(c, "ord").alias(c)
        keep = [c for c in lines.columns if c not in ("stream", "ord", "text")]
        pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece_"))), lambda x: x["piece_"]), "")
        records = part.groupBy("stream", "record_").agg(*[first(c) for c in keep], F.min("ord").alias("ord"), F.concat(F.min_by("text", "ord"), pieces).alias("text"))
        others = d.where(~F.col("start_") & ~F.col("more_"))
        lines = others.select(*lines.columns).unionByName(records.select(*lines.columns))
    return lines


def _captures(text: Column, p: Pattern) -> Column:
    """struct<set, captures>: of the first branch that matches; null where none does."""
    for r in p.replace:
        text = F.regexp_replace(text, *r.java())
    out = F.lit(None).cast("struct<set:string,captures:map<string,string>>")
    for target, pattern, names in reversed(p.branches):
        got = F.create_map(*[x for n, g in names.items() for x in (F.lit(n), F.regexp_extract(text, pattern, g))]) if names else F.create_map().cast("map<string,string>")
        out = F.when(text.rlike(pattern), F.struct(F.lit(target).alias("set"), F.map_filter(got, lambda _, v: v != "").alias("captures"))).otherwise(out)
    return out


def histogram(payload: Column, b: Buckets) -> Column:
    """map<string, bigint or double as text>: the declared buckets of a payload."""
    declared = F.array(*map(F.lit, b.buckets))
    if b.parse == "csv":
        got = F.map_from_arrays(F.slice(declared, 1, F.least(F.lit(len(b.buckets)), F.size(F.split(payload, ",")))), F.slice(F.transform(F.split(payload, ","), F.trim), 1, len(b.buckets)))
    elif b.parse == "json_object":
        got = F.from_json(payload, "map<string,string>")
    else:
        pattern = r"\(\s*([^():\s]+)\s*:\s*([^()\s]+)\s*\)" if b.parse == "paren_pairs" else r"([^\s:=]+)[:=](\S+)"
        keys, values = (F.regexp_extract_all(payload, F.lit(pattern), k) for k in (1, 2))
        # The last of a bucket's pairs counts, as in a map.
        pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
        last = F.transform(declared, lambda b: F.struct(b.alias("key"), F.try_element_at(F.filter(pairs, lambda x: x["k"] == b), F.lit(-1))["v"].alias("value")))
        got = F.map_from_entries(F.filter(last, lambda x: x["value"].isNotNull()))
    return F.map_filter(got, lambda k, v: F.array_contains(declared, k) & v.rlike(DECIMAL))


def _bucket_fields(fields: Column, found: Column, b: Buckets) -> Column:
    """Bucket fields added to a record's: with the tail and the cumulative ones where all buckets are there."""
    values = F.transform_values(found, lambda _, v: coerced(v))
    out = [values]
    if b.cumulative or b.tail:
        number = lambda k: F.element_at(found, k).try_cast("double")
        total = F.coalesce(F.element_at(fields, b.total_field)["i"].cast("double"), F.element_at(fields, b.total_field)["f"]) if b.total_field else F.lit(None).cast("double")
        all_there = F.size(found) == len(b.buckets)
        sums = reduce(lambda a, c: a + c, [number(k) for k in b.buckets])
        tail = F.greatest(F.coalesce(total, sums) - sums, F.lit(0.0))
        plain = lambda v: F.struct(F.when(v == F.floor(v), v.cast("long")).alias("i"), F.when(v != F.floor(v), v).alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("boolean").alias("b"))
        entries = [F.lit("tail"), plain(tail)] if b.tail else []
        if b.cumulative:
            for k, name in enumerate(b.buckets):
                entries += [F.lit(f"{name}plus"), plain(reduce(lambda a, c: a + c, [number(x) for x in b.buckets[k:]]) + tail)]
        extra = F.create_map(*entries)
        out.append(F.when(all_there, extra).otherwise(F.create_map().cast(f"map<string,{VALUE}>")))
    return F.map_concat(*out)


def extracted(lines: DataFrame, spec: Spec, profile: Profile, year: int = 1970, span: tuple[int, int] | None = None) -> DataFrame:
    """(stream, ord, set, ts_ms, sub_us, labels, fields, pattern, outcome) of every record.

    outcome: sample, aggregate (to be windowed), no timestamp, outside (of ``span``, milliseconds with both ends), unmatched,
    no fields. ``lines`` may have ``labels``.
    """
    d = lines.withColumn("line", capped(F.regexp_replace("line", r"\r\z", ""), profile.framing.max_record_bytes))
    d = joined(stamped(d, spec, profile, year), profile)
    pattern = F.coalesce(*[F.when(F.col("text").contains(p.search) if p.search else F.lit(True), k) for k, p in enumerate(profile.patterns)], F.lit(None).cast("int"))
    d = d.withColumn("pattern", pattern)
    by = lambda make, none: reduce(lambda rest, kp: F.when(F.col("pattern") == kp[0], make(kp[1])).otherwise(rest), list(enumerate(profile.patterns))[::-1], none)
    d = d.withColumn("hit", by(lambda p: _captures(F.col("text"), p), F.lit(None).cast("struct<set:string,captures:map<string,string>>")))
    captures = F.col("hit.captures")
    defaults = by(lambda p: F.create_map(*[F.lit(str(x)) for kv in p.default_values.items() for x in kv]).cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    d = d.withColumn("all_", F.map_concat(captures, F.map_filter(defaults, lambda k, _: F.element_at(captures, k).isNull())))
    names = by(lambda p: F.array(*map(F.lit, dict.fromkeys([*spec.labels, *profile.labels, *p.labels]))).cast("array<string>"), F.array().cast("array<string>"))
    own = F.map_filter("all_", lambda k, _: F.array_contains(names, k))
    if "labels" in lines.columns:  # what a line says goes before what is known of its stream
        own = F.map_concat(F.map_filter("labels", lambda k, _: F.element_at(own, k).isNull()), own)
    is_payload = lambda k: k.isin("buckets", "histogram")
    plain = F.transform_values(F.map_filter("all_", lambda k, _: ~F.array_contains(names, k) & ~is_payload(k)), lambda _, v: coerced(v))
    d = d.withColumn("plain_", plain)
    payload = F.coalesce(F.element_at("all_", "buckets"), F.element_at("all_", "histogram"), F.lit(""))
    none = F.create_map().cast(f"map<string,{VALUE}>")
    if profile.bucket_sets:
        # A column of its own: everything that is made of it would else parse the payload again.
        empty = F.create_map().cast("map<string,string>")
        d = d.withColumn("found_", by(lambda p: histogram(payload, profile.by_name[p.bucket_set]) if p.bucket_set else empty, empty))
    extra = by(lambda p: _bucket_fields(F.col("plain_"), F.col("found_"), profile.by_name[p.bucket_set]) if p.bucket_set else none, none)
    d = d.withColumn("fields_", F.map_concat("plain_", extra))
    windowed = F.coalesce(F.col("pattern").isin([k for k, p in enumerate(profile.patterns) if p.aggregate]) if any(p.aggregate for p in profile.patterns) else F.lit(False), F.lit(False))
    outside = ~F.floor(F.col("us") / 1000).between(*span) if span else F.lit(False)
    outcome = F.when(F.col("us").isNull(), "no timestamp").when(outside, "outside").when(F.col("hit").isNull(), "unmatched").when(windowed, "aggregate").when(F.size("fields_") == 0, "no fields").otherwise("sample")
    return d.select("stream", "ord", F.col("hit.set").alias("set"), F.floor(F.col("us") / 1000).cast("long").alias("ts_ms"), F.pmod("us", F.lit(1000)).cast("int").alias("sub_us"), own.alias("labels"), F.col("fields_").alias("fields"), "pattern", outcome.alias("outcome"))


OPEN = 100_000
#: A window: what it has counted, and the labels and place of the record that opened it.
WINDOW = "stream string, set string, pattern int, on_ array<string>, start long, n long, total double, most double, newest double, labels map<string,string>"


def folded(records: DataFrame, profile: Profile, opened: DataFrame | None = None, final: bool = True, most: int = OPEN) -> DataFrame:
    """Windows of aggregating patterns, rows of WINDOW with ``ord`` and ``closed``.

    A window of a key opens at a record and holds every record of the key until one of its stream, of any key or pattern, is
    not earlier than its end; a late record counts in the window that is open. Streams are gone through in their order, with
    the open windows as all that is kept: at most ``most`` a stream, beyond which the first to end goes early. ``opened``:
    windows that an earlier call left open; ``final``: closes the rest.
    """
    rules = {k: (p.aggregate.every_ms, p.aggregate.mode) for k, p in enumerate(profile.patterns) if p.aggregate}
    text = lambda v: F.coalesce(v["i"].cast("string"), v["f"].cast("string"), v["s"])
    on, value = F.lit(None).cast("array<string>"), F.lit(None).cast("double")
    for k in rules:
        a = profile.patterns[k].aggregate
        names = F.array(*[F.coalesce(F.element_at("labels", n), text(F.element_at("fields", n))) for n in a.on]).cast("array<string>")
        cell = F.element_at("fields", a.field)
        on, value = F.when(F.col("pattern") == k, names).otherwise(on), F.when(F.col("pattern") == k, F.coalesce(cell["i"].cast("double"), cell["f"])).otherwise(value)
    own = F.when((F.col("outcome") == "aggregate") & ~F.exists(on, lambda x: x.isNull()), on)
    nothing = {c: F.lit(None).cast("long" if c in ("start", "n") else "double").alias(c) for c in ("start", "n", "total", "most", "newest")}
    rows = records.where(F.col("outcome").isin("aggregate", "sample")).select("stream", "set", F.col("pattern").cast("int").alias("pattern"), own.alias("on_"), *[nothing[c] for c in ("start", "n")], value.alias("total"), *[nothing[c] for c in ("most", "newest")], "labels", "ord", "ts_ms")
    if opened is not None:
        rows = rows.unionByName(opened.drop("closed").withColumn("ts_ms", F.lit(None).cast("long")))
    columns = [c for c in rows.columns if c != "ts_ms"]
    schema = StructType([*[rows.schema[c] for c in columns], StructField("closed", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, windows, out, kinds = None, {}, [], None

        def send() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([*kinds, pa.bool_()])], names=[*columns, "closed"])
            out.clear()
            return got

        for b in batches:
            kinds = [b.schema.field(c).type for c in columns]
            for *row, ts in zip(*(b.column(c).to_pylist() for c in [*columns, "ts_ms"]), strict=True):
                if row[0] != stream:
                    out += [(*w, final) for w in windows.values()]
                    stream, windows = row[0], {}
                if ts is None:  # left open before
                    windows[(row[1], row[2], *row[3])] = row
                    continue
                # Every window that has ended goes, in the order of the ends.
                for key in sorted((k for k, w in windows.items() if ts >= w[4] + rules[w[2]][0]), key=lambda k: (windows[k][4] + rules[windows[k][2]][0], str(k))):
                    out.append((*windows.pop(key), True))
                if row[3] is None:
                    continue
                key, v = (row[1], row[2], *row[3]), row[6]
                if key not in windows:
                    windows[key] = [*row[:4], ts, 0, 0.0, None, None, *row[9:]]
                    if len(windows) > most:
                        out.append((*windows.pop(min((k for k in windows if k != key), key=lambda k: (windows[k][4] + rules[windows[k][2]][0], str(k)))), True))
                w = windows[key]
                w[5] += 1
                if v is not None:
                    w[6], w[7], w[8] = w[6] + v, v if w[7] is None else max(w[7], v), v
            if len(out) > 10_000:
                yield send()
        out += [(*w, final) for w in windows.values()]
        if out:
            yield send()

    # Windows that were open come before the records of their stream.
    dealt = rows.repartition("stream").sortWithinPartitions("stream", F.col("ts_ms").isNotNull(), "ord")
    return dealt.mapInArrow(run, schema)


def window_samples(windows: DataFrame, profile: Profile) -> DataFrame:
    """(stream, ord, set, ts_ms, sub_us, labels, fields) of windows; one of max or last without a reading gives none."""
    value, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, p in enumerate(profile.patterns):
        if p.aggregate:
            made = F.col({"increment": "n", "sum": "total", "max": "most", "last": "newest"}[p.aggregate.mode]).cast("double")
            value, name = F.when(F.col("pattern") == k, made).otherwise(value), F.when(F.col("pattern") == k, p.aggregate.field).otherwise(name)
    w = windows.withColumn("v", value).withColumn("name_", name).where("v is not null")
    whole = (F.col("v") == F.floor("v")) & (F.abs("v") <= 2.0**53)
    cell = F.struct(F.when(whole, F.col("v").cast("long")).alias("i"), F.when(~whole, F.col("v")).alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("boolean").alias("b"))
    return w.select("stream", "ord", "set", F.col("start").alias("ts_ms"), F.lit(0).alias("sub_us"), "labels", F.create_map("name_", cell).alias("fields"))


def plain_samples(records: DataFrame) -> DataFrame:
    return records.where(F.col("outcome") == "sample").select("stream", "ord", "set", "ts_ms", "sub_us", "labels", "fields")


def aggregated(records: DataFrame, profile: Profile) -> DataFrame:
    """All samples of a batch of records: the plain ones, and those of windows, the last ones closed too."""
    plain = plain_samples(records)
    return plain.unionByName(window_samples(folded(records, profile), profile)) if any(p.aggregate for p in profile.patterns) else plain


def report(records: DataFrame) -> DataFrame:
    """How many records ended how, by pattern."""
    return records.groupBy("pattern", "outcome").count()
