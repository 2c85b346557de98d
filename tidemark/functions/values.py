"""Scalar values: reading texts as numbers, numbers as texts, and keys of samples."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TS = 253402300799999
#: Texts that read as numbers; anything else stays a text (fixed values).
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
LABEL = r"^[A-Za-z_][A-Za-z0-9_.\-]{0,127}$"
FIELD = r"^[A-Za-z0-9_][A-Za-z0-9_.\-]{0,127}$"


def finite(c: Column) -> Column:
    """A double, or null where it is no number or not finite."""
    return F.when(~F.isnan(c) & (F.abs(c) <= 1.7976931348623157e308), c)


def as_double(c: Column, kind: str) -> Column:
    """A value of any kind as a finite double: texts where they read as numbers, booleans as 0 and 1."""
    if kind == "string":
        c = F.when(c.rlike(DECIMAL), c.try_cast("double"))
    return finite(c.cast("double"))


def coerced(text: Column) -> Column:
    """struct<i, f, s>: an integer if the text is one, else a double, else the text itself."""
    i = F.when(text.rlike(INTEGER), text.try_cast("long"))
    f = F.when(i.isNull() & text.rlike(DECIMAL), text.try_cast("double"))
    f = F.when(i.isNull() & text.rlike(SPECIAL), F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(f)
    return F.struct(i.alias("i"), f.alias("f"), F.when(i.isNull() & f.isNull(), text).alias("s"), F.lit(None).cast("boolean").alias("b"))


def coerce(text: str) -> int | float | str:
    """coerced() for a single text on the driver."""
    if re.match(INTEGER, text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if re.match(DECIMAL, text) or re.match(SPECIAL, text):
        return float(text)
    return text


def shortest(x: float) -> str:
    """A double in its shortest form: plain digits from 1e-4 up to 1e6, else with an exponent of two digits at least."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    from decimal import Decimal

    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d = "".join(map(str, digits))
    point = len(d) + exponent
    if -4 < point <= 6:
        body = d + "0" * (point - len(d)) if point >= len(d) else f"{d[:point]}.{d[point:]}" if point > 0 else "0." + "0" * -point + d
    else:
        e = point - 1
        body = d[0] + ("." + d[1:]) * (len(d) > 1) + f"e{'-' if e < 0 else '+'}{abs(e):02d}"
    return "-" * sign + body


def sample_key(source: Column, ts: Column, sub_us: Column, labels: Column, fields: Column, hint: Column) -> Column:
    """A sample's key: a digest of its set, instant, sorted labels, and sorted typed fields or the hint in their place."""
    part = lambda c: F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    entries = lambda m, show: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(part(e["key"]), part(show(e["value"])))), "")
    typed = lambda v: F.when(v["i"].isNotNull(), F.concat(F.lit("i"), v["i"].cast("string"))).when(v["f"].isNotNull(), F.concat(F.lit("f"), v["f"].cast("string"))).when(v["s"].isNotNull(), F.concat(F.lit("s"), v["s"])).otherwise(F.concat(F.lit("b"), v["b"].cast("string")))
    # Maps don't sort, but their keys do; values are looked up by key.
    shown_fields = F.array_join(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(part(k), part(typed(F.element_at(fields, k))))), "")
    shown_labels = entries(labels, lambda v: v)
    what = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("h"), part(hint))).otherwise(F.concat(F.lit("f"), shown_fields))
    return F.md5(F.concat(part(source), part(ts.cast("string")), F.when(sub_us != 0, part(sub_us.cast("string"))).otherwise(F.lit("")), shown_labels, what))
