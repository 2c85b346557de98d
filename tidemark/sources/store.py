"""Sets of samples as parquet, one folder a set and shard of time (a day, unless set otherwise), and their catalogue.

A write checks every sample, names why it refuses one, and commits the rest: samples with a key that is there already are
replaced, the shards they fall in are rewritten. Labels and fields are columns of their own, so that filters reach the files. A
numeric field is a double; texts of a field that also holds numbers go to a column beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import FIELD, LABEL, MAX_TS, sample_key
from tidemark.plans.catalogue import Catalogue, SetInfo
from tidemark.plans.planner import Planner

DAY_MS = 86_400_000
#: New entries beyond these are refused.
MAX_VALUES, MAX_LABELS, MAX_SETS, MAX_FIELDS = 100_000, 1000, 10_000, 10_000
TEXT = "__text"


@dataclass
class Written:
    accepted: int
    refused: DataFrame


def reasons(samples: DataFrame) -> Column:
    """Why a sample is refused; null for a good one."""
    bad_label = F.exists(F.map_keys("labels"), lambda k: ~k.rlike(LABEL))
    bad_value = F.exists(F.map_values("labels"), lambda v: v.isNull() | (v == "") | (F.octet_length(v) > 1024))
    bad_field = F.exists(F.map_keys("fields"), lambda k: ~k.rlike(FIELD) | (k == "timestamp"))
    filled = lambda v: v["i"].isNotNull().cast("int") + v["f"].isNotNull().cast("int") + v["s"].isNotNull().cast("int") + v["b"].isNotNull().cast("int")
    untyped = F.exists(F.map_values("fields"), lambda v: filled(v) != 1)
    odd = F.exists(F.map_values("fields"), lambda v: F.coalesce(F.isnan(v["f"]) | (F.abs(v["f"]) == float("inf")), F.lit(False)))
    both = F.arrays_overlap(F.map_keys("labels"), F.map_keys("fields"))
    return (
        F.when(F.col("ts_ms").isNull() | ~F.col("ts_ms").between(1, MAX_TS), "time out of range")
        .when(F.coalesce(F.col("sub_us"), F.lit(0)).between(0, 999) == F.lit(False), "microseconds out of range")
        .when(F.coalesce(F.size("fields"), F.lit(0)) < 1, "no fields")
        .when(bad_label, "bad label name").when(bad_value, "bad label value").when(bad_field, "bad field name")
        .when(untyped, "a field needs exactly one value").when(odd, "a value isn't finite").when(both, "a name is label and field")
    )


class Store:
    """Sets under one folder, which must be one that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalogue = self._load()

    # Files by Hadoop's interface, so that any store Spark reads will do.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _load(self) -> Catalogue:
        if not (numbers := self._catalogues()):
            return Catalogue()
        return Catalogue.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/catalogue/{numbers[-1]:08d}.json", wholetext=True).collect()))

    def _catalogues(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/catalogue")
        return sorted(int(s.getPath().getName()[:8]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def save(self) -> None:
        """The catalogue as the next numbered file, which appears by a rename; only then the older ones go."""
        numbers = self._catalogues()
        n = numbers[-1] + 1 if numbers else 0
        fs, p = self._fs(f"{self.root}/catalogue/{n:08d}.json")
        _, beside = self._fs(f"{self.root}/catalogue/{n:08d}.new")
        out = fs.create(beside, True)
        out.write(bytearray(self.catalogue.dumps().encode()))
        out.close()
        if not fs.rename(beside, p):
            raise OSError(f"the catalogue {n} can't be put in place")
        for old in numbers:
            fs.delete(self._fs(f"{self.root}/catalogue/{old:08d}.json")[1], False)

    def path(self, source: str) -> str:
        return f"{self.root}/sets/{source}"

    def width(self, source: str) -> int:
        """Milliseconds of a shard of a set: hours that divide a day, or days."""
        info = self.catalogue.known.get(source)
        return info.shard_ms if info else DAY_MS

    def set_width(self, source: str, shard_ms: int) -> None:
        """The width of a new set's shards; that of a set with rows stays."""
        if shard_ms % DAY_MS and shard_ms not in [h * DAY_MS // 24 for h in (1, 2, 3, 4, 6, 8, 12)]:
            raise ValueError("a shard has 1, 2, 3, 4, 6, 8 or 12 hours, or days")
        if self.shards(source) and self.width(source) != shard_ms:
            raise ValueError(f"{source!r} has shards of another width")
        self.catalogue.known.setdefault(source, SetInfo()).shard_ms = shard_ms
        self.save()

    def shards(self, source: str) -> list[int]:
        fs, p = self._fs(self.path(source))
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[6:]) for n in names if n.startswith("shard="))

    def write(self, source: str, samples: DataFrame) -> Written:
        """``samples``: ts_ms, sub_us, labels, fields, and maybe key_hint."""
        if source not in self.catalogue.known and len(self.catalogue.known) >= MAX_SETS:
            raise ValueError(f"there are {MAX_SETS} sets already")
        hint = F.col("key_hint") if "key_hint" in samples.columns else F.lit(None).cast("string")
        d = samples.select("ts_ms", F.coalesce("sub_us", F.lit(0)).alias("sub_us"), F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), "fields", hint.alias("key_hint"))
        d = d.withColumn("reason", reasons(d))
        good = d.where("reason is null")
        # One pass over the names: as many rows as the set has columns.
        role = F.concat(
            F.transform(F.map_keys("labels"), lambda k: F.struct(F.lit("label").alias("role"), k.alias("name"), F.lit("string").alias("type"))),
            F.transform(F.map_entries("fields"), lambda e: F.struct(F.lit("field").alias("role"), e["key"].alias("name"), F.when(e["value"]["i"].isNotNull(), "long").when(e["value"]["f"].isNotNull(), "double").when(e["value"]["s"].isNotNull(), "string").otherwise("boolean").alias("type"))),
        )
        names = good.select("ts_ms", F.explode(role).alias("x")).groupBy("x.role", "x.name", "x.type").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count("*").alias("n")).collect()
        labels, types = sorted({r.name for r in names if r.role == "label"}), {}
        order = ("boolean", "long", "double", "string")
        for r in names:
            if r.role == "field":
                types[r.name] = max(r.type, types.get(r.name, r.type), key=order.index)
        info = self.catalogue.known.get(source, SetInfo())
        # Only samples with a new name for which there is no room are refused.
        beyond = lambda new, known, most: set([n for n in sorted(new) if n not in known][max(0, most - len(known)) :])
        too_many = beyond(labels, info.labels, MAX_LABELS) | beyond(types, info.types, MAX_FIELDS)
        if too_many:
            named = F.array(*map(F.lit, sorted(too_many))).cast("array<string>")
            d = d.withColumn("reason", F.coalesce("reason", F.when(F.arrays_overlap(F.map_keys("labels"), named) | F.arrays_overlap(F.map_keys("fields"), named), "too many labels or fields")))
            good = d.where("reason is null")
            labels, types = [x for x in labels if x not in too_many], {k: v for k, v in types.items() if k not in too_many}
        # What the set knows a name as stays; of new names that come as both, the field does.
        not_labels = {n for n in labels if n in info.types or (n in types and n not in info.labels)}
        not_fields = {n for n in types if n in info.labels}
        if not_labels or not_fields:
            some = lambda m, names_: F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, sorted(names_))).cast("array<string>"))
            d = d.withColumn("reason", F.coalesce("reason", F.when(some("labels", not_labels) | some("fields", not_fields), "a name is label and field of the set")))
            good = d.where("reason is null")
            labels, types = [x for x in labels if x not in not_labels], {k: v for k, v in types.items() if k not in not_fields}
        key = sample_key(F.lit(source), F.col("ts_ms"), F.col("sub_us"), F.col("labels"), F.col("fields"), F.col("key_hint"))
        number = lambda v: F.coalesce(v["i"].cast("double"), v["f"], v["b"].cast("int").cast("double"))
        columns = [F.element_at("labels", n).alias(n) for n in labels]
        for n, t in types.items():
            cell = F.element_at("fields", n)
            columns.append(number(cell).alias(n))
            if t == "string":
                columns.append(cell["s"].alias(n + TEXT))
        wide = good.select("ts_ms", "sub_us", key.alias("pk"), *columns, (F.floor(F.col("ts_ms") / self.width(source)) * self.width(source)).cast("long").alias("shard")).dropDuplicates(["shard", "pk"])
        from tidemark.sources.checkpoints import checkpointed

        wide = checkpointed(wide)
        touched = [r.shard for r in wide.select("shard").distinct().collect()]
        accepted = wide.count()
        if touched:
            there = sorted(set(self.shards(source)) & set(touched))
            if there:
                old = self.spark.read.option("mergeSchema", "true").parquet(self.path(source)).where(F.col("shard").isin(there))
                kept = old.join(wide.select("shard", "pk"), ["shard", "pk"], "left_anti")
                wide = checkpointed(kept.unionByName(wide, allowMissingColumns=True))
            wide.repartition("shard").sortWithinPartitions("ts_ms", "pk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path(source))
            span = wide.agg(F.min("ts_ms"), F.max("ts_ms")).first()
            self.catalogue.observe(source, labels, types, span[0], span[1])
            self.save()
        return Written(accepted, d.where("reason is not null"))

    def table(self, source: str) -> DataFrame:
        """A set's rows: a field that holds texts shows them all as texts."""
        info = self.catalogue.known[source]
        d = self.spark.read.option("mergeSchema", "true").parquet(self.path(source))
        for n, t in info.types.items():
            if t == "string" and n + TEXT in d.columns:
                d = d.withColumn(n, F.coalesce(F.col(n + TEXT), F.regexp_replace(F.col(n).cast("string"), r"\.0$", "")) if n in d.columns else F.col(n + TEXT)).drop(n + TEXT)
        return d

    def values(self, label: str) -> list[str] | None:
        """A label's values over all sets, if they are few."""
        found = None
        for s in self.catalogue.sets():
            if self.catalogue.has_label(s, label):
                rows = self.table(s).where(F.col(label).isNotNull()).select(F.col(label).alias("v")).distinct()
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            return []
        got = [r.v for r in found.distinct().limit(MAX_VALUES + 1).collect()]
        return sorted(got) if len(got) <= MAX_VALUES else None

    def planner(self) -> Planner:
        return Planner(self.catalogue, self.table, self.values)

    def sweep(self, now_ms: int) -> dict[str, int]:
        """Drops shards that lie before their set's retention, and rows of the shard it falls in."""
        dropped: dict[str, int] = {}
        for s, info in list(self.catalogue.known.items()):
            if not info.retention_ms:
                continue
            limit = now_ms - info.retention_ms
            for shard in self.shards(s):
                if shard + self.width(s) <= limit:
                    fs, p = self._fs(f"{self.path(s)}/shard={shard}")
                    fs.delete(p, True)
                    dropped[s] = dropped.get(s, 0) + 1
                elif shard < limit:
                    self._cut(s, shard, limit)
            if self.shards(s):
                info.first_ts = max(info.first_ts or 0, limit)
            else:
                self.catalogue.known[s] = SetInfo(declared=info.declared, buckets=info.buckets, retention_ms=info.retention_ms)
        self.save()
        return dropped

    def _cut(self, source: str, shard: int, limit: int) -> None:
        """Rewrites a shard without its rows before an instant."""
        from tidemark.sources.checkpoints import checkpointed

        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path(source)).where(F.col("shard") == shard)
        if rows.where(F.col("ts_ms") < limit).isEmpty():
            return
        kept = checkpointed(rows.where(F.col("ts_ms") >= limit))
        if kept.isEmpty():
            fs, p = self._fs(f"{self.path(source)}/shard={shard}")
            fs.delete(p, True)
        else:
            kept.sortWithinPartitions("ts_ms", "pk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path(source))

    def get(self, source: str, pk: str, columns: list[str] | None = None) -> DataFrame:
        """The sample of a key, all of its columns or some."""
        rows = self.table(source).where(F.col("pk") == pk)
        return rows.select(*columns) if columns else rows

    def drop(self, source: str) -> None:
        fs, p = self._fs(self.path(source))
        fs.delete(p, True)
        self.catalogue.known.pop(source, None)
        self.save()

    def compact(self, source: str) -> None:
        """Each shard's files as one."""
        from tidemark.sources.checkpoints import checkpointed

        d = checkpointed(self.spark.read.option("mergeSchema", "true").parquet(self.path(source)))
        d.repartition("shard").sortWithinPartitions("ts_ms", "pk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path(source))
