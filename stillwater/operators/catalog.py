"""The catalog: prefix routing, diffs, generations, served versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bare_key, prefix_of, rfc3339

#: Catalog entries that are broadcast; a larger catalog is joined by shuffle.
BROADCAST_ENTRIES = 100_000
ENTRY = "struct<dataset:string,key_prefix:string,version_id:string,mount_path:string>"
SCHEMA = f"entries array<{ENTRY}>"
#: First and last line of a file that has one entry a line; the tab, which JSON ignores, tells it from other files.
HEAD, TAIL = '{"entries":\t[', "]}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a catalog file: line by line if ``write`` made it, else as one document."""
    from . import snapshot

    fs, p = snapshot._fs(spark, path)
    if fs.isFile(p):
        head = fs.open(p)
        try:
            by_line = bytes(head.readNBytes(len(HEAD) + 1)) == f"{HEAD}\n".encode()
        finally:
            head.close()
        if by_line:
            line = F.col("value")
            lines = spark.read.text(path).where(~line.isin(HEAD, TAIL))
            return lines.select(F.from_json(F.ltrim(line, F.lit(",")), ENTRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def write(entries: DataFrame, path: str) -> None:
    """Write the catalog file under a temporary name and rename it over ``path``.

    One JSON document of any number of entries, one a line by prefix: the executors
    write the lines, the driver copies them into one file as a stream.  A catalog in
    which two entries share a prefix is refused.
    """
    from . import snapshot

    spark = entries.sparkSession
    stage = f"{path}.{uuid.uuid4().hex[:12]}.parts"
    fs, p = snapshot._fs(spark, stage)
    rows = entries.select("key_prefix", F.struct("dataset", "key_prefix", "version_id", "mount_path").alias("e")).orderBy("key_prefix", "e.dataset")
    try:
        rows.select(F.concat(F.lit(","), F.to_json("e", {"ignoreNullFields": "false"}))).write.option("compression", "none").text(stage)
        staged = spark.read.text(stage).select(F.from_json(F.ltrim("value", F.lit(",")), ENTRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")
        if not duplicate_prefixes(staged).isEmpty():
            raise ValueError("two entries share a key prefix")
        out = fs.create(snapshot._fs(spark, f"{path}.tmp")[1], True)
        try:
            out.write(bytearray(f"{HEAD}\n".encode()))
            first = True
            for part in sorted((s.getPath() for s in fs.listStatus(p) if s.getLen()), key=lambda x: x.getName()):
                lines = fs.open(part)
                try:
                    if first:
                        lines.seek(1)  # no comma before the first entry
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 16, False)
                finally:
                    lines.close()
                first = False
            out.write(bytearray(TAIL.encode()))
        finally:
            out.close()
        snapshot.rename_over(spark, f"{path}.tmp", path)
    finally:
        fs.delete(p, True)


def duplicate_prefixes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key_prefix").agg(F.count("*").alias("n")).where("n > 1")


def validated(entries: DataFrame) -> DataFrame:
    """Entries that raise when read if two share a prefix."""
    n = F.count("*").over(Window.partitionBy("key_prefix"))
    return entries.withColumn("dataset", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key prefix "), "key_prefix"))).otherwise(F.col("dataset")))


def route(requests: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """Dataset and bare key of each request: ``routed``, ``unknown`` prefix, or ``no_prefix`` (an error)."""
    small = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    side = entries.select(F.col("key_prefix").alias("_p"), "dataset")
    prefix = prefix_of(F.col(key))
    out = requests.withColumns({"prefix": prefix, "bare_key": bare_key(F.col(key))})
    out = out.join(F.broadcast(side) if small else side, out.prefix == side._p, "left").drop("_p")
    return out.withColumn("outcome", F.when(F.col("prefix").isNull(), "no_prefix").when(F.col("dataset").isNull(), "unknown").otherwise("routed"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, updated or unchanged by key prefix."""
    a = old.select("key_prefix", F.struct("dataset", "version_id", "mount_path").alias("a"))
    b = new.select("key_prefix", F.struct("dataset", "version_id", "mount_path").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated")
    return a.join(b, "key_prefix", "full_outer").select("key_prefix", change.alias("change"), F.col("a.version_id").alias("old_version"), F.col("b.version_id").alias("new_version"))


def promoted(entries: DataFrame, active: Column, promotion: DataFrame) -> DataFrame:
    """Catalog to write: the other datasets' active entries and the promoted ones."""
    others = entries.where(active).join(promotion.select("dataset"), "dataset", "left_anti")
    columns = ["dataset", "key_prefix", "version_id", "mount_path"]
    return others.select(*columns).unionByName(promotion.select(*columns))


def generation_at(requests: DataFrame, generations: DataFrame, at: str) -> DataFrame:
    """The generation in force at each request: the last with ``effective <= at``.

    One union and one window per ``part`` (connection, shard, ...), not a range join.
    """
    both = requests.select("part", F.col(at).alias("t"), F.struct(*requests.columns).alias("r"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("g")).unionByName(
        generations.select("part", F.col("effective").alias("t"), F.lit(None).cast(requests.select(F.struct(*requests.columns).alias("r")).schema["r"].dataType).alias("r"), F.lit(0).alias("side"), F.col("generation").cast("long").alias("g"))
    )
    w = Window.partitionBy("part").orderBy("t", "side", "g").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("g", F.last("g", ignorenulls=True).over(w)).where("side = 1").select("r.*", F.col("g").alias("generation"))


def versions(loaded: DataFrame) -> DataFrame:
    """Rows of the version report, sorted by dataset."""
    return loaded.select("dataset", "version_id", rfc3339(F.col("loaded_at")).alias("loaded_at")).orderBy("dataset")


def version_json(loaded: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("dataset", "version_id", rfc3339(F.col("loaded_at")).alias("loaded_at"))))
    return loaded.agg(F.to_json(F.struct(rows.alias("datasets"))).alias("body"))


def compare_served(catalog: DataFrame, served: DataFrame) -> DataFrame:
    """Catalog and served versions side by side, and whether they agree."""
    a, b = catalog.select("dataset", F.col("version_id").alias("catalog_version")), served.select("dataset", F.col("version_id").alias("served_version"))
    return a.join(b, "dataset", "full_outer").withColumn("converged", F.coalesce(F.col("catalog_version") == F.col("served_version"), F.lit(False)))


def with_descriptor(assignments: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Descriptor by key prefix, else the first prefix's that has one."""
    fallback = descriptors.where("descriptor is not null").agg(F.min_by("descriptor", "key_prefix").alias("first"))
    return assignments.join(descriptors, "key_prefix", "left").crossJoin(F.broadcast(fallback)).withColumn("descriptor", F.coalesce("descriptor", "first")).drop("first")


class Served:
    """The catalog in force: swapped as a whole, failures keep the current one."""

    def __init__(self, entries: DataFrame):
        self.entries, self.generation = entries, 0

    def swap(self, entries: DataFrame, open_all=None) -> bool:
        try:
            checked = validated(entries).cache()
            checked.count()
            if open_all:
                open_all(checked)
        except Exception:
            return False
        old, self.entries = self.entries, checked
        self.generation += 1
        old.unpersist(blocking=False)
        return True
