"""Snapshots: sorted, hash-partitioned Parquet with a manifest written last."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import sizes as S
from . import layout

MANIFEST, VERSION = "meta.json", 1


class SnapshotError(Exception):
    """The snapshot is incomplete, damaged or of an unknown version; never a miss."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first().value


def deduplicated(pairs: DataFrame, policy: str, order: list | None = None) -> DataFrame:
    """``error`` (raises when read), ``keep_all_count``, or ``first_by`` the order columns."""
    if policy == "keep_all_count":
        return pairs
    w = Window.partitionBy("key")
    if policy == "error":
        n = F.count("*").over(w)
        return pairs.withColumn("value", F.when(n > 1, F.raise_error("duplicate key")).otherwise(F.col("value")))
    if policy == "first_by":
        return pairs.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_r")
    raise ValueError(f"unknown policy {policy}")


def unique(placed: DataFrame, policy: str, order: list | None, n: int) -> DataFrame:
    """``placed`` rows sorted by fingerprint within (partition, top bits), duplicates treated by ``policy``: one shuffle.

    Equal keys are neighbours in that order, so one look back tells them.
    """
    if policy not in ("error", "keep_all_count", "first_by"):
        raise ValueError(f"unknown policy {policy}")
    rows = placed.withColumns({"_b": H.radix_bucket(F.col("fp"), S.RADIX_BUCKETS), "_o": H.unsigned_order(F.col("fp"))})
    sort = ["_o", "key", *(order or [])]
    if policy == "keep_all_count":
        return rows.repartition("partition_id", "_b").sortWithinPartitions("partition_id", "_b", *sort).drop("_b", "_o")
    w = Window.partitionBy("partition_id", "_b").orderBy(*sort)
    again = F.coalesce(F.lag("key").over(w) == F.col("key"), F.lit(False))
    rows = rows.withColumn("_again", again)
    if policy == "first_by":
        rows = rows.where("not _again")
    else:
        rows = rows.withColumn("value", F.when(F.col("_again"), F.raise_error("duplicate key")).otherwise(F.col("value")))
    return rows.drop("_b", "_o", "_again")


def write(pairs: DataFrame, root: str, n: int = 64, on_duplicate: str = "error", order: list | None = None, encoding: dict | None = None, marker: str = "rename") -> dict:
    """Write ``pairs(key, value)`` and publish the manifest; returns it.

    A complete snapshot is left as it is; one without a manifest is written
    anew.  ``marker``: ``rename`` a temporary manifest into place, or ``direct``
    for stores whose single-object writes are atomic.
    """
    spark = pairs.sparkSession
    done = _read_text(spark, f"{root}/{MANIFEST}")
    if done is not None:
        return json.loads(done)
    placed = layout.addressed(pairs, n)
    unique(placed, on_duplicate, order, n).write.mode("overwrite").partitionBy("partition_id").parquet(f"{root}/data")
    back = spark.read.parquet(f"{root}/data") if _has_rows(spark, root) else placed.limit(0)
    stats = layout.partition_stats(back).orderBy("partition_id").collect()
    meta = {
        "version": VERSION, "n_partitions": n, "verify_seed": str(H.VERIFY_SEED), "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "encoding": encoding or {"raw": {}}, "stats": {"n_keys": sum(s.n_keys for s in stats), "sum_bytes": sum(s.sum_bytes for s in stats)},
        "partitions": [{"id": s.partition_id, "n_keys": s.n_keys, "sum_bytes": s.sum_bytes} for s in stats],
    }
    publish(spark, f"{root}/{MANIFEST}", json.dumps(meta), marker)
    return meta


def _has_rows(spark: SparkSession, root: str) -> bool:
    fs, p = _fs(spark, f"{root}/data")
    return fs.exists(p) and any("partition_id=" in str(s.getPath()) for s in fs.listStatus(p))


def publish(spark: SparkSession, path: str, text: str, marker: str = "rename") -> None:
    if marker == "direct":
        return _write_text(spark, path, text)
    if marker != "rename":
        raise ValueError(f"unknown marker {marker}")
    _write_text(spark, f"{path}.tmp", text)
    rename_over(spark, f"{path}.tmp", path)


def rename_over(spark: SparkSession, tmp: str, path: str) -> None:
    """Rename over a file that may be there, in one step: a reader sees the old or the new one."""
    source, final = (_fs(spark, x)[1] for x in (tmp, path))
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    jvm.java.lang.reflect.Array.set(rename, 0, jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE"))
    try:
        context.rename(source, final, rename)
    except Exception as e:
        raise SnapshotError(f"cannot publish {path}") from e


def describe(spark: SparkSession, root: str) -> dict:
    """The manifest: its version first, then the fields this version needs."""
    text = _read_text(spark, f"{root}/{MANIFEST}")
    if text is None:
        raise SnapshotError(f"{root} has no manifest: incomplete")
    try:
        meta = json.loads(text)
    except ValueError as e:
        raise SnapshotError(f"{root}: damaged manifest") from e
    if meta.get("version") != VERSION:
        raise SnapshotError(f"{root}: unknown version {meta.get('version')}")
    missing = {"n_partitions", "partitions", "stats", "verify_seed", "encoding"} - set(meta)
    if missing:
        raise SnapshotError(f"{root}: manifest lacks {', '.join(sorted(missing))}")
    return meta


def open_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    """Data and manifest after checking every partition's keys and bytes; damage shows here, not at the first lookup."""
    meta = describe(spark, root)
    if not meta["partitions"]:
        return spark.createDataFrame([], "key binary, value binary, fp long, vfp long, partition_id int"), meta
    try:
        data = spark.read.parquet(f"{root}/data")
        have = {r.partition_id: (r.n_keys, r.sum_bytes) for r in layout.partition_stats(data).collect()}
    except Exception as e:
        raise SnapshotError(f"{root}: data cannot be read") from e
    want = {p["id"]: (p["n_keys"], p["sum_bytes"]) for p in meta["partitions"]}
    if have != want:
        raise SnapshotError(f"{root}: partitions differ from the manifest")
    return data, meta


def sample_prefix(records: DataFrame, order, limit: int, bucket=None) -> DataFrame:
    """Non-empty values in order while their frames (8 bytes of header each) fit ``limit`` bytes.

    ``bucket``: a coarse form of the order; buckets beyond the limit are never sorted.
    """
    full = records.where("length > 0").withColumn("_frame", F.col("length") + 8)
    order = order if isinstance(order, list) else [order]
    rows = layout.running_before(full, ["partition_id"], order, F.col("_frame"), "used", bucket, limit).withColumn("used", F.col("used") + F.col("_frame"))
    return rows.where(F.col("used") <= limit).drop("_frame")
