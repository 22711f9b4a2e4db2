"""Batch lookups with explicit outcomes: hit, miss without and miss with I/O."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H


def lookup(requests: DataFrame, snapshot: DataFrame, n: int) -> DataFrame:
    """``requests(key)`` against ``snapshot(key, fp, partition_id, value)``: one row per request.

    Equal fingerprints are told apart by the stored key.  The partition id is in
    the join, so a partitioned snapshot is pruned.
    """
    ask = requests.select("key").withColumn("fp", H.fingerprint(F.col("key"))).withColumn("partition_id", H.partition_of(F.col("fp"), n))
    have = snapshot.select("partition_id", "fp", "key", F.col("value"), F.lit(True).alias("found"))
    out = ask.join(have, ["partition_id", "fp", "key"], "left")
    return out.select("key", "partition_id", "fp", F.when(F.col("found"), "hit").otherwise("miss").alias("status"), "value")


def lookup_cost(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``io`` (a miss that had to read) and ``reads`` (candidate blocks) without a membership filter.

    A miss is free if its partition is empty or its fingerprint lies below the
    partition's first fence.
    """
    reads = candidates.groupBy("key").agg(F.count("*").alias("reads"))
    out = found.join(reads, "key", "left")
    return out.select(*found.columns, F.coalesce("reads", F.lit(0)).cast("long").alias("reads")).withColumn(
        "io", (F.col("status") == "miss") & (F.col("reads") > 0)
    )
