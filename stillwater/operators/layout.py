"""The two record layouts as derived relations: sizes, offsets, blocks, fences, heap.

Fingerprint order is unsigned.  A hash partition is cut by the top bits of the
fingerprint, so no window and no fold spans a partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import sizes as S

LES = [64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072, 262144, 524288, 1048576, 2097152, 4194304, 8388607]


def addressed(kv: DataFrame, n: int, version: int = 5) -> DataFrame:
    """``kv`` with ``fp, vfp, partition_id``."""
    return kv.withColumns({"fp": H.fingerprint(F.col("key")), "vfp": H.verify_fingerprint(F.col("key"), version)}).withColumn(
        "partition_id", H.partition_of(F.col("fp"), n)
    )


def partition_stats(pairs: DataFrame) -> DataFrame:
    """Keys and value bytes by partition."""
    size = F.octet_length("value")
    return pairs.groupBy("partition_id").agg(
        F.count("*").alias("n_keys"), F.sum(size).alias("sum_bytes"), F.min(size).cast("long").alias("min_bytes"), F.max(size).cast("long").alias("max_bytes"),
        F.floor(F.sum(size) / F.count("*")).cast("long").alias("mean_bytes"),
    )


def size_histogram(lengths: DataFrame, les: list[int] = LES) -> DataFrame:
    """Cumulative counts of ``length`` by upper bound, and those beyond the last; an empty value counts as one byte."""
    v = F.greatest("length", F.lit(1))
    row = lengths.agg(*[F.count_if(v <= le).alias(f"le_{le}") for le in les], F.count_if(v > les[-1]).alias("over"))
    return row.select(F.explode(F.array(
        *[F.struct(F.lit(le).cast("long").alias("le"), F.col(f"le_{le}").alias("n")) for le in les], F.struct(F.lit(None).cast("long").alias("le"), F.col("over").alias("n"))
    )).alias("x")).select("x.le", "x.n")


def running_before(rows: DataFrame, by: list[str], order: list, value, out: str, bucket=None, limit: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows before, by ``order`` in each group ``by``.

    Two passes, so a group is not one task's work: totals of the buckets, a
    coarse form of the order, then a window inside each bucket on top of the
    totals before it.  With ``limit`` only buckets that begin at or below it stay.
    """
    rows = rows.withColumn("_b", F.lit(0) if bucket is None else bucket).withColumn("_v", value)
    totals = rows.groupBy(*by, "_b").agg(F.sum("_v").alias("_t"))
    # one row per bucket
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    if limit is not None:
        base = base.where(F.col("_base") <= limit)
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(base, [*by, "_b"]).withColumn(out, (F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).cast("long"))
    return found.drop("_b", "_v", "_base")


def record_offsets(records: DataFrame, order: str, bucket=None) -> DataFrame:
    """Version 4: where each record starts, in units of 64 bytes, by arrival ``order`` in its partition (``bucket``: its coarse form)."""
    sized = records.withColumn("aligned", S.aligned_size(F.col("length")))
    return running_before(sized, ["partition_id"], [order], F.col("aligned") / S.ALIGNMENT_V4, "offset_units", bucket)


def index_layout(stats: DataFrame) -> DataFrame:
    """Version 4: slots, bytes and start of each partition's table; tables are padded to 2 MiB apart."""
    sized = stats.withColumn("buckets", S.bucket_count_v4(F.col("n_keys"))).withColumn("index_bytes", F.col("buckets") * 8)
    # one row per partition: the window is as long as the number of partitions
    w = Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("index_offset", F.coalesce(F.sum(S.align(F.col("index_bytes"), S.INDEX_PAD)).over(w), F.lit(0)))


def index_stats(sized: DataFrame) -> DataFrame:
    """Over the partitions of ``index_layout``: slots, least, greatest and mean fill in millionths, partitions padded beyond one unit, retries (slots are counted, so none)."""
    fill = F.floor(F.col("n_keys") * 1_000_000 / F.col("buckets")).cast("long")
    return sized.agg(
        F.count("*").alias("partitions"), F.sum("buckets").alias("buckets"), F.min(fill).alias("fill_min"), F.max(fill).alias("fill_max"),
        F.floor(F.sum("n_keys") * 1_000_000 / F.sum("buckets")).cast("long").alias("fill_mean"),
        F.count_if(F.col("index_bytes") > S.INDEX_PAD).alias("overflow_partitions"), F.lit(0).cast("long").alias("retries"),
    )


#: Records of one compact fingerprint that a version 4 table can hold.
CROWD_LIMIT = 255


def crowded_fingerprints(pairs: DataFrame, limit: int = CROWD_LIMIT) -> DataFrame:
    """Compact fingerprints with more than ``limit`` records in a partition; version 4 cannot index them."""
    return pairs.groupBy("partition_id", H.compact_fingerprint(F.col("fp")).alias("cfp")).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def refuse_crowded(pairs: DataFrame, limit: int = CROWD_LIMIT) -> None:
    """Raise if a compact fingerprint has too many records, before anything is written."""
    worst = crowded_fingerprints(pairs, limit).orderBy(F.desc("n")).first()
    if worst is not None:
        raise ValueError(f"partition {worst.partition_id}: {worst.n} records of one fingerprint, over {limit}")


def duplicate_keys(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def size_classes(lengths: DataFrame) -> DataFrame:
    """Version 5: records by bit width of their stored size."""
    return lengths.groupBy(S.log2_bucket(S.encoded_length(F.col("length"))).alias("bucket")).agg(F.count("*").alias("n"))


def block_size(classes: DataFrame) -> DataFrame:
    """Block size from the median size class: twice its upper end, from 4 to 64 KiB; 4096 without records."""
    # at most 31 rows
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = classes.select("bucket", F.sum("n").over(w).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    median = cum.where("2 * cum >= total").agg(F.min("bucket").alias("bucket"))
    size = F.expr(f"least(greatest(shiftleft(1L, cast(bucket + 1 as int)), {S.MIN_BLOCK}), {S.MAX_BLOCK})")
    return median.select(F.coalesce(size, F.lit(S.MIN_BLOCK)).cast("long").alias("block_size"))


def inlined(records: DataFrame, block: int) -> DataFrame:
    """Version 5: values over half a block go to the heap, leaving a stub of 12 bytes."""
    stub = F.col("length") > block // 2
    return records.withColumn("out_of_line", stub).withColumn("stored_length", S.encoded_length(F.when(stub, F.lit(12)).otherwise(F.col("length"))))


def heap_offsets(records: DataFrame) -> DataFrame:
    """Start of each out-of-line value in its partition's heap, in fingerprint order."""
    size = F.when(F.col("out_of_line"), F.col("length")).otherwise(0)
    bucket = H.radix_bucket(F.col("fp"), S.RADIX_BUCKETS)
    rows = running_before(records, ["partition_id"], [H.unsigned_order(F.col("fp")), "key"], size, "heap_offset", bucket)
    return rows.withColumn("heap_offset", F.when(F.col("out_of_line"), F.col("heap_offset")))


def _block_starts(sizes: np.ndarray, room: int, fill: int) -> np.ndarray:
    """Records that start a block, when the block before them holds ``fill`` bytes already."""
    total = np.cumsum(sizes)
    out, n = [], len(sizes)
    # a block takes its first record whatever its size
    at = int(np.searchsorted(total, room - fill, "right")) if fill else 0
    while at < n:
        out.append(at)
        before = int(total[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(total, before + room, "right")))
    return np.array(out, np.int64)


def _crossing(room: int):
    """For each bucket, by fill at its start: blocks begun in it and the fill at its end."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(["o", "key"])["stored_length"].to_numpy(np.int64)
        total, memo = np.cumsum(sizes), {}

        def tail(at: int) -> tuple[int, int]:
            # blocks from a block that starts with record ``at``, and the last one's fill
            path = []
            while at not in memo:
                before = int(total[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(total, before + room, "right")))
                path.append(at)
                if to >= len(sizes):
                    memo[at] = (1, int(total[-1]) - before)
                    path.pop()
                    break
                at = to
            found = memo[at]
            for p in reversed(path):
                found = memo[p] = (found[0] + 1, found[1])
            return found

        begun, fills = [], []
        for fill in range(0, room + 8, 8):
            at = int(np.searchsorted(total, room - fill, "right")) if fill else 0
            n, end = (0, fill + int(total[-1])) if at >= len(sizes) else tail(at)
            begun.append(n)
            fills.append(end)
        return pd.DataFrame({"partition_id": [key[0]], "b": [key[1]], "begun": [begun], "fills": [fills]})

    return run


def _enter(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk a partition's buckets: fill and last block when each begins."""
    fill, block, out = 0, -1, []
    for row in pdf.sort_values("b").itertuples():
        out.append((key[0], row.b, fill, block))
        k = min(fill // 8, len(row.fills) - 1)
        fill, block = int(row.fills[k]), block + int(row.begun[k])
    return pd.DataFrame(out, columns=["partition_id", "b", "fill", "last_block"])


def packed_blocks(records: DataFrame, block: int, buckets: int = S.RADIX_BUCKETS) -> DataFrame:
    """Version 5: block and place of each record; a record that does not fit starts the next block.

    The state resets at every block, so no window function expresses it.  A
    partition is cut by the top bits of the fingerprint: each bucket tells how it
    passes on every possible fill (stored sizes are multiples of 8), a walk over
    these tables gives each bucket's start, and the buckets are then packed side
    by side.  A block reaches over the edge of a bucket as it would without it.
    """
    room = block - 4
    rows = records.withColumns({"b": H.radix_bucket(F.col("fp"), buckets), "o": H.unsigned_order(F.col("fp"))})
    light = rows.select("partition_id", "b", "o", "key", "stored_length")
    tables = light.groupBy("partition_id", "b").applyInPandas(_crossing(room), "partition_id int, b long, begun array<long>, fills array<long>")
    starts = tables.groupBy("partition_id").applyInPandas(_enter, "partition_id int, b long, fill long, last_block long")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "key"], ignore_index=True)
        sizes, fill, last = pdf["stored_length"].to_numpy(np.int64), int(pdf["fill"].iloc[0]), int(pdf["last_block"].iloc[0])
        first = _block_starts(sizes, room, fill)
        before = np.cumsum(sizes) - sizes
        at = np.searchsorted(first, np.arange(len(sizes)), "right")
        start = np.where(at > 0, before[first[np.maximum(at - 1, 0)]] if len(first) else 0, -fill)
        return pd.DataFrame({"partition_id": pdf["partition_id"], "key": pdf["key"], "block": last + at, "block_offset": before - start})

    # Python sees sizes and keys only; the other columns meet the result by key
    kind = records.schema["key"].dataType.simpleString()
    placed = light.join(starts, ["partition_id", "b"]).groupBy("partition_id", "b").applyInPandas(place, f"partition_id int, key {kind}, block long, block_offset long")
    return records.join(placed, ["partition_id", "key"])


def block_fences(packed: DataFrame) -> DataFrame:
    """The high half of the first fingerprint of each block."""
    return packed.groupBy("partition_id", "block").agg(F.min(H.fence(F.col("fp"))).alias("fence"), F.count("*").alias("n_records"))


def candidate_blocks(probes: DataFrame, fences: DataFrame, buckets: int = S.RADIX_BUCKETS) -> DataFrame:
    """Blocks to read for each probe, in order: equal fences ascending, then the one before.

    ``probes(key, partition_id, fp)``.  The predecessor is found by sorting
    fences and probes together inside a bucket of fences, on top of the last
    fence of the buckets before; no range join and no window over a partition.
    """
    h = H.fence(F.col("fp"))
    bits = buckets.bit_length() - 1
    coarse = F.shiftright("h", 32 - bits) if bits else F.lit(0).cast("long")
    ask = probes.select("key", "partition_id", h.alias("h"))
    equal = ask.join(fences.select("partition_id", F.col("fence").alias("h"), "block"), ["partition_id", "h"]).select("key", "partition_id", "block", F.lit(0).alias("back"))
    kind = probes.schema["key"].dataType.simpleString()
    both = fences.select("partition_id", F.col("fence").alias("h"), "block", F.lit(None).cast(kind).alias("key"), F.lit(1).alias("side")).unionByName(
        ask.select("partition_id", "h", F.lit(None).cast("long").alias("block"), "key", F.lit(0).alias("side"))
    ).withColumn("b", coarse)
    earlier = Window.partitionBy("partition_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("partition_id", "b").agg(F.max_by("block", F.when(F.col("side") == 1, F.struct("h", "block"))).alias("top"))
    carried = carried.select("partition_id", "b", F.last("top", ignorenulls=True).over(earlier).alias("carry"))
    # a probe sorts before fences equal to it, so the last block seen has a smaller fence
    w = Window.partitionBy("partition_id", "b").orderBy("h", "side", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = both.join(carried, ["partition_id", "b"]).withColumn("prev", F.coalesce(F.last("block", ignorenulls=True).over(w), F.col("carry"))).where("side = 0 and prev is not null")
    found = equal.unionByName(before.select("key", "partition_id", F.col("prev").alias("block"), F.lit(1).alias("back")))
    order = Window.partitionBy("key").orderBy("back", "block")
    return found.withColumn("ordinal", F.row_number().over(order).cast("long")).select("key", "partition_id", "block", "ordinal")


def probe_hash_table(cfps: list[int], n: int) -> list[tuple[int, int] | None]:
    """Robin Hood placement of compact fingerprints in ``n`` slots: (fingerprint, probe length).

    Only for comparing probe lengths at small sizes; lookups here are joins.
    """
    slots: list = [None] * n
    for cfp in cfps:
        held, at = (cfp, 0), cfp % n
        while slots[at] is not None:
            if slots[at][1] < held[1]:
                slots[at], held = held, slots[at]
            held, at = (held[0], held[1] + 1), (at + 1) % n
            if held[1] > 255:
                raise OverflowError("probe length over 255: more slots are needed")
        slots[at] = held
    return slots
