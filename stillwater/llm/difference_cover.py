"""Suffix sorting of many texts by the difference-cover algorithm, and the repeats it shows.

Positions with remainder 1 and 2 modulo 3 are the sample.  Their triples are
sorted and named; if names repeat, the sequences of names (one for either
remainder of every text) are sorted in the same way; the suffixes at remainder 0
are merged in by their first symbols and the rank of the sample suffix that
follows.  All sorts are range partitions; a rank is a count over the partitions
before, so no task and no driver sees more than its share.

``repeated_windows`` compares the prefixes of neighbours in the sorted order.
This is the exact reference form; ``suffix_dedup`` gives the same result with a
fraction of the rows (see the README for figures).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, text_blocks


def counted_before(rows: DataFrame, keys: list[str], flag: Column, out: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with the number of flagged rows of strictly smaller keys, and the most rows of one key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_f", flag.cast("long")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = scratch.save(dealt.withColumn("_p", F.spark_partition_id()), "sorted")
    totals, base, at = dict(dealt.groupBy("_p").agg(F.sum("_f")).collect()), {}, 0
    for p in sorted(totals):
        base[p] = at
        at += totals[p]
    offset = F.create_map(*[F.lit(x) for p, b in (base or {0: 0}).items() for x in (p, b)])[F.col("_p")]
    up_to = F.sum("_f").over(Window.partitionBy("_p").orderBy(*keys))
    peers = Window.partitionBy("_p", *keys)
    done = dealt.withColumn(out, offset + up_to - F.sum("_f").over(peers)).withColumn("_ties", F.count("*").over(peers))
    done = scratch.save(done, "ranked")
    ties = done.agg(F.coalesce(F.max("_ties"), F.lit(0))).first()[0]
    return done.drop("_f", "_p", "_ties"), ties


def suffix_order(symbols: DataFrame, scratch: Scratch) -> DataFrame:
    """``symbols(seq, pos, sym)`` (sym > 0, pos from 0 without gaps) with ``rank`` of each suffix.

    Ranks ascend in lexicographic order; equal suffixes have neighbouring ranks.
    """
    along = Window.partitionBy("seq").orderBy("pos")
    s = symbols.select("seq", "pos", "sym", F.lead("sym", 1, 0).over(along).alias("s1"), F.lead("sym", 2, 0).over(along).alias("s2"))
    s = scratch.save(s, "triples")
    sample, ties = counted_before(s.where("pos % 3 <> 0"), ["sym", "s1", "s2"], F.lit(1), "name", scratch)
    if ties > 1 and sample.agg(F.max("pos")).first()[0] >= 4:
        named = sample.select((F.col("seq") * 2 + F.col("pos") % 3 - 1).alias("seq"), F.expr("pos div 3").cast("int").alias("pos"), (F.col("name") + 1).alias("sym"))
        deeper = suffix_order(named, scratch).select((F.expr("seq div 2")).alias("seq"), (F.col("pos") * 3 + F.col("seq") % 2 + 1).cast("int").alias("pos"), F.col("rank").alias("name"))
        sample = deeper
    ranked = s.join(sample.select("seq", "pos", (F.col("name") + 1).alias("r")), ["seq", "pos"], "left")
    r = scratch.save(ranked.select("*", F.lead("r", 1, 0).over(along).alias("r1"), F.lead("r", 2, 0).over(along).alias("r2")), "sampled")
    kind = F.col("pos") % 3
    keep = ["seq", "pos", "sym", "r1"]
    a, _ = counted_before(r.where("pos % 3 <> 2").select(*keep), ["sym", "r1"], kind == 1, "a", scratch)
    b, _ = counted_before(r.where("pos % 3 <> 1").select("seq", "pos", "sym", "s1", "r2"), ["sym", "s1", "r2"], kind == 2, "b", scratch)
    p, _ = counted_before(r.where("pos % 3 <> 0").select("seq", "pos", "r"), ["r"], F.lit(1), "v", scratch)
    rest = a.where("pos % 3 = 0").join(b.where("pos % 3 = 0").select("seq", "pos", "b"), ["seq", "pos"])
    zero = rest.select("seq", "pos", (F.col("a") + F.col("b")).alias("v"), F.lit(0).alias("c"), F.col("sym").alias("k1"), F.col("r1").alias("k2"))
    one = p.select("seq", "pos", "v", F.lit(1).alias("c"), F.col("r").alias("k1"), F.lit(0).cast("long").alias("k2"))
    out, _ = counted_before(zero.unionByName(one), ["v", "c", "k1", "k2"], F.lit(1), "rank", scratch)
    return out.select("seq", "pos", "rank")


def _symbols(length: int):
    def run(batches):
        for batch, a, b, data, offsets in text_blocks(batches, size=1 << 17):
            n = np.diff(offsets)
            seq = np.repeat(np.array(batch.column(0).slice(a, b - a).to_pylist(), np.int64), n)
            pos = np.arange(len(data)) - np.repeat(offsets[:-1], n)
            full = pos + length <= np.repeat(n, n)
            at = np.flatnonzero(full)
            window = np.zeros(len(data), np.int64)
            window[at] = RollingHash(data).span(at, at + length).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seq), pa.array(pos.astype(np.int32)), pa.array(data.astype(np.int64) + 1), pa.array(window, mask=~full)], ["seq", "pos", "sym", "window"]
            )

    return run


def repeated_windows(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``docs(seq, text)`` with small distinct ``seq`` to the ``seq, pos`` of strings that also start elsewhere."""
    rows = scratch.save(docs.select("seq", "text").mapInArrow(_symbols(length), "seq long, pos int, sym long, window long"), "symbols")
    order = suffix_order(rows.select("seq", "pos", "sym"), scratch).join(rows.select("seq", "pos", "window"), ["seq", "pos"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(order.repartitionByRange(n, "rank").sortWithinPartitions("rank", "seq", "pos").withColumn("p", F.spark_partition_id()), "order")
    # the prefixes on either side of a partition's edge, two per partition
    edges = {r.p: (r.first, r.last) for r in dealt.groupBy("p").agg(F.min_by("window", F.struct("rank", "seq", "pos")).alias("first"), F.max_by("window", F.struct("rank", "seq", "pos")).alias("last")).collect()}
    parts = sorted(edges)
    before = {p: edges[q][1] for q, p in zip(parts, parts[1:])}
    after = {p: edges[q][0] for p, q in zip(parts, parts[1:])}

    def side(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for p in parts or [0] for x in (p, values.get(p))]).cast("map<int,bigint>")[F.col("p")]

    w = Window.partitionBy("p").orderBy("rank", "seq", "pos")
    first = F.row_number().over(w) == 1
    previous, following = F.lag("window").over(w), F.lead("window").over(w)
    last = F.lead("rank").over(w).isNull()
    same = (F.col("window") == F.when(first, side(before)).otherwise(previous)).alias("x"), (F.col("window") == F.when(last, side(after)).otherwise(following)).alias("y")
    return dealt.select("seq", "pos", *same).where("coalesce(x, false) or coalesce(y, false)").select("seq", "pos")
