"""Packing along a space-filling curve.

Each document becomes a hashed bag-of-tokens vector, projected by a fixed random
matrix to three dimensions and quantised to a Hilbert key.  Documents are
range-sorted by that key and laid end to end; the line is cut every 4096 ids, so
neighbours on the curve share sequences and only the very last one is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded_blocks
from .common import Scratch, mix

SEQUENCE = 4096
DIMENSIONS, BITS = 3, 10
BUCKETS = 4096


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows of 0 .. 2**bits - 1)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS))


def curve_keys(token_ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's hashed and projected token vector."""
    means = np.zeros((len(token_ids), DIMENSIONS))
    for k, ids in enumerate(token_ids):
        if len(ids):
            counts = np.bincount((mix(ids.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            means[k] = counts @ matrix / np.sqrt((counts.astype(np.float64) ** 2).sum())
    grid = np.clip((1 / (1 + np.exp(-means)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_key(grid)


def _encoder(path: str, end_id: int):
    def run(batches):
        matrix = projection()
        for batch, a, b, encoded, enc in encoded_blocks(batches, path):
            ids = [np.frombuffer(e, enc.dtype) for e in encoded]
            # equal keys are told apart by a hash of the id, so no range gets all copies of a text
            doc = batch.column(0).slice(a, b - a)
            tie = mix(np.array(doc.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)) >> np.uint64(64 - 33)
            key = (curve_keys(ids, matrix) << 33) | tie.astype(np.int64)
            tail = np.array([end_id], enc.dtype).tobytes()
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(key), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([e + tail for e in encoded], pa.binary()), pa.array(np.full(b - a, enc.width, np.int32))],
                ["id", "key", "n", "ids", "width"],
            )

    return run


def _cutter(base: dict[int, int]):
    def run(batches):
        at = None
        for batch in batches:
            part = batch.column(0).to_pylist()
            docs, lengths, blobs, widths = (batch.column(k).to_pylist() for k in range(1, 5))
            rows = []
            for pid, doc, n, blob, width in zip(part, docs, lengths, blobs, widths):
                if at is None or at[0] != pid:
                    at = [pid, base[pid]]
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                taken = 0
                while taken < n:
                    seq, offset = divmod(at[1], SEQUENCE)
                    size = min(n - taken, SEQUENCE - offset)
                    rows.append((doc, taken, size, zlib.crc32(ids[taken : taken + size].tobytes()), n, seq, offset))
                    taken += size
                    at[1] += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], PIECES)

    return run


PIECES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def position(bounds: list[int], key):
    """Number of ``bounds`` (ascending) that are at most ``key``, by binary search."""
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    if not steps:
        return F.lit(0)
    array = F.lit(bounds)
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(array, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at)
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of 4096 ids: ``id_col`` and the columns of ``PIECES``.

    Null and empty texts are the end id alone, so every row has a piece; repeated
    rows are packed each; null ids are packed like others.  An empty table gives
    no pieces.  The driver holds one total per shuffle partition and no more.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    coded = scratch.save(docs.mapInArrow(_encoder(tokenizer, end_id), "id long, key long, n long, ids binary, width int"), "encoded")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = coded.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0]
    placed = coded.withColumn("pid", position(sorted(set(cuts or [])), F.col("key")))
    totals, base, at = dict(placed.groupBy("pid").agg(F.sum("n")).collect()), {}, 0
    for pid in sorted(totals):
        base[pid] = at
        at += totals[pid]
    dealt = placed.select("pid", "id", "n", "ids", "width", "key").repartitionById(n, "pid").sortWithinPartitions("pid", "key", "id")
    schema = ", ".join(f"{c} long" for c in PIECES)
    return dealt.mapInArrow(_cutter(base), schema).withColumnRenamed("id", id_col)
