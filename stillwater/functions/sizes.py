"""Sizes and names that follow from the two layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the layouts.
ALIGNMENT_V4, HEADER = 64, 12
FILL = 0.95
INDEX_PAD = 2 << 20
MIN_BLOCK, MAX_BLOCK = 4096, 65536
RADIX_TARGET, RADIX_BUCKETS = 128 << 20, 64
MAX_LENGTH_V5 = (1 << 30) - 1
MAX_VALUE = 16 << 20


def align(n: Column, to: int) -> Column:
    return (F.floor((n + (to - 1)) / to) * to).cast("long")


def aligned_size(value_length: Column) -> Column:
    """Stored bytes of a version 4 record."""
    return align(value_length + HEADER, ALIGNMENT_V4)


def encoded_length(value_length: Column) -> Column:
    """Stored bytes of a version 5 record."""
    return align(value_length + HEADER, 8)


def log2_bucket(n: Column) -> Column:
    """Bit width of a positive integer."""
    return F.length(F.bin(n)).cast("long")


def bucket_count_v4(n_keys: Column) -> Column:
    """Hash slots at fill 0.95, by integers (``ceil(n / 0.95)``)."""
    return F.floor((n_keys * 20 + 18) / 19).cast("long")


def radix_buckets(total_bytes: int, target: int = RADIX_TARGET) -> int:
    """Sort buckets: the next power of two over bytes / target, from 1 to 64."""
    if target <= 0:
        return 1
    need = max(1, -(-total_bytes // target))
    return min(RADIX_BUCKETS, 1 << (need - 1).bit_length())


def partition_dir(partition: Column, n: int) -> Column:
    return F.concat(F.lit("part-"), F.lpad(partition.cast("string"), len(str(n - 1)), "0"))
