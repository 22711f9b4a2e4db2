"""Fingerprints of keys: XXH64 with any seed, as built-in expressions.

Spark's ``xxhash64`` has the fixed seed 42 and chains its arguments: the hash of
one is the seed of the next.  The hash of a long is a bijection, so for every
seed s there is a long whose hash is s; put before the key, it makes the built-in
function hash the key with seed s.  The expression stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = (1 << 64) - 1
# The primes of XXH64, and the seed of the verifying fingerprint.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
VERIFY_SEED = 0x517CC1B727220A95
SPARK_SEED = 42


def _rotate(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _unshift(x: int, r: int) -> int:
    """Inverse of ``x ^= x >> r``."""
    out = x
    for _ in range(64 // r):
        out = x ^ (out >> r)
    return out


def seed_argument(seed: int) -> int:
    """The long whose XXH64 with Spark's seed is ``seed`` (as a signed value)."""
    inverse = [pow(p, -1, 1 << 64) for p in (P1, P2, P3)]
    h = _unshift(seed & _M, 32) * inverse[2] & _M
    h = _unshift(h, 29) * inverse[1] & _M
    h = _unshift(h, 33)
    h = _rotate((h - P4) * inverse[0] & _M, 64 - 27)
    k = h ^ ((SPARK_SEED + P5 + 8) & _M)
    x = _rotate(k * inverse[0] & _M, 64 - 31) * inverse[1] & _M
    return x - (1 << 64) if x >> 63 else x


def xxh64(data: Column, seed: int = 0) -> Column:
    """XXH64 of binary or text; null for null."""
    return F.when(data.isNotNull(), F.xxhash64(F.lit(seed_argument(seed)), data.cast("binary")))


def _biased(h: Column) -> Column:
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def fingerprint(key: Column) -> Column:
    """Seed-0 hash of a key; 0 is an empty slot and becomes 1."""
    return _biased(xxh64(key, 0))


def verify_fingerprint(key: Column, version: int = 5) -> Column:
    """Second, independent hash; only version 5 replaces 0 by 1."""
    h = xxh64(key, VERIFY_SEED)
    return _biased(h) if version == 5 else h


def fence(fp: Column) -> Column:
    """High 32 bits as a non-negative long."""
    return F.shiftrightunsigned(fp, 32)


def compact_fingerprint(fp: Column) -> Column:
    return _biased(fence(fp))


def partition_of(fp: Column, n: int) -> Column:
    if n < 1 or n & (n - 1):
        raise ValueError(f"the number of partitions must be a power of two, not {n}")
    return fp.bitwiseAND(F.lit(n - 1)).cast("int")


def home_position(cfp: Column, buckets: Column) -> Column:
    return cfp % buckets


def checksum32(data: Column) -> Column:
    return xxh64(data, 0).bitwiseAND(F.lit(0xFFFFFFFF))


def radix_bucket(fp: Column, buckets: int) -> Column:
    """Top bits of the fingerprint for a power-of-two number of buckets."""
    bits = buckets.bit_length() - 1
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(fp, 64 - bits)


def unsigned_order(fp: Column) -> Column:
    """A signed value that orders like the unsigned fingerprint."""
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def xxh64_sql(source: str, key: str, seed: int, out: str) -> str:
    """``select *, XXH64 of the eight-byte text key as signed out`` in DuckDB SQL."""
    full = "18446744073709551616::uhugeint"
    lane = " + ".join(f"ord({key}[{i + 1}])::uhugeint * {256**i}::uhugeint" for i in range(8))

    def rot(x, r):
        return f"((({x} * {1 << r}::uhugeint) % {full}) + ({x} // {1 << (64 - r)}::uhugeint))"

    s = f"select *, (({lane}) * {P2}::uhugeint) % {full} as _a from {source}"
    s = f"select *, ({rot('_a', 31)} * {P1}::uhugeint) % {full} as _b from ({s})"
    s = f"select *, xor({(seed + P5 + 8) & _M}::ubigint, _b::ubigint)::uhugeint as _c from ({s})"
    s = f"select *, (({rot('_c', 27)} * {P1}::uhugeint) % {full} + {P4}::uhugeint) % {full} as _d from ({s})"
    s = f"select *, (xor(_d::ubigint, _d::ubigint >> 33)::uhugeint * {P2}::uhugeint) % {full} as _e from ({s})"
    s = f"select *, (xor(_e::ubigint, _e::ubigint >> 29)::uhugeint * {P3}::uhugeint) % {full} as _f from ({s})"
    s = f"select *, xor(_f::ubigint, _f::ubigint >> 32)::hugeint as _g from ({s})"
    return f"select * exclude (_a, _b, _c, _d, _e, _f, _g), (case when _g >= 9223372036854775808::hugeint then _g - 18446744073709551616::hugeint else _g end)::bigint as {out} from ({s})"
