"""Stored snapshots end to end: built in resumable phases, read by key.

``build`` runs four phases, each of which leaves a mark and is skipped if it is
there: the *plan* (dictionary and its sample), the *data* (one shuffle), the
*filters*, the *manifest*.  ``Lookup.get`` asks the filters first, then reads only
the partitions and fingerprints that they let through.

A hash partition is cut by the top bits of the fingerprint into buckets, so work
runs side by side inside it and no filter or sort spans a partition.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, sizes as S
from ..functions import hashing as H
from . import layout, snapshot
from .snapshot import SnapshotError

#: Keys that one filter is meant for; a partition of more keys has several, by the top bits of the fingerprint.
FILTER_KEYS = 1_000_000
#: Bits a key and probes of a filter: one key in 250 that is not there passes.
FILTER_BITS, FILTER_PROBES = 12, 8
#: Fingerprints whose bit numbers are held at once.
FILTER_SLICE = 65_536
#: Keys to read up to which their fingerprints go into the scan's filter, so that row groups are skipped.
PUSHED_KEYS = 2_000
#: Keys to read up to which they are broadcast.
BROADCAST_KEYS = 200_000


# ------------------------------------------------------------------ formats and progress


class Format:
    """What differs between the two layouts."""

    version = 5
    max_length = S.MAX_LENGTH_V5

    def stored_length(self, length: Column) -> Column:
        return S.encoded_length(length)

    def compression(self, name: str) -> str:
        if name not in ("none", "zstd", "zstd-dict"):
            raise ValueError(f"unknown compression {name}")
        return name


class Format4(Format):
    version = 4
    max_length = (1 << 32) - 1

    def stored_length(self, length: Column) -> Column:
        return S.aligned_size(length)

    def compression(self, name: str) -> str:
        super().compression(name)
        return "none"  # has no effect on this layout


FORMATS: dict[int, Format] = {4: Format4(), 5: Format()}


@dataclass
class Progress:
    """State of a phase: what it has done, and how fast."""

    phase: str
    keys: int
    bytes: int
    seconds: float
    skipped: bool = False

    @property
    def keys_per_second(self) -> float:
        return self.keys / self.seconds if self.seconds else 0.0

    @property
    def bytes_per_second(self) -> float:
        return self.bytes / self.seconds if self.seconds else 0.0


def progress_rates(samples: DataFrame) -> DataFrame:
    """``samples(phase, at, keys, bytes)`` of running totals to the rate of each interval of a phase; the first has none."""
    w = Window.partitionBy("phase").orderBy("at")
    seconds = F.unix_micros(F.col("at").cast("timestamp")) / F.lit(1e6)
    rows = samples.select("phase", "at", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in ("keys", "bytes")], (seconds - F.lag(seconds).over(w)).alias("seconds"))
    rate = {f"{c}_per_second": F.when(F.col("seconds") > 0, F.floor(F.col(c) / F.col("seconds"))).cast("long") for c in ("keys", "bytes")}
    return rows.where("seconds is not null").select("phase", "at", "keys", "bytes", *[v.alias(k) for k, v in rate.items()])


# ------------------------------------------------------------------ filters


def _positions(fp: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each fingerprint, a column per probe."""
    h = fp.astype(np.int64).view(np.uint64)
    a, b = h * np.uint64(0x9E3779B97F4A7C15), (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    return ((a[:, None] + np.arange(FILTER_PROBES, dtype=np.uint64) * b[:, None]) >> np.uint64(11)) % np.uint64(bits)


def filter_bytes(fp: np.ndarray) -> bytes:
    """A Bloom filter as large as its distinct keys ask for."""
    fp = np.unique(fp)
    bits = max(64, -(-len(fp) * FILTER_BITS // 64) * 64)
    on = np.zeros(bits, np.uint8)
    for at in range(0, len(fp), FILTER_SLICE):
        on[_positions(fp[at : at + FILTER_SLICE], bits).ravel().astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def might_contain(data: bytes, fp: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(data, np.uint8)
    at = _positions(fp, 8 * len(bits)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _buckets_for(largest: int) -> int:
    return 1 << max(0, (-(-max(1, largest) // FILTER_KEYS) - 1).bit_length())


def filter_buckets(placed: DataFrame) -> int:
    """Filters that each partition of ``placed`` needs, by its largest."""
    return _buckets_for(placed.groupBy("partition_id").count().agg(F.max("count").alias("n")).first().n or 0)


FILTER_SCHEMA = "partition_id int, bucket long, n_keys long, filter binary, checksum long"


def partition_filters(placed: DataFrame, buckets: int = 1) -> DataFrame:
    """A filter for each (partition, bucket) of ``placed(partition_id, fp)`` that has keys, with its checksum.

    A worker holds the distinct fingerprints of one bucket; ``filter_buckets`` keeps them few.
    """

    def make(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, fresh, held, n = np.empty(0, np.int64), [], 0, 0
        for batch in batches:
            fresh.append(np.array(batch.column("fp"), np.int64))
            n, held = n + batch.num_rows, held + batch.num_rows
            if held > max(len(seen), FILTER_SLICE):
                seen, fresh, held = np.unique(np.concatenate([seen, *fresh])), [], 0
        data = filter_bytes(np.concatenate([seen, *fresh]))
        yield pa.RecordBatch.from_pydict(
            {"partition_id": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int64()), "n_keys": pa.array([n], pa.int64()), "filter": pa.array([data], pa.binary()), "checksum": pa.array([zlib.crc32(data)], pa.int64())}
        )

    rows = placed.select("partition_id", H.radix_bucket(F.col("fp"), buckets).alias("bucket"), "fp")
    return rows.groupBy("partition_id", "bucket").applyInArrow(make, FILTER_SCHEMA)


def filtered(probes: DataFrame, filters: DataFrame, buckets: int = 1) -> DataFrame:
    """``probes(key, partition_id, fp)`` that their partition's filter lets through; none where there is no filter.

    A filter whose checksum is wrong raises: it must never turn into a miss.  A
    group is its filter and then its probes, batch by batch, so a worker holds one
    filter and one batch however many probes there are.
    """
    keys, columns = ["partition_id", "bucket"], probes.columns
    asked = probes.select("*", H.radix_bucket(F.col("fp"), buckets).alias("bucket"), F.lit(1).alias("_side"))
    sieves = filters.select(*keys, F.lit(0).alias("_side"), F.col("filter").alias("_filter"), F.col("checksum").alias("_checksum"))
    rows = asked.unionByName(sieves, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_side")

    def probe(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, early = None, []
        for batch in batches:
            side = np.array(batch.column("_side"))
            if data is None and (side == 0).any():
                at = int(np.argmin(side))
                data = batch.column("_filter")[at].as_py()
                if zlib.crc32(data) != batch.column("_checksum")[at].as_py():
                    raise SnapshotError(f"damaged filter of partition {key[0].as_py()}")
            asking = batch.select(columns).filter(pa.array(side == 1))
            if data is None:  # only if an engine does not keep the order inside a group
                early.append(asking)
                continue
            for part in (*early, asking):
                if part.num_rows:
                    yield part.filter(pa.array(might_contain(data, np.array(part.column("fp"), np.int64))))
            early = []

    return rows.groupBy(*keys).applyInArrow(probe, probes.schema)


# ------------------------------------------------------------------ building


def first_sample(placed: DataFrame, limit: int = codec.SAMPLE_BYTES) -> DataFrame:
    """The values of the first partition that has any, in fingerprint order, while their frames fit ``limit`` bytes."""
    full = placed.where(F.octet_length("value") > 0)
    first = full.agg(F.min("partition_id").alias("p")).first().p
    rows = full.where(F.col("partition_id") == F.lit(first)).withColumn("length", F.octet_length("value").cast("long"))
    return snapshot.sample_prefix(rows, [H.unsigned_order(F.col("fp")), F.col("key")], limit, H.radix_bucket(F.col("fp"), S.RADIX_BUCKETS))


def dictionary_of(placed: DataFrame, limit: int = codec.SAMPLE_BYTES) -> tuple[bytes | None, dict]:
    """A dictionary trained on the sample, and the sample's raw and stored bytes."""
    values = [bytes(r.value) for r in first_sample(placed, limit).select("value").toLocalIterator()]
    dictionary = codec.train_dictionary(values)
    stored = 0
    if values:
        c = codec._compressor(dictionary, codec.LEVEL)
        stored = sum(min(len(v), len(c.compress(v)) if len(v) >= codec.LEAST_BYTES else len(v)) for v in values)
    return dictionary, {"values": len(values), "raw_bytes": sum(map(len, values)), "stored_bytes": stored}


def build_stats(rows: DataFrame) -> DataFrame:
    """Per partition and in all (``partition_id`` null): keys, stubs, compressed and raw records, raw and stored bytes, and blocks' payload.

    ``rows(partition_id, value, compressed, raw_length)``.
    """
    size = F.octet_length("value").cast("long")
    return rows.rollup("partition_id").agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("compressed")).alias("n_compressed"), F.count_if(~F.col("compressed")).alias("n_raw"),
        F.coalesce(F.sum("raw_length"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum(size), F.lit(0)).alias("stored_bytes"),
        F.count_if(size > S.MIN_BLOCK // 2).alias("stubs"), F.coalesce(F.sum(S.encoded_length(F.least(size, F.lit(S.MIN_BLOCK // 2)))), F.lit(0)).alias("block_bytes"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = snapshot._fs(spark, path)
    return fs.exists(p)


def _bytes_at(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = snapshot._fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def build(
    pairs: DataFrame, root: str, n: int = 64, version: int = 5, compression: str = "none", on_duplicate: str = "error", order: list | None = None,
    encoding: dict | None = None, marker: str = "rename", progress: Callable[[Progress], None] | None = None, sample_bytes: int = codec.SAMPLE_BYTES,
) -> dict:
    """Build ``pairs(key, value)`` of bytes into ``root`` and publish its manifest, which is returned.

    Phases that have left their mark are not run again, so a build that broke off
    goes on where it was; a published snapshot is left as it is.  ``progress`` is
    called after each phase.
    """
    spark, form = pairs.sparkSession, FORMATS[version]
    compression = form.compression(compression)
    if (done := snapshot._read_text(spark, f"{root}/{snapshot.MANIFEST}")) is not None:
        return json.loads(done)
    told = progress or (lambda p: None)

    began = time.monotonic()
    placed = layout.addressed(pairs, n, version)
    plan, skipped = snapshot._read_text(spark, f"{root}/plan.json"), True
    if plan is None:
        skipped, dictionary, sample = False, None, None
        if compression == "zstd-dict":
            dictionary, sample = dictionary_of(placed, sample_bytes)
            if dictionary:
                _write_bytes(spark, f"{root}/dict.bin", dictionary)  # before the plan names it
        plan = json.dumps({"n_partitions": n, "compression": compression, "sample": sample, "dictionary": hashlib.sha256(dictionary).hexdigest() if dictionary else None})
        snapshot.publish(spark, f"{root}/plan.json", plan, marker)
    plan = json.loads(plan)
    if plan["n_partitions"] != n or plan["compression"] != compression:
        raise SnapshotError(f"{root} was begun with another plan: {plan}")
    told(Progress("plan", 0, 0, time.monotonic() - began, skipped))

    began, skipped = time.monotonic(), _exists(spark, f"{root}/data/_SUCCESS")
    if not skipped:
        dictionary = _dictionary(spark, root, plan)
        rows = snapshot.unique(placed, on_duplicate, order, n)
        if compression == "none":
            rows = rows.withColumn("compressed", F.lit(False))
        else:
            rows = rows.withColumn("c", codec.compress(F.col("value"), dictionary)).withColumns({"raw": F.octet_length("value").cast("long")})
        raw = F.octet_length("value").cast("long") if compression == "none" else F.col("raw")
        value, flag = (F.col("value"), F.col("compressed")) if compression == "none" else (F.col("c.stored"), F.col("c.compressed"))
        rows = rows.select("key", value.alias("value"), flag.alias("compressed"), raw.alias("raw_length"), "fp", "vfp", "partition_id")
        rows.write.mode("overwrite").partitionBy("partition_id").parquet(f"{root}/data")
    data = _data(spark, root)
    stats = build_stats(data).collect()
    total = next(s for s in stats if s.partition_id is None) if any(s.partition_id is None for s in stats) else None
    per = sorted((s for s in stats if s.partition_id is not None), key=lambda s: s.partition_id)
    told(Progress("data", total.n_keys if total else 0, total.stored_bytes if total else 0, time.monotonic() - began, skipped))

    began, skipped = time.monotonic(), _exists(spark, f"{root}/filters/_SUCCESS")
    largest = max((s.n_keys for s in per), default=0)
    buckets = _buckets_for(largest)
    if not skipped:
        partition_filters(data, buckets).write.mode("overwrite").parquet(f"{root}/filters")
    told(Progress("filters", total.n_keys if total else 0, 0, time.monotonic() - began, skipped))

    names = ["n_keys", "n_compressed", "n_raw", "raw_bytes", "stored_bytes", "stubs", "block_bytes"]
    meta = {
        "version": snapshot.VERSION, "format": version, "n_partitions": n, "verify_seed": str(H.VERIFY_SEED), "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "encoding": encoding or {"raw": {}}, "compression": compression, "dictionary": plan["dictionary"], "sample": plan["sample"], "filter_buckets": buckets,
        "stats": {x: total[x] if total else 0 for x in names}, "partitions": [{"id": s.partition_id, **{x: s[x] for x in names}} for s in per],
    }
    snapshot.publish(spark, f"{root}/{snapshot.MANIFEST}", json.dumps(meta), marker)
    return meta


def with_descriptor(spark: SparkSession, root: str, descriptor: bytes, message: str) -> dict:
    """Put a message descriptor into a published manifest that has none or another."""
    meta = snapshot.describe(spark, root)
    meta["encoding"] = {"protobuf": {"descriptor": base64.b64encode(descriptor).decode(), "message_name": message}}
    snapshot.publish(spark, f"{root}/{snapshot.MANIFEST}", json.dumps(meta), "direct")
    return meta


DATA_SCHEMA = "key binary, value binary, compressed boolean, raw_length long, fp long, vfp long, partition_id int"


def _data(spark: SparkSession, root: str) -> DataFrame:
    if not snapshot._has_rows(spark, root):
        return spark.createDataFrame([], DATA_SCHEMA)
    return spark.read.schema(DATA_SCHEMA).parquet(f"{root}/data")


def _dictionary(spark: SparkSession, root: str, plan: dict) -> bytes | None:
    if not plan.get("dictionary"):
        return None
    try:
        data = _bytes_at(spark, f"{root}/dict.bin")
    except Exception as e:
        raise SnapshotError(f"{root}: the dictionary is missing") from e
    if hashlib.sha256(data).hexdigest() != plan["dictionary"]:
        raise SnapshotError(f"{root}: damaged dictionary")
    return data


# ------------------------------------------------------------------ reading


class Lookup:
    """Answers keys from one stored snapshot.  ``LookupFactory`` makes them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.meta = snapshot.describe(spark, root)
        self.n, self.buckets = self.meta["n_partitions"], self.meta.get("filter_buckets", 1)
        self.dictionary = _dictionary(spark, root, self.meta)
        self.data = _data(spark, root)
        self.filters = spark.read.schema(FILTER_SCHEMA).parquet(f"{root}/filters") if self.meta["partitions"] else spark.createDataFrame([], FILTER_SCHEMA)

    def probes(self, requests: DataFrame) -> DataFrame:
        """Distinct keys with partition and fingerprint."""
        keys = requests.select(F.col("key").cast("binary").alias("key")).distinct().withColumn("fp", H.fingerprint(F.col("key")))
        return keys.withColumn("partition_id", H.partition_of(F.col("fp"), self.n))

    def get(self, requests: DataFrame) -> DataFrame:
        """``key, status, value`` for each row of ``requests(key)``: hit, miss (settled by a filter) or miss_io (read in vain).

        The filters' survivors are counted: few are pushed into the scan as
        partitions and fingerprints, some are broadcast, many are joined by shuffle.
        """
        asked = self.probes(requests)
        live = filtered(asked, self.filters, self.buckets).persist()
        n = live.limit(BROADCAST_KEYS + 1).count()
        data = self.data.select("partition_id", "fp", "key", "value", "compressed")
        if n <= PUSHED_KEYS:
            wanted = live.select("partition_id", "fp").collect()
            data = data.where(F.col("partition_id").isin(sorted({w.partition_id for w in wanted}))).where(F.col("fp").isin(sorted({w.fp for w in wanted})))
        side = F.broadcast(live) if n <= BROADCAST_KEYS else live
        read = data.join(side.select("partition_id", "fp", "key"), ["partition_id", "fp", "key"])
        value = codec.decompress(F.col("value"), F.col("compressed"), self.dictionary) if self.meta.get("compression", "none") != "none" else F.col("value")
        found = read.select("key", value.alias("value"), F.lit(True).alias("found"))
        settled = live.select("key", F.lit(True).alias("passed")).join(found, "key", "left")
        status = F.when(F.col("found"), "hit").when(F.col("passed"), "miss_io").otherwise("miss")
        rows = requests.select(F.col("key").cast("binary").alias("key"))
        return rows.join(settled, "key", "left").select("key", status.alias("status"), "value")

    def get_one(self, key: bytes) -> tuple[str, bytes | None]:
        row = self.get(self.spark.createDataFrame([(bytearray(key),)], "key binary")).first()
        return row.status, None if row.value is None else bytes(row.value)

    def scan(self) -> DataFrame:
        """All ``key, value`` pairs."""
        value = codec.decompress(F.col("value"), F.col("compressed"), self.dictionary) if self.meta.get("compression", "none") != "none" else F.col("value")
        return self.data.select("key", value.alias("value"))


class LookupFactory:
    """Lookups by dataset; each snapshot is opened once."""

    def __init__(self, spark: SparkSession, roots: dict[str, str]):
        self.spark, self.roots, self._open = spark, roots, {}

    def lookup(self, dataset: str) -> Lookup:
        if dataset not in self._open:
            self._open[dataset] = Lookup(self.spark, self.roots[dataset])
        return self._open[dataset]
