"""Shared pieces: tables in the shared folder, and numpy kernels over UTF-8 text.

The kernels work on the concatenated bytes of a block of texts, so they cost a
few array operations per byte rather than Python work per word.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent on a local master (tests, a laptop) a temporary
    folder is made and set, and removed when Python ends; on a cluster that is an
    error, as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="stillwater-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors."""

    #: All folders made and not removed in this process, oldest first.
    made: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        Scratch.made.append(self)

    def remove(self) -> None:
        """Delete the whole folder; no result that is still to be read may rest on it."""
        remove_path(self.spark, self.root)
        Scratch.made.remove(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd", few: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back.

        ``few``: in fewer files than shuffle partitions, for tables of a few bytes
        per document; their last stage runs in so few tasks, so never where it
        reads texts.
        """
        at = self.path(name)
        if few:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        df.write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        return out

    def release(self) -> None:
        """Collect the driver's garbage, for jobs of very many queries.

        The shuffles and broadcasts of tables that are written stay, on the driver, the
        executors and their disks, until the driver happens to collect.
        """
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            remove_path(self.spark, t.scratch_path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def id_remainder(col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(col).cast("string")) % F.lit(modulus)


# ------------------------------------------------------------------ Arrow helpers

#: Text bytes that one block of numpy work takes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_blocks(batches, text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, bytes, offsets from 0) for blocks of each Arrow batch."""
    for batch in batches:
        raw, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        for a, b in blocks(off, size):
            yield batch, a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
    pa.default_memory_pool().release_unused()  # the worker lives on


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


# ------------------------------------------------------------------ byte classes

#: Words of contracts over white space: anything but \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ------------------------------------------------------------------ hashing

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** t and its inverse for t < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class RollingHash:
    """Hashes of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.asarray(start), np.asarray(end)
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, and n+1 word offsets of the texts."""
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space word (A-Z lower-cased) and n+1 word offsets."""
    if lower:
        data = LOWER[data]
    starts, ends, per = word_bounds(data, offsets, NOT_SPACE)
    return RollingHash(data).span(starts, ends), per


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words, per = word_hashes(data, offsets)
    step = np.uint64(0xA0761D6478BD642F)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled = rolled * step + words[j : j + len(rolled)]
    rolled = mix(rolled + np.uint64(width))
    out = []
    for a, b in zip(per[:-1], per[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * step + w
                out.append(mix(np.array([h + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
