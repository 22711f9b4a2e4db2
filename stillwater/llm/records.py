"""Token ids in length-delimited binary record files with a separate offset index.

A record file is a run of frames::

    u64 payload length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload

and a payload is ``i64 document id | u32 bytes per id | ids``, all little-endian.
The checksum is CRC-32, masked as ``rotate right 15, add 0xa282ead8``, so that a
checksum stored inside checked data does not check itself.  The index file has
``i64 document id | u64 frame offset | u64 frame length`` per record, so a
shuffled reader seeks to any record without reading the file.

Files go to the shared folder under a name that is unique to the task attempt;
the manifest, written by Spark's own committer, names the files of the attempts
that counted, so a lost executor or a second attempt leaves at worst an orphan.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded_blocks
from .common import Scratch

#: Bytes after which a new part of a file is listed in the manifest; parts are read in parallel.
PART_BYTES = 8 << 20
NULL_ID = -(1 << 63)
_FRAME, _HEAD, _INDEX = struct.Struct("<QI"), struct.Struct("<qI"), struct.Struct("<qQQ")
MANIFEST = "first_id long, path string, index_path string, start_byte long, end_byte long, n_records long, n_ids long, ids_before long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = _HEAD.pack(NULL_ID if doc_id is None else doc_id, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def index_entry(doc_id: int | None, offset: int, length: int) -> bytes:
    return _INDEX.pack(NULL_ID if doc_id is None else doc_id, offset, length)


class CorruptRecord(ValueError):
    """A frame's length or checksum is wrong."""


def read_frame(buffer: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """Document id, ids and the offset of the next frame; raises ``CorruptRecord``."""
    if at + _FRAME.size > len(buffer):
        raise CorruptRecord("truncated length")
    size, check = _FRAME.unpack_from(buffer, at)
    if masked(buffer[at : at + 8]) != check:
        raise CorruptRecord("length checksum")
    a, b = at + _FRAME.size, at + _FRAME.size + size
    if b + 4 > len(buffer) or size < _HEAD.size:
        raise CorruptRecord("truncated payload")
    payload = buffer[a:b]
    if masked(payload) != struct.unpack_from("<I", buffer, b)[0]:
        raise CorruptRecord("payload checksum")
    doc_id, width = _HEAD.unpack_from(payload)
    return None if doc_id == NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size), b + 4


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _writer(folder: str, path: str, end_id: int):
    def run(batches):
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        out = index = None
        at = start = n_records = n_ids = first = before = 0
        parts = []
        name = f"{folder}/{uuid.uuid4().hex}"
        for batch, a, b, encoded, enc in encoded_blocks(batches, path):
            tail = np.array([end_id], enc.dtype).tobytes()
            ids = batch.column(0).slice(a, b - a).to_pylist()
            if out is None:
                out = files.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}.rec")
                index = files.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}.idx")
            for doc_id, text_ids in zip(ids, encoded):
                data = frame(doc_id, text_ids + tail, enc.width)
                if n_records == 0:
                    first = NULL_ID if doc_id is None else doc_id
                out.write(data)
                index.write(index_entry(doc_id, at, len(data)))
                at, n_records, n_ids = at + len(data), n_records + 1, n_ids + len(text_ids) // enc.width + 1
                if at - start >= PART_BYTES:
                    parts.append((first, f"{name}.rec", f"{name}.idx", start, at, n_records, n_ids, before))
                    start, n_records, n_ids, before = at, 0, 0, before + n_ids
        if out is not None:
            out.close()
            index.close()
            if n_records:
                parts.append((first, f"{name}.rec", f"{name}.idx", start, at, n_records, n_ids, before))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts)], ["first_id", "path", "index_path", "start_byte", "end_byte", "n_records", "n_ids", "ids_before"])

    return run


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all texts in ascending id order; returns the lazy manifest.

    Range-partitioned by id, sorted within the partition, one file per task.
    Null texts are empty (the end id alone); null ids come first; repeated rows
    are repeated records.  Store the manifest before reading it more than once.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange(n, "id").sortWithinPartitions("id")
    return ordered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST)


def _reader(batches):
    for batch in batches:
        for path, start_byte, end_byte, start in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            files, at = open_folder(path)
            with files.open_input_file(at) as f:
                data = f.read_at(end_byte - start_byte, start_byte)
            rows, pos = [], 0
            while pos < len(data):
                doc_id, ids, pos = read_frame(data, pos)
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "start", "n_tokens", "ids_crc32"]
            )


def read_records(manifest: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` per record, read from the files with every checksum tested.

    The driver adds up one total per file, that is per shuffle partition of the
    writer; where a part starts in its file the manifest says.
    """
    spark = manifest.sparkSession
    files = manifest.groupBy("path").agg(F.min("first_id").alias("first_id"), F.sum("n_ids").alias("n_ids")).collect()
    base, start = [], 0
    for f in sorted(files, key=lambda f: (f.first_id, f.path)):
        base.append((f.path, start))
        start += f.n_ids
    table = manifest.join(F.broadcast(spark.createDataFrame(base, "path string, base long")), "path")
    table = table.select("path", "start_byte", "end_byte", (F.col("base") + F.col("ids_before")).alias("start"))
    return table.repartition(F.col("path"), F.col("start_byte")).mapInArrow(_reader, "id long, start long, n_tokens long, ids_crc32 long")


def shuffled_read(path: str, index_path: str, seed: int):
    """Records of one file in a random order, by its offset index."""
    files, at = open_folder(index_path)
    with files.open_input_file(at) as f:
        entries = list(_INDEX.iter_unpack(f.read()))
    files, at = open_folder(path)
    with files.open_input_file(at) as f:
        for k in np.random.default_rng(seed).permutation(len(entries)):
            _, offset, length = entries[k]
            doc_id, ids, _ = read_frame(f.read_at(length, offset))
            yield doc_id, ids


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the records to the shared folder and read them back: ``id_col, start, n_tokens, ids_crc32``.

    Rows of one id (ties) follow each other in no stated order; other columns are
    ignored, whatever their names; a very long text is one record.
    """
    scratch = Scratch(docs.sparkSession, "records")
    manifest = scratch.save(write_records(docs, tokenizer, scratch.path("files"), end_id, id_col, text_col), "manifest")
    return read_records(manifest).withColumnRenamed("id", id_col)
