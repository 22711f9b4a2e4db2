"""Value codecs: zstandard frames and protobuf messages, as Arrow-batched functions."""

from __future__ import annotations

import base64
import io
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the compressed format.
LEVEL, LEAST_BYTES, MAX_CONTENT = 3, 64, (1 << 30) - 1
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 64 << 20


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary of the samples, or None if there are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return None


def _compressor(dictionary: bytes | None, level: int):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=True, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes | None):
    import zstandard

    return zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def compress(value: Column, dictionary: bytes | None = None, level: int = LEVEL, least: int = LEAST_BYTES) -> Column:
    """``struct(stored, compressed)``: the frame if strictly smaller, else the value as it is."""

    @F.pandas_udf("stored binary, compressed boolean")
    def run(batches: "pd.Series") -> pd.DataFrame:
        c = _compressor(dictionary, level)
        stored, flags = [], []
        for v in batches:
            packed = c.compress(bytes(v)) if v is not None and len(v) >= least else None
            use = packed is not None and len(packed) < len(v)
            stored.append(packed if use else v)
            flags.append(use)
        return pd.DataFrame({"stored": stored, "compressed": flags})

    return run(value.cast("binary"))


def frame_content_size(frame: bytes) -> int | None:
    """Content size in the header of a frame without magic number (RFC 8878, 3.1.1.1); None if absent."""
    if not frame:
        raise ValueError("empty frame")
    d = frame[0]
    if d & 8:
        raise ValueError("reserved bit set in the frame header")
    single, flag = d >> 5 & 1, d >> 6
    size = (1 if single else 0) if flag == 0 else 1 << flag
    at = 1 + (0 if single else 1) + (0, 1, 2, 4)[d & 3]
    if size == 0:
        return None
    if len(frame) < at + size:
        raise ValueError("truncated frame header")
    n = int.from_bytes(frame[at : at + size], "little")
    return n + 256 if size == 2 else n


def expand(stored: bytes, decompressor) -> bytes:
    n = frame_content_size(stored)
    if n is None or n > MAX_CONTENT:
        raise ValueError(f"frame of {n} bytes is over the limit or unsized")
    if n == 0:
        return b""
    out = decompressor.decompress(stored, max_output_size=n)
    if len(out) != n:
        raise ValueError("frame is shorter than its header says")
    return out


def decompress(stored: Column, compressed: Column, dictionary: bytes | None = None) -> Column:
    """The value; a damaged frame is an error, never a null."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, flags: pd.Series) -> pd.Series:
        d = _decompressor(dictionary)
        return pd.Series([expand(bytes(v), d) if f else v for v, f in zip(data, flags)])

    return run(stored, compressed)


# ------------------------------------------------------------------ protobuf

# Scalar field types of descriptors by Spark type.
_FIELD = {"string": 9, "binary": 12, "int": 5, "bigint": 3, "smallint": 5, "tinyint": 5, "double": 1, "float": 2, "boolean": 8}
_TIMESTAMP = ".google.protobuf.Timestamp"


def file_descriptor(fields: list[tuple[str, str]], package: str, message: str) -> bytes:
    """Serialized descriptor set of a proto3 message with optional fields in column order."""
    from google.protobuf import descriptor_pb2, timestamp_pb2

    if not package:
        raise ValueError("a package is required to generate a descriptor")
    f = descriptor_pb2.FileDescriptorProto(name=f"{message}.proto", package=package, syntax="proto3")
    m = f.message_type.add(name=message)
    for k, (name, kind) in enumerate(fields):
        field = m.field.add(name=name, number=k + 1, label=1, json_name=name, proto3_optional=True, oneof_index=k)
        if kind == "timestamp":
            field.type, field.type_name = 11, _TIMESTAMP
        elif kind in _FIELD:
            field.type = _FIELD[kind]
        else:
            raise ValueError(f"column {name}: type {kind} has no message field")
        m.oneof_decl.add(name=f"_{name}")
    out = descriptor_pb2.FileDescriptorSet()
    if any(kind == "timestamp" for _, kind in fields):
        f.dependency.append("google/protobuf/timestamp.proto")
        timestamp_pb2.DESCRIPTOR.CopyToProto(out.file.add())
    out.file.append(f)
    return out.SerializeToString()


def message_class(descriptor: bytes, name: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptor).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))


def encode_message(columns: list[Column], names: list[str], descriptor: bytes, message: str) -> Column:
    """Columns to message bytes; nulls leave the field unset."""

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.DataFrame) -> pd.Series:
        cls, out = message_class(descriptor, message), []
        for row in rows.itertuples(index=False):
            m = cls()
            for name, v in zip(names, row):
                if v is None or v is pd.NaT or (isinstance(v, float) and v != v and rows[name].dtype == object):
                    continue
                if isinstance(v, pd.Timestamp):
                    getattr(m, name).FromDatetime(v.to_pydatetime())
                else:
                    setattr(m, name, bytes(v) if isinstance(v, (bytearray, memoryview)) else v.item() if hasattr(v, "item") else v)
            out.append(m.SerializeToString(deterministic=True))
        return pd.Series(out, dtype=object)

    return run(F.struct(*[c.alias(n) for c, n in zip(columns, names)]))


def decode_message(value: Column, descriptor: bytes, message: str, numbers: bool = True) -> Column:
    """Message bytes to JSON; ``numbers`` writes 64-bit integers as numbers, else as strings."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        from google.protobuf import json_format
        from google.protobuf.descriptor import FieldDescriptor

        cls, out = message_class(descriptor, message), []
        for v in values:
            if v is None:
                out.append(None)
                continue
            m = cls.FromString(bytes(v))
            d = json.loads(json_format.MessageToJson(m, preserving_proto_field_name=True))
            if numbers:
                for f in m.DESCRIPTOR.fields:
                    if f.name in d and f.cpp_type in (FieldDescriptor.CPPTYPE_INT64, FieldDescriptor.CPPTYPE_UINT64):
                        d[f.name] = int(d[f.name])
            out.append(json.dumps(d, separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return run(value)


def resolve_descriptor(fields: list[tuple[str, str]], package: str | None, message: str, inline: str | None = None) -> tuple[bytes, str]:
    """An inline base64 descriptor, or one generated from the columns; not both a package and an inline one."""
    if inline is not None:
        if package:
            raise ValueError("give an inline descriptor or a package, not both")
        return base64.b64decode(inline, validate=True), message
    return file_descriptor(fields, package or "", message), f"{package}.{message}"


@F.pandas_udf(T.StringType())
def hex_dump(values: pd.Series) -> pd.Series:
    """Canonical dump: offset, sixteen bytes in two groups, text column."""
    def dump(v):
        if v is None:
            return None
        out = io.StringIO()
        for at in range(0, len(v), 16):
            part = bytes(v[at : at + 16])
            cells = [f"{b:02x}" for b in part] + ["  "] * (16 - len(part))
            shown = "".join(chr(b) if 32 <= b < 127 else "." for b in part)
            out.write(f"{at:08x}  {' '.join(cells[:8])}  {' '.join(cells[8:])}  |{shown}|\n")
        return out.getvalue()

    return values.map(dump)


def manifest_field(meta: Column, *paths: str, default=""):
    """The first of some JSON paths that a manifest's text has, else ``default``; damaged text has none."""
    found = F.coalesce(*[F.get_json_object(meta, p) for p in paths])
    return F.coalesce(found.cast("long") if isinstance(default, int) else found, F.lit(default))


def base64_text(data: Column) -> Column:
    """Standard base64 of bytes, without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")
