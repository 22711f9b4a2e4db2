"""From a table to key-value pairs: column binding, key text, null and size rules."""

from __future__ import annotations

import base64
import json
import logging
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..functions.sizes import MAX_LENGTH_V5, MAX_VALUE
from ..functions.text import key_preview
from . import readers

log = logging.getLogger(__name__)


class SchemaError(ValueError):
    """A column is missing or of a type that cannot be a key or value."""


KEY_TYPES = (T.BinaryType, T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def key_bytes(df: DataFrame, column: str) -> Column:
    """Key column as bytes; integers as decimal text without padding."""
    kind = _type(df, column)
    if isinstance(kind, T.BinaryType):
        return F.col(f"`{column}`")
    if isinstance(kind, KEY_TYPES) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        # an unsigned 64-bit source column arrives as decimal(20,0)
        return F.col(f"`{column}`").cast("string").cast("binary")
    raise SchemaError(f"column {column}: type {kind.simpleString()} cannot be a key")


def raw_value(df: DataFrame, column: str) -> Column:
    """Value column as bytes; null becomes empty."""
    kind = _type(df, column)
    if isinstance(kind, (T.BinaryType, T.StringType)):
        return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))
    raise SchemaError(f"column {column}: type {kind.simpleString()} cannot be a raw value")


def _type(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise SchemaError(f"no column {column}; there are {', '.join(df.columns)}")
    return df.schema[column].dataType


def checked(kv: DataFrame, max_value: int = MAX_VALUE, version: int = 5) -> DataFrame:
    """Pairs that raise when read if a key is null or a value too long (a length equal to the limit passes)."""
    limit = min(max_value, MAX_LENGTH_V5) if version == 5 else max_value
    size = F.octet_length("value")
    return kv.select(
        F.when(F.col("key").isNull(), F.raise_error("null key")).otherwise(F.col("key")).alias("key"),
        F.when(size > limit, F.raise_error(F.format_string(f"value of %d bytes is over {limit} for key %s", size, key_preview(F.col("key")))))
        .otherwise(F.col("value")).alias("value"),
    )


def oversized(kv: DataFrame, max_value: int) -> DataFrame:
    """The pairs that ``checked`` would reject, with a preview of the key."""
    size = F.octet_length("value").cast("long")
    return kv.where(size > max_value).select(key_preview(F.col("key")).alias("key_preview"), size.alias("value_length"))


@dataclass
class LoadSpec:
    """What to read, how to bind it, and how to lay it out."""

    source: dict
    key: str = "key"
    value: str = "value"
    encoding: str = "raw"
    package: str | None = None
    message: str = "Row"
    descriptor: str | None = None
    include_key: bool = False
    columns: list[str] = field(default_factory=list)
    where: str | None = None
    limit: int | None = None
    output: str | None = None
    partitions: int = 64
    index_parallelism: int = 2
    max_value: int = MAX_VALUE
    version: int = 5
    compression: str = "none"

    @classmethod
    def from_json(cls, text: str) -> "LoadSpec":
        """From a configuration; unknown fields are errors, and knobs without effect are logged."""
        raw = json.loads(text)
        if "source" not in raw:
            raise ValueError("a source is required")
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        spec = cls(**raw)
        for w in spec.warnings():
            log.warning(w)
        return spec

    def warnings(self) -> list[str]:
        out = []
        if self.version == 4 and self.compression != "none":
            out.append("compression has no effect on version 4")
        if self.encoding == "raw" and self.include_key:
            out.append("include_key has no effect on raw values")
        if self.encoding == "raw" and (self.package or self.descriptor):
            out.append("package and descriptor have no effect on raw values")
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """The source with projection, restriction and row cap; nothing runs."""
        df = readers.from_config(spark, self.source)
        if self.where:
            df = df.where(self.where)
        if self.columns:
            df = df.select(*dict.fromkeys([self.key, *self.columns]))
        return df if self.limit is None else df.limit(self.limit)

    def pairs(self, spark: SparkSession) -> DataFrame:
        return to_pairs(self.frame(spark), self)

    def load(self, spark: SparkSession, progress=None) -> dict:
        """Read, encode and publish a snapshot at ``output``; returns its manifest.

        ``partitions``, ``version`` and ``compression`` shape it; a descriptor goes
        into the manifest.  ``index_parallelism`` has no effect: Spark schedules
        the filters' stage.
        """
        from ..operators import store

        if not self.output:
            raise ValueError("an output is required")
        df = self.frame(spark)
        encoding = None
        if self.encoding == "protobuf":
            descriptor, message = _descriptor(df, self)
            encoding = {"protobuf": {"descriptor": base64.b64encode(descriptor).decode(), "message_name": message}}
        return store.build(to_pairs(df, self), self.output, self.partitions, self.version, self.compression, encoding=encoding, progress=progress)

    def dry_run(self, spark: SparkSession) -> T.StructType:
        """Binds everything and reads no row."""
        return self.pairs(spark).schema


def value_columns(df: DataFrame, key: str, include_key: bool = False) -> list[str]:
    return [c for c in df.columns if include_key or c != key]


def _descriptor(df: DataFrame, spec: "LoadSpec") -> tuple[bytes, str]:
    fields = [(c, df.schema[c].dataType.simpleString()) for c in value_columns(df, spec.key, spec.include_key)]
    return codec.resolve_descriptor(fields, spec.package, spec.message, spec.descriptor)


def _raw(df: DataFrame, spec: "LoadSpec") -> Column:
    return raw_value(df, spec.value)


def _protobuf(df: DataFrame, spec: "LoadSpec") -> Column:
    names = value_columns(df, spec.key, spec.include_key)
    return codec.encode_message([F.col(f"`{c}`") for c in names], names, *_descriptor(df, spec))


#: Value encodings by name; a function of the table and the specification gives the value column.
ENCODERS = {"raw": _raw, "protobuf": _protobuf}


def to_pairs(df: DataFrame, spec: LoadSpec) -> DataFrame:
    """``key, value`` under the spec's encoding and checks."""
    key = key_bytes(df, spec.key)
    if spec.encoding not in ENCODERS:
        raise ValueError(f"unknown encoding {spec.encoding}")
    value = ENCODERS[spec.encoding](df, spec)
    return checked(df.select(key.alias("key"), value.alias("value")), spec.max_value, spec.version)


def parse_table(name: str, project: str | None = None) -> tuple[str, str]:
    """Project to bill and full resource name of a warehouse table."""
    if name.startswith("projects/"):
        own = name.split("/")[1]
        if not own:
            raise ValueError("expected projects/P/datasets/D/tables/T")
        return project or own, name
    m = re.fullmatch(r"([^.]*)\.([^.]*)\.(.*)", name, re.S)
    if not m:
        raise ValueError("expected project.dataset.table or projects/P/datasets/D/tables/T")
    return project or m[1], f"projects/{m[1]}/datasets/{m[2]}/tables/{m[3]}"
