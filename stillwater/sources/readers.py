"""Scans: CSV in its four forms, tables, unions, row caps, and what a source costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that schema inference looks at.
INFER_ROWS = 100


def _infer(spark: SparkSession, lines: list[str]) -> T.StructType:
    """Schema of the header and the first rows."""
    return spark.read.csv(spark.sparkContext.parallelize(lines, 1), header=True, inferSchema=True).schema


def csv_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header.  Without a schema it is inferred from the first 100 rows; a later row that does not fit is an error."""
    if schema is None:
        head = [r.value for r in spark.read.text(path).limit(INFER_ROWS + 1).collect()]
        schema = _infer(spark, head) if head else T.StructType()
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", encoding=encoding)


def csv_text(spark: SparkSession, text: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Inline CSV, or the content of a reader such as standard input."""
    lines = text.splitlines()
    if schema is None:
        schema = _infer(spark, lines[: INFER_ROWS + 1])
    return spark.read.csv(spark.sparkContext.parallelize(lines), header=True, schema=schema, mode="FAILFAST")


def csv_reader(spark: SparkSession, stream, schema: T.StructType | str | None = None) -> DataFrame:
    return csv_text(spark, stream.read(), schema)


def table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A warehouse table: projection and restriction reach the scan, one task per split."""
    df = spark.read.format(fmt).options(**options).load(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def pairs(spark: SparkSession, rows: list[tuple[bytes, bytes]]) -> DataFrame:
    return spark.createDataFrame(rows, "key binary, value binary")


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of several sources of equal columns, as one scan."""
    return reduce(DataFrame.unionByName, frames)


def capped(frames: list[DataFrame], n: int) -> DataFrame:
    """Any ``n`` rows over all sources together."""
    return union(frames).limit(n)


def from_config(spark: SparkSession, source: dict) -> DataFrame:
    """``{"csv": {"path" | "data"}}`` or ``{"table": {"path", ...}}``; exactly one."""
    if len(source) != 1:
        raise ValueError("exactly one source is required")
    (kind, options), = source.items()
    if kind == "csv":
        schema = options.get("schema")
        if "data" in options:
            return csv_text(spark, options["data"], schema)
        return csv_file(spark, options["path"], schema)
    if kind == "table":
        return table(spark, options["path"], options.get("columns"), options.get("where"), options.get("format", "parquet"))
    raise ValueError(f"unknown source {kind}")


def estimated(df: DataFrame, limit: int | None = None) -> tuple[int | None, int | None]:
    """Rows (clamped by a cap) and bytes as the optimizer knows them; None if unknown."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    n = int(str(rows.get())) if rows.isDefined() else None
    if limit is not None and n is not None:
        n = min(n, limit)
    size = int(str(stats.sizeInBytes()))
    return n, size if size < 1 << 62 else None


def drain(pairs: DataFrame) -> dict[str, int]:
    """Reads everything, keeps nothing: keys and bytes."""
    seen = Observation()
    pairs.observe(
        seen, F.count("*").alias("keys"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).alias("bytes")
    ).write.format("noop").mode("overwrite").save()
    return dict(seen.get)
