"""A snapshot as a Spark data source: ``spark.read.format("kv_snapshot").load(root)``.

For readers that know nothing of this package's functions; it refuses a snapshot
without a manifest, and every data file is one input partition.
"""

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class DataFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SnapshotReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        from pyarrow import fs

        files, at = _open(self.root)
        with files.open_input_file(f"{at}/meta.json") as f:
            meta = json.loads(f.read())
        if not meta["partitions"]:
            return []
        found = files.get_file_info(fs.FileSelector(f"{at}/data", recursive=True))
        return [DataFile(i.path) for i in found if i.is_file and i.path.endswith(".parquet")]

    def read(self, partition):
        import pyarrow.parquet as pq

        if partition is None:
            return
        files, _ = _open(self.root)
        with files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["key", "value"]):
                yield from zip(batch.column("key").to_pylist(), batch.column("value").to_pylist())


class SnapshotSource(DataSource):
    @classmethod
    def name(cls):
        return "kv_snapshot"

    def schema(self):
        return "key binary, value binary"

    def reader(self, schema):
        return SnapshotReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSource)
