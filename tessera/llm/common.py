"""What the operators share: tables in the cluster's shared folder, row ids and word rules."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import as_local, hadoop_path, workspace

#: ASCII white space: the separators of the word rule ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` uses the same set.
SPACES = b" \t\n\v\f\r"


class Scratch:
    """Tables of one query in the shared folder; writing one cuts the lineage and survives lost executors.

    What is not dropped before goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, workspace(spark, name)
        self.made = 0

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and read it again."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.tessera_path = path
        return out

    def local(self, name: str) -> str:
        """A folder under the same root for files that tasks open by their path: the shared folder must be mounted on all machines."""
        path = f"{as_local(self.root)}/{name}"
        os.makedirs(path)
        return path

    def drop_local(self, name: str) -> None:
        place, files = hadoop_path(self.spark, f"{self.root}/{name}")
        files.delete(place, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of what has been written: they go when the driver's JVM collects garbage."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)  # files are removed by a thread of their own

    def drop(self, df: DataFrame) -> None:
        """Remove a table that is not read any more."""
        path = getattr(df, "tessera_path", None)
        if path:
            place, files = hadoop_path(self.spark, path)
            files.delete(place, True)


def slices(batch: pa.RecordBatch, column: int = 0, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of one column, a row at least."""
    length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def held(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``rest``; a null id counts as the text ``''``."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % mod == rest


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case-insensitively)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out
