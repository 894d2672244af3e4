"""Splitting reads as their files arrive: a Structured Streaming query over a folder.

The probe strategy decides each record where it lies, so the stream needs no state, shuffle or watermark. ``availableNow``
handles what is there and ends; checkpoints make each file count once. Batches hold whole files, so pairs can
be decided within a batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tessera.operators import coverage
from tessera.operators.index import Index
from tessera.sources.published import PublishedIndex
from tessera.sources import compressed
from tessera.sources.sequences import FASTQ_SCHEMA, SPLIT, FileRange, fastq_batches
from tessera.sources.shared import as_local

READ_SCHEMA = FASTQ_SCHEMA
#: Files of a full batch for each task, on average (large files are several ranges).
TASK_FILES = 4


def read_fastq_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, **options) -> DataFrame:
    """Records of the FASTQ files that arrive in a folder (see :mod:`tessera.sources.sequences` for the options; ``split``: bytes of a range).

    Which files came is kept by Spark's file source in the query's checkpoint, by their names: files that are moved in late, with older or equal times, are taken too, and a
    batch has ``files_per_batch`` files at most. What the source hands on is names and sizes; ranges of them are dealt out and read in tasks, which open the files (a mounted
    store). The bytes of each batch are observed as ``input``. Files are to be moved in whole.
    """
    step = int(options.get("split", SPLIT)) or 1 << 62
    options = {k: str(v) for k, v in options.items()}
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").load(path).select("path", "length")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step))).alias("start")
    ranges = files.select("path", "length", begin).withColumn("end", F.least(F.col("start") + step, F.col("length")))
    ranges = ranges.observe("input", F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes"), F.count_if(F.col("start") == 0).alias("files"))

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                own = as_local(r["path"])
                whole = r["start"] == 0 and r["end"] == r["length"]
                if not whole and not compressed.can_be_split(own):
                    if r["start"]:
                        continue  # the first range reads all
                    whole = True
                part = FileRange(own) if whole else FileRange(own, r["start"], r["end"], r["start"] // step)
                yield from fastq_batches(part, options)

    # ranges are a few bytes each; their reading is what is dealt out, to a number of tasks that follows from a batch's files: with few partitions tasks would grow with them
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files_per_batch // TASK_FILES))
    return ranges.repartition(tasks).mapInArrow(read, FASTQ_SCHEMA)


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Records (as Parquet of :data:`READ_SCHEMA`) that arrive in a folder."""
    reader = spark.readStream.schema(READ_SCHEMA).format("parquet").option("maxFileAge", "36500d")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def with_verdict(reads: DataFrame, index: Index | PublishedIndex, permille: int = 500) -> DataFrame:
    """Records with their verdict; ``reads`` may be a stream."""
    found = reads.withColumn("_p", coverage.probe(F.col("seq"), index))
    return found.withColumn("matched", coverage.matches(F.col("_p.covered"), F.coalesce(F.length("seq"), F.lit(0)), permille)).drop("_p")


def split_stream(reads: DataFrame, index: Index | PublishedIndex, out: str, checkpoint: str, permille: int = 500, name: str = "split") -> StreamingQuery:
    """Both sides as Parquet in matched=true/false; counts are observed as ``counts`` of each batch's progress."""
    said = with_verdict(reads, index, permille).observe("counts", F.count(F.lit(1)).alias("reads"), F.count_if("matched").alias("matched"), F.sum(F.length("seq")).alias("bases"))
    writer = said.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).queryName(name)
    return writer.partitionBy("matched").trigger(availableNow=True).start()


def pair_stream(reads: DataFrame, index: Index | PublishedIndex, write: Callable[[DataFrame, int], None], checkpoint: str, permille: int = 500) -> StreamingQuery:
    """As :func:`split_stream` for pairs: each batch, which holds both files of its samples, is split as a whole."""
    from tessera.plans.split import split_pairs

    def batch(rows: DataFrame, number: int) -> None:
        write(split_pairs(rows, index, permille), number)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seconds_left(elapsed: Column, share: Column) -> Column:
    """What the rest takes at the speed so far; null if nothing is done yet."""
    return F.when(share > 0, elapsed * (1 - share) / share)


class Progress(StreamingQueryListener):
    """The counts of a query so far, and the share of known input that is done (never over one): of its bytes as stored, else of its rows."""

    def __init__(self, total_rows: int | None = None, total_bytes: int | None = None):
        self.total, self.total_bytes = total_rows, total_bytes
        self.rows = self.matched = self.bytes = 0
        self.ended, self.began, self.shares = False, None, []

    @property
    def share(self) -> float | None:
        if self.total_bytes:
            return min(1.0, self.bytes / self.total_bytes)
        return min(1.0, self.rows / self.total) if self.total else None

    def seconds_left(self, now: float | None = None) -> float | None:
        """What the rest takes at the speed so far."""
        done = self.share
        return None if not done or self.began is None else ((time.time() if now is None else now) - self.began) * (1 - done) / done

    def onQueryStarted(self, event):
        self.began = time.time()

    def onQueryProgress(self, event):
        counts, read = (event.progress.observedMetrics.get(k) for k in ("counts", "input"))
        if counts is not None:
            self.rows += counts["reads"]
            self.matched += counts["matched"]
        if read is not None:
            self.bytes += read["bytes"]
        self.shares.append(self.share)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended = True
