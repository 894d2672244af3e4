"""Pairs whose files arrive apart: a stream of file names in which a mate waits, as keyed state, until its partner comes.

What flows and what is kept are names of files, not records: the state holds those that wait. The i-th first mate of a key goes with its i-th second one in the order of their arrival (within a
batch, of time and name). A file that has waited for longer than ``single_after`` when others come goes on as a single one, as does at once a file without a mate's marker. Checkpoints keep the state over
restarts. Each batch of pairs is then split as a whole (:func:`tessera.plans.sides.split_all`) under the names of its files, so a batch that comes again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import names
from tessera.operators.index import Index
from tessera.plans.sides import split_all
from tessera.sources.published import PublishedIndex

SAMPLES = "sample string, r1 string, r2 string"
WAITING = "ones array<string>, twos array<string>"


def base_name(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def read_pair_stream(spark: SparkSession, path: str, single_after: float = 3600.0, files_per_batch: int = 1000) -> DataFrame:
    """sample, r1 and r2 (null for single files) of the FASTQ files that arrive in a folder; ``single_after``: seconds."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").load(path).select("path", F.col("modificationTime").alias("time"))
    named = files.withColumn("name", base_name("path")).where(F.col("name").rlike(names.FASTQ))
    named = named.select("path", "time", names.mate(F.col("name")).alias("mate"), F.when(names.mate(F.col("name")) > 0, names.mate_key(F.col("name"))).otherwise(F.col("name")).alias("key"))

    def meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ones, twos = (list(x) for x in state.get) if state.exists else ([], [])
        out: list[tuple] = []
        if state.hasTimedOut:
            out = [(f.rsplit("/", 1)[-1], f, None) for f in ones + twos]
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values(["time", "path"]).itertuples():
                if not r.mate:
                    out.append((key[0], r.path, None))
                else:
                    (ones if r.mate == 1 else twos).append(r.path)
            n = min(len(ones), len(twos))
            out += [(key[0], a, b) for a, b in zip(ones[:n], twos[:n])]
            ones, twos = ones[n:], twos[n:]
            if ones or twos:
                state.update((ones, twos))
                state.setTimeoutDuration(int(single_after * 1000))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["sample", "r1", "r2"])

    return named.groupBy("key").applyInPandasWithState(meet, SAMPLES, WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_arriving(spark: SparkSession, path: str, index: Index | PublishedIndex, out: str, checkpoint: str, said: Callable[[DataFrame, int], None], permille: int = 500, gzip: bool = False, single_after: float = 3600.0, files_per_batch: int = 1000, **options) -> StreamingQuery:
    """Split samples once their files are there, into files below ``out``; ``said`` gets the report of each batch and its number."""

    def batch(samples: DataFrame, number: int) -> None:
        said(split_all(spark, samples, index, out, permille, gzip, **options), number)

    # batches without new files would follow one another for ever, as one could be the first after a time limit; limits are looked at when files come
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        stream = read_pair_stream(spark, path, single_after, files_per_batch)
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
