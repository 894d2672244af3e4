"""The whole query: records against an index, split into both sides, written, and reported."""

from __future__ import annotations

import operator
import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import coverage
from tessera.operators.index import Index
from tessera.sources.published import PublishedIndex
from tessera.sources.shared import workspace

RECORD = ("header", "seq", "plus", "qual")


def split_reads(reads: DataFrame, index: Index | PublishedIndex, permille: int = 500, strategy: str = "auto", max_length: int | None = None) -> DataFrame:
    """Each record with its verdict; both sides are in the result, so none is lost.

    This is one narrow stage over the scan, also on streams, whatever the index's size is; the strategies ``join`` and ``verified`` (see :mod:`tessera.operators.coverage`) shuffle windows.
    """
    size = F.coalesce(F.length("seq"), F.lit(0))
    if strategy in ("auto", "probe"):
        asked = F.col("seq") if max_length is None else F.when(F.length("seq") <= max_length, F.col("seq"))
        found = reads.withColumn("_p", coverage.probe(asked, index))
        return found.withColumn("matched", coverage.matches(F.col("_p.covered"), size, permille)).drop("_p")
    said = coverage.verdicts(reads.select(F.struct("sample", "mate", "ordinal").alias("id"), "seq"), "id", "seq", index, permille, strategy=strategy, max_length=max_length)
    said = said.select("id.*", "matched")
    return reads.join(said, ["sample", "mate", "ordinal"])


def split_pairs(reads: DataFrame, index: Index | PublishedIndex, permille: int = 500, **how) -> DataFrame:
    """As :func:`split_reads` for both mates: a pair matches if one of its reads does (sample and ordinal make a pair)."""
    said = split_reads(reads, index, permille, **how)
    pair = Window.partitionBy("sample", "ordinal")  # so records are decided once
    both = said.where("sample is not null and ordinal is not null").withColumns({"matched": F.bool_or("matched").over(pair), "_lone": F.min("mate").over(pair).eqNullSafe(F.max("mate").over(pair))})
    whole = both.where(F.when(F.col("_lone"), F.raise_error(F.lit("R1 and R2 differ in their number of records")).cast("boolean")).otherwise(F.lit(True)))
    return whole.drop("_lone")


def split_read_pairs(pairs: DataFrame, index: Index | PublishedIndex, permille: int = 500, max_length: int | None = None) -> DataFrame:
    """As :func:`split_pairs` for pairs that were read together (:func:`tessera.sources.ranges.read_pairs`): each is decided where it lies, then its mates become records."""

    def hit(text: str) -> Column:
        asked = F.col(text) if max_length is None else F.when(F.length(text) <= max_length, F.col(text))
        return coverage.matches(coverage.probe(asked, index)["covered"], F.coalesce(F.length(text), F.lit(0)), permille)

    said = pairs.withColumns({"_1": hit("seq_1"), "_2": hit("seq_2")}).withColumn("matched", F.col("_1") | F.col("_2"))
    mates = F.array(*(F.struct(F.lit(m).alias("mate"), F.col(f"file_{m}").alias("file"), *(F.col(f"{c}_{m}").alias(c) for c in RECORD)) for m in (1, 2)))
    return said.select("sample", "ordinal", "matched", F.inline(mates)).select("sample", "mate", "ordinal", *RECORD, "file", "matched")


def record_text() -> Column:
    """The four lines of a record."""
    return F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in RECORD))


def laid_down(rows: DataFrame) -> DataFrame:
    """Rows as a table in the shared folder: dealing by range goes through its input twice, which so is not decided twice."""
    path = f"{workspace(rows.sparkSession, 'stored')}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_split(split: DataFrame, path: str, gzip: bool = False) -> None:
    """Both sides as text in matched=true/false (and by sample and mate), in the order of the input.

    Records are dealt by range of their place, so a file's parts in the order of their names are the whole file. How many ranges there are is the session's to say (shuffle partitions, which
    the planner puts together where they are small). :func:`tessera.plans.sides.write_sides` needs no such exchange.
    """
    out = laid_down(split.select("sample", "mate", "matched", "ordinal", record_text().alias("value")))
    ordered = out.repartitionByRange("sample", "mate", "ordinal").sortWithinPartitions("matched", "sample", "mate", "ordinal")
    writer = ordered.drop("ordinal").write.mode("overwrite").partitionBy("matched", "sample", "mate")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def report(split: DataFrame, seconds: float | None = None) -> DataFrame:
    """name, reads, matched, pct, bases, paired (and reads a second) of each sample."""
    out = split.groupBy(F.col("sample").alias("name")).agg(
        F.count("*").alias("reads"), F.count_if("matched").alias("matched"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"), (F.count_distinct("mate") > 1).alias("paired")
    )
    out = out.withColumn("pct", F.when(F.col("reads") > 0, F.col("matched") * 100.0 / F.col("reads")).otherwise(0.0))
    return out if seconds is None else out.withColumn("seconds", F.lit(seconds)).withColumn("rate", F.col("reads") / F.greatest(F.lit(seconds), F.lit(1e-3)))


@dataclass
class SampleResult:
    name: str
    error: str | None = None


CANCELLED = "cancelled"


class Run:
    """A run over samples that can be cancelled from another thread: its Spark jobs are stopped, which aborts their outputs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.group, self.cancelled = spark, f"split-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def samples(self, names: list[str], read, index: Index | PublishedIndex, path: str, permille: int = 500, paired: bool = False, gzip: bool = False) -> list[SampleResult]:
        """Samples one by one; one that fails is reported and the next goes on. ``read``: from a name to its records."""
        out = []
        self.spark.sparkContext.setJobGroup(self.group, "split samples", interruptOnCancel=True)
        try:
            for name in names:
                if self.cancelled.is_set():
                    out.append(SampleResult(name, CANCELLED))
                    continue
                try:
                    rows = read(name)
                    split = split_pairs(rows, index, permille) if paired else split_reads(rows, index, permille)
                    write_split(split, f"{path}/{name}", gzip)
                    out.append(SampleResult(name))
                except Exception as e:  # noqa: BLE001  whatever a sample's files hold
                    out.append(SampleResult(name, CANCELLED if self.cancelled.is_set() else str(e).splitlines()[0]))
        finally:
            self.spark.sparkContext._jsc.clearJobGroup()
        return out


def split_samples(samples: list[str], read, index: Index | PublishedIndex, path: str, permille: int = 500, paired: bool = False, gzip: bool = False) -> list[SampleResult]:
    """As :meth:`Run.samples`, without a way to cancel."""
    return Run(SparkSession.getActiveSession()).samples(samples, read, index, path, permille, paired, gzip)


def placed(rows: DataFrame, within: list[str], order: list[str], name: str = "line") -> DataFrame:
    """``rows`` with their place (from 1) within the groups of ``within``, in the order of ``order``.

    Rows are dealt by range and stored, a group's rows in each part are counted, and the counts of the parts before are added: no group meets in one task.
    """
    spark = rows.sparkSession
    path = f"{workspace(spark, 'placed')}/rows"
    dealt = laid_down(rows).repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")).write.parquet(path)
    stored = spark.read.parquet(path)
    each = stored.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("_part", *(F.col(c).alias(f"_{c}") for c in within), "_first", F.coalesce(before, F.lit(0)).alias("_before"))  # parts x groups rows
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    both = stored.withColumnRenamed("_part", "_of").join(each, reduce(operator.and_, same, F.col("_of") == F.col("_part")))
    return both.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias(name))


__all__ = ["CANCELLED", "Run", "SampleResult", "placed", "record_text", "report", "split_pairs", "split_read_pairs", "split_reads", "split_samples", "write_split"]
