"""Screen records as their files arrive: a stream that takes only new files, and a report of all that came.

    python -m jobs.arrivals --landing DIR --reference DIR --out DIR --checkpoint DIR [--config jobs/arrivals.json]

Each run handles the files of ``landing`` that earlier runs have not seen (the checkpoint knows them, whatever their times are) and ends. A micro-batch has
``files_per_batch`` files at most, so a backlog is worked off in bounded steps. Each batch is screened in one narrow stage and written as a whole to
``out/sides/batch=N``, in folders ``matched=.../sample=...`` below it. If a run dies, the next one gets the same batch with the same number and files again,
and replaces that folder: no record is lost or there twice. After the stream the report of all batches is written anew from the columns that it needs.

Spark's file source by itself passes over files that are a week older than the newest one; here files of any time are taken, so the driver remembers the name of each file that came
(about 200 bytes; move files away that are done where there are millions).

The reference is read by each run; records that were screened before keep their verdict when it changes. Files are to be moved in whole and are not to be changed.

``landing`` may also be a pattern, or a single file.

Edge cases: as in :mod:`jobs.screen`; without any new file the tables stay as they are; before the first file there is an empty report.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs import common
from jobs.common import Settings, log

BATCH_SIDES = "id {id}, text string, covered long, length int, batch long, matched boolean, sample string"


def sides_of(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """All records that were screened so far; ``kind``: the type of their ids."""
    rows = spark.read.schema(BATCH_SIDES.format(id=kind)).option("basePath", f"{out}/sides").parquet(f"{out}/sides")
    return rows.withColumn("sample", F.coalesce("sample", F.lit("")))


def as_pattern(path: str) -> str:
    """The path as a pattern that it alone fits: a stream's plain path must be a folder, a pattern may fit a single file too."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if re.search(r"[*?{}\[\]\\,]", path) or not folder else f"{folder}/{{{name}}}"


def arrivals(spark: SparkSession, landing: str, reference: str, out: str, checkpoint: str, settings: Settings = Settings(), schema: StructType | None = None) -> dict[str, int]:
    """Run the job; returns what it counted. ``schema``: of the arriving files (default: as the folder's files say)."""
    s, total = settings, {"batches": 0, "records": 0, "matched": 0}
    own = common.reference_index(spark.read.parquet(reference), s)
    schema = schema or spark.read.parquet(landing).schema
    kind = schema[s.id].dataType.simpleString()

    def batch(rows: DataFrame, number: int) -> None:
        seen = Observation(f"batch {number}")
        records = common.screened(common.taken(rows, s), own, common.fixed(s))
        records = records.observe(seen, F.count("*").alias("records"), F.count_if("matched").alias("matched"))
        records.write.mode("overwrite").partitionBy("matched", "sample").parquet(f"{out}/sides/batch={number}")
        log.info("batch %d: read %d new records of %s, wrote %s/sides/batch=%d: %d matched", number, seen.get["records"], landing, out, number, seen.get["matched"])
        total["batches"] += 1
        for k in ("records", "matched"):
            total[k] += seen.get[k]

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s.files_per_batch).option("maxFileAge", "36500d").parquet(as_pattern(landing))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        report = common.sample_report(sides_of(spark, out, kind))
        report = report.withColumn("pct", common.share(F.col("matched"), F.col("records")))
        report.coalesce(1).write.mode("overwrite").parquet(f"{out}/report")  # a row for each sample
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.info("nothing has arrived yet")
    log.info("%d batches with %d new records, %d of them matched; wrote %s/report", total["batches"], total["records"], total["matched"], out)
    return total


def main() -> None:
    a = common.command_line("arrivals", "Screen records as their files arrive.", {"landing": "folder where files arrive (Parquet)", "reference": "table of reference texts (Parquet)", "out": "folder to write", "checkpoint": "folder of the stream's checkpoint"})
    spark = common.session("arrivals")
    try:
        arrivals(spark, a.landing, a.reference, a.out, a.checkpoint, Settings.load(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
