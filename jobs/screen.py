"""Screen a corpus against a reference (a benchmark that must not leak into training): both sides, a report, and what of the reference was found.

    python -m jobs.screen --documents DIR --reference DIR --out DIR [--config jobs/screen.json]

Writes three Parquet tables below ``out``:

* ``sides``: every record with its text, covered characters, length and verdict, in folders ``matched=.../sample=...``; the clean corpus is ``matched=false``;
* ``report``: records, matched ones, characters and covered characters of each sample, and the share that matched;
* ``items``: how many different windows each reference text has, how many of them some record holds, and the most records that hold one and the same
  window, in folders ``leaked=...``. An item that no record holds is there too.

Each run replaces the tables as a whole, so a rerun gives the same. The sides are one narrow stage over the records; for the items only the windows that the reference holds are
shuffled, counted by window before they meet the items: no record is paired with an item.

Edge cases: a null or empty text is never matched; a null sample becomes the sample of the empty name (in the folder that Spark names for it); records that repeat are
each kept, and count once for a window if they share an id; reference texts that are null or shorter than a window have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import Settings, log
from tessera.operators import coverage, index
from tessera.operators.index import Index

SIDES = "id {id}, text string, covered long, length int, matched boolean, sample string"


def found_items(records: DataFrame, reference: DataFrame, own: Index, s: Settings) -> DataFrame:
    """item, windows, found and most_records of each reference text."""
    # records without any covered character hold no window of the reference
    hits = coverage.found_windows(records.where("covered > 0"), "id", "text", own)
    holders = hits.select("seed", "id").distinct().groupBy("seed").agg(F.count("*").alias("n"))
    items = reference.select(F.col(f"`{s.reference_id}`").alias("item"), F.col(f"`{s.reference_text}`").alias("text"))
    theirs = index.read_seeds(items, "item", "text", s.seed, dna=False).select("item", "seed").distinct()
    each = theirs.join(holders, "seed", "left").groupBy("item").agg(F.count("*").alias("windows"), F.count("n").alias("found"), F.coalesce(F.max("n"), F.lit(0)).alias("most_records"))
    every = items.select("item").distinct().join(each, "item", "left")
    return every.select("item", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("windows", "found", "most_records")))


def screen(spark: SparkSession, documents: str, reference: str, out: str, settings: Settings = Settings()) -> dict[str, int]:
    """Run the job; returns what it counted."""
    s = settings
    texts = spark.read.parquet(reference)
    own = common.reference_index(texts, s)
    seen = Observation("screen")
    records = common.screened(common.taken(spark.read.parquet(documents), s), own, common.fixed(s))
    counts = F.count("*").alias("records"), F.count_if("matched").alias("matched"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")
    records.observe(seen, *counts).write.mode("overwrite").partitionBy("matched", "sample").parquet(f"{out}/sides")
    got = seen.get
    log.info("read %d records (%d characters) of %s", got["records"], got["characters"], documents)
    log.info("wrote %s/sides: %d matched, %d not", out, got["matched"], got["records"] - got["matched"])

    kind = spark.read.parquet(documents).schema[s.id].dataType.simpleString()
    sides = spark.read.schema(SIDES.format(id=kind)).parquet(f"{out}/sides").withColumn("sample", F.coalesce("sample", F.lit("")))
    report = common.sample_report(sides).withColumn("pct", common.share(F.col("matched"), F.col("records")))
    report.coalesce(1).write.mode("overwrite").parquet(f"{out}/report")  # a row for each sample
    found = found_items(sides, texts, own, s)
    items = Observation("items")
    found = found.observe(items, F.count("*").alias("items"), F.count_if(F.col("found") > 0).alias("leaked"))
    found.withColumn("leaked", F.col("found") > 0).write.mode("overwrite").partitionBy("leaked").parquet(f"{out}/items")
    log.info("wrote %s/report and %s/items: %d of %d reference texts were found", out, out, items.get["leaked"], items.get["items"])
    return {**got, **items.get}


def main() -> None:
    a = common.command_line("screen", "Screen a corpus against a reference.", {"documents": "table of records (Parquet)", "reference": "table of reference texts (Parquet)", "out": "folder to write"})
    spark = common.session("screen")
    try:
        screen(spark, a.documents, a.reference, a.out, Settings.load(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
