"""The jobs as queries, each run twice into one folder, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.arrivals import arrivals, sides_of
from jobs.common import Settings
from jobs.screen import SIDES, screen
from tessera.queries import TEXT_COVERAGE, TEXT_PERMILLE
from tessera.sources.shared import new_folder

SETTINGS = Settings(permille=TEXT_PERMILLE)
#: Rows of all output tables under common names.
COLUMNS = ("part", "name", "id", "records", "matched", "covered", "length", "text")


def as_part(rows: DataFrame, part: str, **of) -> DataFrame:
    """Rows of a table in :data:`COLUMNS`; ``of``: expressions for them (else -1, no text)."""
    kinds = {"name": "string", "text": "string"}
    return rows.select(F.lit(part).alias("part"), *(F.expr(of.get(c, "null" if c in kinds else "-1")).cast(kinds.get(c, "long")).alias(c) for c in COLUMNS[1:]))


def record_rows(sides: DataFrame) -> DataFrame:
    return as_part(sides, "record", name="sample", id="id", records="1", matched="int(matched)", covered="covered", length="length", text="text")


def report_rows(report: DataFrame) -> DataFrame:
    return as_part(report, "report", name="sample", records="records", matched="matched", covered="covered", length="characters")


_SAID = f"covered * 1000 > {TEXT_PERMILLE} * length"
_RECORDS = f"""SELECT 'record' AS part, coalesce(v.source, '') AS name, v.doc_id AS id, CAST(1 AS BIGINT) AS records, CAST({_SAID} AS BIGINT) AS matched, covered, CAST(length AS BIGINT) AS length, d.text
FROM dverdict v JOIN documents d USING (doc_id)"""
_REPORT = f"""SELECT 'report' AS part, coalesce(source, '') AS name, CAST(-1 AS BIGINT) AS id, count(*) AS records, CAST(count_if({_SAID}) AS BIGINT) AS matched, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(length) AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS text
FROM dverdict GROUP BY 2"""
_ITEMS = """SELECT 'item' AS part, CAST(NULL AS VARCHAR) AS name, item_id AS id, CAST(coalesce(max(n), 0) AS BIGINT) AS records, count(n) AS matched, CAST(-1 AS BIGINT) AS covered, count(seed) AS length, CAST(NULL AS VARCHAR) AS text
FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN theirs USING (item_id) LEFT JOIN holders USING (seed) GROUP BY item_id"""
JOB1_SQL = f"""WITH {TEXT_COVERAGE},
theirs AS (SELECT DISTINCT item_id, substr(text, CAST(t.pos + 1 AS INTEGER), 25) AS seed FROM benchmark, range(0, greatest(length(text) - 24, 0)) t(pos)),
holders AS (SELECT seed, count(DISTINCT doc_id) AS n FROM ds SEMI JOIN ref ON ds.seed = ref.seed GROUP BY seed)
{_RECORDS} UNION ALL {_REPORT} UNION ALL {_ITEMS}"""
JOB2_SQL = f"WITH {TEXT_COVERAGE} {_RECORDS} UNION ALL {_REPORT}"


def job1_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents screened against the benchmark: all records with their side, the report of each source, and what of the benchmark was found."""
    out = new_folder(spark, "job1-screen")
    for _ in range(2):
        screen(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, SETTINGS)
    sides = spark.read.schema(SIDES.format(id="bigint")).parquet(f"{out}/sides").withColumn("sample", F.coalesce("sample", F.lit("")))
    items = as_part(spark.read.parquet(f"{out}/items"), "item", id="item", records="most_records", matched="found", length="windows")
    return record_rows(sides).unionByName(report_rows(spark.read.parquet(f"{out}/report"))).unionByName(items)


def job2_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents screened as a stream of files; the second run finds nothing new. All records with their side, and the report of each source."""
    out = new_folder(spark, "job2-arrivals")
    for _ in range(2):
        arrivals(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{out}/tables", f"{out}/checkpoint", SETTINGS)
    return record_rows(sides_of(spark, f"{out}/tables", "bigint")).unionByName(report_rows(spark.read.parquet(f"{out}/tables/report")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_screen": job1_screen, "job2_arrivals": job2_arrivals}
ORACLES: dict[str, str] = {"job1_screen": JOB1_SQL, "job2_arrivals": JOB2_SQL}
