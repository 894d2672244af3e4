"""What the jobs share: the config file, the log, the command line's session, the screen's columns and the index of a reference."""

from __future__ import annotations

import argparse
import json
import logging
import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.seeds import Seed
from tessera.operators import coverage, index
from tessera.operators.index import Index

log = logging.getLogger("jobs")


@dataclass(frozen=True)
class Settings:
    """The config file's fields. Columns: of the records, of the reference, and how a record is judged."""

    id: str = "doc_id"
    text: str = "text"
    sample: str = "source"
    reference_id: str = "item_id"
    reference_text: str = "text"
    mask: str = "#" * 25
    permille: int = 100
    #: Files of a micro-batch at most (streams only).
    files_per_batch: int = 1000

    @staticmethod
    def load(path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        unknown = set(given) - {x.name for x in fields(Settings)}
        if unknown:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        return Settings(**given)

    @property
    def seed(self) -> Seed:
        return Seed(self.mask)


def reference_index(reference: DataFrame, s: Settings) -> Index:
    """The windows of the reference's texts."""
    own = index.build_index(reference, s.reference_text, s.seed, dna=False).stored()
    log.info("reference: %d different windows of %d characters", own.size, s.seed.span)
    return own


def screened(records: DataFrame, own: Index, s: Settings) -> DataFrame:
    """Records with covered, length and matched; a narrow step, also on streams. A null text is covered by nothing."""
    size = F.coalesce(F.length(F.col(f"`{s.text}`")), F.lit(0))
    found = records.withColumn("_p", coverage.probe(F.col(f"`{s.text}`"), own))
    covered = F.col("_p.covered")
    return found.withColumns({"covered": covered, "length": size.cast("int"), "matched": coverage.matches(covered, size, s.permille)}).drop("_p")


def taken(records: DataFrame, s: Settings) -> DataFrame:
    """The columns that a screen needs, under fixed names; a null sample is one of its own, the empty name."""
    col = lambda name: F.col(f"`{name}`")
    return records.select(col(s.id).alias("id"), col(s.text).cast("string").alias("text"), F.coalesce(col(s.sample).cast("string"), F.lit("")).alias("sample"))


def fixed(s: Settings) -> Settings:
    """The settings of :func:`taken` records."""
    return Settings(**{**s.__dict__, "id": "id", "text": "text", "sample": "sample"})


def sample_report(sides: DataFrame) -> DataFrame:
    """sample, records, matched, characters and covered of each sample."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sides.groupBy("sample").agg(F.count("*").alias("records"), F.count_if("matched").alias("matched"), whole(F.col("length").cast("long")).alias("characters"), whole("covered").alias("covered"))


def share(matched: Column, records: Column) -> Column:
    return F.when(records > 0, matched * 100.0 / records).otherwise(0.0)


def command_line(name: str, what: str, paths: dict[str, str]) -> argparse.Namespace:
    """The paths and the config file of a job."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=what)
    for option, text in paths.items():
        p.add_argument(f"--{option}", required=True, help=text)
    p.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), help="settings (JSON); default: %(default)s")
    return p.parse_args()


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
