"""Paired reads: mates of files by name, of records by position, and their common verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names


def pair_files(files: DataFrame, name: str = "name", arrival: str = "arrival") -> DataFrame:
    """sample, r1 and r2 from file names: the i-th first mate of a key goes with its i-th second one, others stay single.

    A pair is named by its key, a single file by its name.
    """
    known = files.select(F.col(name).alias("file"), F.col(arrival).alias("arrival")).withColumn("mate", names.mate(F.col("file"))).withColumn("key", names.mate_key(F.col("file")))
    order = Window.partitionBy("key", "mate").orderBy("arrival")
    ranked = known.where("mate > 0").withColumn("rn", F.row_number().over(order))
    one, two = (ranked.where(F.col("mate") == m).select("key", "rn", F.col("file").alias(f"f{m}")) for m in (1, 2))
    both = one.join(two, ["key", "rn"], "full_outer")
    paired = F.col("f1").isNotNull() & F.col("f2").isNotNull()
    sample = F.when(paired, F.col("key")).otherwise(F.coalesce("f1", "f2"))
    out = both.select(sample.alias("sample"), F.coalesce("f1", "f2").alias("r1"), F.when(paired, F.col("f2")).alias("r2"))
    single = known.where("mate = 0").select(F.col("file").alias("sample"), F.col("file").alias("r1"), F.lit(None).cast("string").alias("r2"))
    return out.unionByName(single)


def zip_records(r1: DataFrame, r2: DataFrame, ordinal: str = "ordinal", columns: tuple[str, ...] = ("seq",), check: bool = True) -> DataFrame:
    """Records of both mates side by side, by their place in the files; unequal counts are an error."""
    left = r1.select(ordinal, *(F.col(c).alias(f"{c}_1") for c in columns), F.lit(True).alias("_1"))
    right = r2.select(ordinal, *(F.col(c).alias(f"{c}_2") for c in columns), F.lit(True).alias("_2"))
    both = left.join(right, ordinal, "full_outer")
    if check:
        lone = F.col("_1").isNull() | F.col("_2").isNull()
        both = both.where(F.when(lone, F.raise_error(F.lit("R1 and R2 differ in their number of records")).cast("boolean")).otherwise(F.lit(True)))
    return both.drop("_1", "_2")


def pair_verdicts(verdicts: DataFrame, pair: str = "pair", matched: str = "matched") -> DataFrame:
    """pair and matched: a pair matches if either mate does."""
    return verdicts.groupBy(pair).agg(F.bool_or(matched).alias("matched"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """reads and matched, counted as reads: two for each pair."""
    return pairs.agg((2 * F.count("*")).alias("reads"), (2 * F.count_if("matched")).alias("matched"))
