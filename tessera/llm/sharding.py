"""Sharding: a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in blocks (by hash of the id). A uniform permutation of all rows sends a random number of each
block's rows to each shard; these numbers have a multivariate hypergeometric law. The driver draws the matrix
of blocks x shards (see :func:`parts`: 4,096 blocks, or one for each million rows), which fixes all shard sizes exactly before a row moves. Then each block permutes
its own rows and deals them out by its line of the matrix, the rows are exchanged, and each shard is permuted
again: its rows are dealt by a fresh random key into cells, whose counts give the offset of each cell, and
ranked within their cell. No step sorts more than a block or a cell in one task.

The law is ``rows``: shard sizes differ by one at most. Rows travel as id, size and checksum only.

All random keys are keyed hashes of the row (seed, id, checksum, and a number that tells repeated rows apart, which follows from where the row lies in its file): a task that is run
again gives the same rows, other files of the same rows may give other ones.

Edge cases: a null text has size 1 and the checksum of the empty text; a null id hashes like any value, its
rows being told apart by their text; repeated rows are told apart by a number of their own; very long texts count by their size only; an empty table gives an
empty result; fewer rows than shards leave some shards empty; columns of the input are kept and the three
new ones get free names.
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, unused

SEED = 20_260_101


def parts(rows: int, least: int = 4096, most: int = 4096, cap_rows: int = 1_000_000) -> int:
    """Into how many blocks to deal ``rows``: of ``least`` rows, up to ``most`` blocks, and then of ``cap_rows``."""
    return max(1, min(most, math.ceil(rows / least)), math.ceil(rows / cap_rows))


def hypergeometric(rng: random.Random, draws: int, good: int, total: int) -> int:
    """How many of ``draws`` rows drawn from ``total`` without putting back are among the ``good`` ones.

    Inversion from the mode outwards: exact up to double rounding, about one standard deviation of steps.
    """
    lo, hi = max(0, draws - (total - good)), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    left = u = rng.random()
    left -= p
    down = up = mode
    p_down = p_up = p
    while left > 0:
        moved = False
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            up += 1
            moved, left = True, left - p_up
            if left <= 0:
                return up
        if down > lo:
            p_down *= down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            moved, left = True, left - p_down
            if left <= 0:
                return down
        if not moved:  # rounding has left a rest of u
            return mode
        if p_up + p_down < 1e-300:
            return mode
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each block, how many of its rows go to each shard; shard sizes differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        left, of, line = n, sum(room), []
        for s in range(shards):
            got = hypergeometric(rng, left, room[s], of) if left else 0
            of -= room[s]
            line.append(got)
            left -= got
        for s, got in enumerate(line):
            room[s] -= got
        out.append(line)
    return out


def _key(seed: int, what: str, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), *cols)


def shard_rows(df: DataFrame, ids: list[str], shards: int = 16, seed: int = SEED, names: tuple[str, str] = ("shard", "slot"), **sizes: int) -> DataFrame:
    """``df`` with its shard (0 to ``shards`` - 1) and its slot there (gapless from 0), a uniform shuffle.

    ``ids``: columns that tell rows apart. ``sizes``: see :func:`parts`. ``df`` is read three times, twice for
    counts; give a stored table.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shard")
    names = unused(df, *names)
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(f"`{c}`").alias(f"id{k}") for k, c in enumerate(ids)))
    ident = [f"id{k}" for k in range(len(ids))]
    rows = df.count()
    blocks = parts(rows, **sizes)
    of_block = F.pmod(_key(seed, "block", *ident), F.lit(blocks)).cast("int")
    counted = {r[0]: r[1] for r in df.groupBy(of_block.alias("b")).count().collect()}  # one number a block
    matrix = communication_matrix([counted.get(b, 0) for b in range(blocks)], shards, seed)
    # where each shard's part of a block ends; a table of blocks x shards numbers
    ends = [list(itertools.accumulate(line)) for line in matrix]
    plan = spark.range(1, numPartitions=1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("block", "ends"))

    # the first permutation, within the block
    local = Window.partitionBy("block").orderBy(_key(seed, "deal", *ident), *ident)
    dealt = df.withColumn("block", of_block).withColumn("rank", F.row_number().over(local) - 1).join(plan, "block")
    sent = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")).drop("ends", "rank", "block")

    # the second permutation, within the shard: cells by a random key, then the rank within the cell
    cells = parts(math.ceil(rows / shards), **({"least": 1024, "most": 256} | sizes))
    sent = sent.withColumn("key", _key(seed, "slot", *ident)).withColumn("cell", F.pmod(F.shiftrightunsigned("key", 20), F.lit(cells)).cast("int"))
    sent = scratch.write(sent)
    ranked = sent.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", *ident)))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over shards x cells counts
    offsets = sent.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    placed = ranked.join(offsets, ["shard", "cell"])
    return placed.select("row.*", F.col("shard").alias(names[0]), (F.col("before") + F.col("rank") - 1).alias(names[1]))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = SEED, **sizes: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document, by the law ``rows``."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    narrow = Scratch(docs.sparkSession, "shard").write(narrow.withColumn("row_no", F.monotonically_increasing_id()))  # tells repeated rows apart
    out = shard_rows(narrow, ["doc_id", "text_crc32", "row_no"], shards, seed, **sizes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
