"""Indexes of reference seeds: exact or approximate, their size, statistics and storage."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.functions import hashing, seeds
from tessera.functions.seeds import Seed
from tessera.sources.shared import workspace

SLOTS = 4
TARGET_LOAD = 0.95
WARN_LOAD = 90


#: Bytes of seeds that are sent to tasks (8 a seed of bases, 16 a text window); larger indexes are mapped from a file.
PROBE_LIMIT = 64 << 20


@dataclass(eq=False)
class Index:
    """Distinct seeds of a reference: ``codes`` has the column ``seed``, a number of two bits a base or a window's text.

    ``dna``: seeds are base codes; else windows of plain text. ``canonical``: both strands share a seed.
    """

    codes: DataFrame
    seed: Seed
    dna: bool = True
    canonical: bool = True
    alphabet: str = "strict"
    #: Whether the codes lie in a table already.
    kept: bool = False
    #: A single row: the characters of the reference, which has no more windows.
    windows: DataFrame | None = None
    #: Bits of a fingerprint where the index is mapped: 8, 16 or 32; whether it is mapped however small it is.
    filter_bits: int = 32
    always_mapped: bool = False

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").parquet(path)

    def load(self, path: str) -> Index:
        codes = self.codes.sparkSession.read.schema("seed bigint" if self.dna else "seed string").parquet(path)
        return Index(codes, self.seed, self.dna, self.canonical, self.alphabet, True)

    def stored(self) -> Index:
        """The same index as a table in the shared folder, so that it is built once."""
        if not self.kept:
            path = workspace(self.codes.sparkSession, "index")
            self.save(f"{path}/codes")
            self.codes, self.kept = self.load(f"{path}/codes").codes, True
        return self

    def mapped(self, bits: int = 32) -> Index:
        """The same index, probed through a static filter."""
        return replace(self.stored(), filter_bits=bits, always_mapped=True)

    @cached_property
    def size(self) -> int:
        """How many seeds there are."""
        return self.stored().codes.count()

    @cached_property
    def small(self) -> bool:
        """Whether the seeds may be sent to the tasks: by the reference's length, else by their number."""
        limit = PROBE_LIMIT // (8 if self.dna else 16)
        return (self.windows is not None and (self.windows.first()[0] or 0) <= limit) or self.size <= limit

    def prints(self) -> DataFrame:
        """first and second: the two prints of each text window."""
        seed = Seed("#" * self.seed.weight)  # of the significant characters

        def run(batches):
            for b in batches:
                points = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le", "replace"), np.uint32)
                begin = np.arange(b.num_rows) * seed.span
                yield pa.RecordBatch.from_arrays([pa.array(seeds.text_prints(points, seed, k, begin).view(np.int64)) for k in (0, 1)], names=["first", "second"])

        return self.codes.select("seed").mapInArrow(run, "first long, second long")

    @cached_property
    def filter(self):
        """The static filter of all seeds, with their table; built once."""
        from tessera.operators import static_filter

        return static_filter.build_filter(self.hashes(), self.size, self.filter_bits)

    @property
    def table(self):
        """The sorted table of all seeds."""
        return self.filter.table

    def hashes(self) -> DataFrame:
        """h: the mixed codes, which are as distinct as the codes, or first prints, beside which the second ones are."""
        codes = self.stored().codes.select("seed") if self.dna else self.stored().prints()
        names = ["h", *codes.columns[1:]]

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(hashing.mix64(b.column(0).to_numpy().view(np.uint64)).view(np.int64)), *b.columns[1:]], names=names)

        return codes.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    def prober(self, exact: bool = True):
        """What decides records where they lie; ``exact``: the same for an index that is sent and one that is mapped, else a mapped one has false finds."""
        from tessera.operators import coverage, static_filter

        how = self.seed, self.dna, self.canonical, self.alphabet
        if self.always_mapped or not self.small:
            return (static_filter.ExactProber if exact else static_filter.FilterProber)(self.filter, *how)
        columns = (self.codes.select("seed") if self.dna else self.prints()).toArrow().columns
        return coverage.Prober(*(c.to_numpy().view(np.uint64) for c in columns), *[None] * (2 - len(columns)), *how)


def coded_seeds(rows: DataFrame, key: str | None, text: str, seed: Seed, canonical: bool = True, alphabet: str = "strict") -> DataFrame:
    """key, pos and seed (a number) of every valid window of every row; without a key, the seeds of each stretch once."""

    def run(batches):
        lut = seeds.base_table(alphabet)
        for batch in batches:
            records = [(t or "").encode("latin-1", "replace") for t in batch.column(batch.num_columns - 1).to_pylist()]
            for row, place, code in seeds.coded_windows(records, seed, lut, canonical):
                if key is None:
                    found = np.unique(code)
                    for at in range(0, len(found), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)].view(np.int64))], names=["seed"])
                    continue
                for at in range(0, len(code), 1 << 16):
                    k = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[k])), pa.array(place[k].astype(np.int32)), pa.array(code[k].view(np.int64))], names=[key, "pos", "seed"])

    if key is None:
        return rows.select(text).mapInArrow(run, "seed long")
    kind = StructType([StructField(key, rows.schema[key].dataType), StructField("pos", IntegerType()), StructField("seed", LongType())])
    return rows.select(key, text).where(F.length(text) >= seed.span).mapInArrow(run, kind)


def read_seeds(rows: DataFrame, key: str, text: str, seed: Seed, dna: bool = True, canonical: bool = True, alphabet: str = "strict") -> DataFrame:
    """key, pos and seed of every valid window of every row; rows shorter than the span are left out before the explode."""
    coded = seeds.base_codes(F.col(text), alphabet) if dna else F.col(text)
    cut = rows.where(F.length(text) >= seed.span).select(key, F.posexplode(seeds.windows(coded, seed.span)).alias("pos", "win"))
    if dna:
        cut = cut.where(seeds.valid_window(F.col("win")))
    value = seeds.gather(F.col("win"), seed)
    return cut.select(key, "pos", (seeds.canonical(value) if dna and canonical else value).alias("seed"))


def seed_digest(rows: DataFrame, key: str, text: str, seed: Seed, canonical: bool = True, alphabet: str = "strict") -> DataFrame:
    """Of each key with a valid window: how many there are (n), how many different seeds, the least and the most of them, and the first window's (numbers of two bits a base).

    No window is shuffled: rows are dealt and sorted by their key and gone through in that order. What is held is a batch's windows, and the different seeds of a key that goes on.
    """
    names = [key, "n", "different", "least", "most", "first"]

    def run(batches):
        lut = seeds.base_table(alphabet)
        own, n, codes, at, first = None, 0, np.zeros(0, np.uint64), 0, 0  # of the key that may go on: itself, windows, different seeds, place and seed of the first window

        def done():
            if n:
                numbers = n, len(codes), *np.array([codes[0], codes[-1], first], np.uint64).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([own, *(pa.array([x], pa.int64()) for x in numbers)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0))
            values, key_of = runs.values, np.repeat(np.arange(len(runs.values)), np.diff(runs.run_ends.to_numpy(), prepend=0))
            if own is None or not own.equals(values.slice(0, 1)):
                yield from done()
                own, n, codes = values.slice(0, 1), 0, codes[:0]
            now = 0
            for row, place, code in seeds.coded_windows([(t or "").encode("latin-1", "replace") for t in batch.column(1).to_pylist()], seed, lut, canonical):
                if not len(row):
                    continue
                k = key_of[row]
                begin = np.flatnonzero(np.diff(k, prepend=-1))
                end = np.append(begin[1:], len(k))
                order = np.lexsort((code, k))
                sorted_ = code[order]
                fresh = np.append(True, (k[1:] != k[:-1]) | (sorted_[1:] != sorted_[:-1]))
                a = 0
                if k[0] == now:  # more of the key at hand
                    best = int(np.argmin(place[: end[0]]))
                    if not n or place[best] < at:
                        at, first = place[best], code[best]
                    n, codes, a = n + int(end[0]), np.union1d(codes, sorted_[: end[0]][fresh[: end[0]]]), 1
                if a == len(begin):
                    continue
                yield from done()
                if a < len(begin) - 1:  # keys that begin and end here
                    inner = slice(a, len(begin) - 1)
                    # a key's rows lie one after another, so its first window is the one of the least place
                    least_place = np.minimum.reduceat(place, begin)
                    is_first = np.flatnonzero(place == np.repeat(least_place, end - begin))
                    first_of = is_first[np.searchsorted(is_first, begin)]
                    columns = end - begin, np.add.reduceat(fresh.astype(np.int64), begin), sorted_[begin], sorted_[end - 1], code[first_of]
                    yield pa.RecordBatch.from_arrays([values.take(pa.array(k[begin][inner])), *(pa.array(c[inner].view(np.int64)) for c in columns)], names=names)
                b, e = int(begin[-1]), int(end[-1])
                now, own, n, codes = int(k[-1]), values.slice(int(k[-1]), 1), e - b, sorted_[b:e][fresh[b:e]]
                best = b + int(np.argmin(place[b:e]))
                at, first = place[best], code[best]
            if now != len(values) - 1:  # the last key has no window yet
                yield from done()
                own, n, codes = values.slice(len(values) - 1, 1), 0, codes[:0]
        if own is not None:
            yield from done()

    kind = StructType([StructField(key, rows.schema[key].dataType), *(StructField(c, LongType()) for c in names[1:])])
    return rows.select(key, text).where(F.length(text) >= seed.span).repartition(key).sortWithinPartitions(key).mapInArrow(run, kind)


def joined_stretches(rows: DataFrame, order: str, text: str, overlap: int, stretch: int = seeds.PIECE) -> DataFrame:
    """The sequences of all rows as one, in the order of ``order`` (null texts are left out), in stretches that share ``overlap`` characters with the next.

    Rows are dealt by range and stored; a part is given the first characters of those after it, which are all that passes the driver (a short text a part).
    """
    spark = rows.sparkSession
    path = f"{workspace(spark, 'joined')}/rows"
    kept = rows.select(order, F.col(text).alias("text")).where(F.col(text).isNotNull())
    kept.repartitionByRange(order).sortWithinPartitions(order, "text").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "text").write.parquet(path)
    stored = spark.read.schema("part int, row long, text string").parquet(path)

    def beginnings(batches):
        """Of each run of rows in a part as it is read: its first row and characters."""
        for b in batches:
            part, row, texts = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(part):
                end, head = at, ""
                while end < len(part) and part[end] == part[at]:
                    head += texts[end][: max(0, overlap - len(head))]
                    end += 1
                yield pa.RecordBatch.from_pydict({"part": pa.array([part[at]], pa.int32()), "row": pa.array([row[at]], pa.int64()), "head": [head]})
                at = end

    heads: dict[int, str] = {}
    for part, _, head in sorted(map(tuple, stored.mapInArrow(beginnings, "part int, row long, head string").collect())):
        heads[part] = (heads.get(part, "") + head)[:overlap]
    after, follow = {}, ""
    for part in sorted(heads, reverse=True):
        after[part] = follow
        follow = (heads[part] + follow)[:overlap]

    def cut(batches):
        part, held = None, ""
        for b in batches:
            for of, _, value in zip(*(c.to_pylist() for c in b.columns)):
                if part is not None and of != part:
                    yield held + after[part]
                    held = ""
                part, held = of, held + value
                while len(held) >= stretch + overlap:
                    yield held[: stretch + overlap]
                    held = held[stretch:]
        if part is not None:
            yield held + after[part]

    def run(batches):
        for piece in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.string())], names=["text"])

    return stored.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "row").mapInArrow(run, "text string").withColumnRenamed("text", text)


def build_index(reference: DataFrame, text: str, seed: Seed, dna: bool = True, canonical: bool = True, alphabet: str = "strict") -> Index:
    """The distinct seeds of all rows of ``reference`` (of any length); several references are united before."""
    windows = reference.agg(F.sum(F.length(F.col(text)).cast("long")))
    if dna:
        # dealt by seed first: a task that reads much would else gather all of its different seeds
        return Index(coded_seeds(reference, None, text, seed, canonical, alphabet).repartition("seed").distinct(), seed, dna, canonical, alphabet, windows=windows)
    found = read_seeds(reference.select(F.lit(0).alias("_k"), text), "_k", text, seed, dna, canonical, alphabet)
    return Index(found.select("seed").distinct(), seed, dna, canonical, alphabet, windows=windows)


def index_of_fasta(spark: SparkSession, path: str, seed: Seed, canonical: bool = True, alphabet: str = "strict", stretch: int = seeds.PIECE, **options) -> Index:
    """The index of FASTA files, which are read in ranges (``split`` bytes) by many tasks, each in overlapping stretches: memory follows neither files nor contigs."""
    from tessera.sources.ranges import read_fasta_stretches

    own = build_index(read_fasta_stretches(spark, path, stretch, seed.span - 1, **options), "seq", seed, True, canonical, alphabet)
    own.windows = None  # files are not read once more for their length
    return own


def log2_buckets(bases: Column) -> Column:
    """The log2 of how many buckets of four slots a reference of so many bases needs, from 10 to 31."""
    slots = bases / TARGET_LOAD
    return F.least(F.lit(31), F.greatest(F.lit(10), F.ceil(F.log2(F.greatest(F.lit(1024.0), slots / SLOTS))))).cast("int")


def estimated_bases(name: Column, size: Column) -> Column:
    """About how many bases a file holds: compressed ones 3.5 for each byte."""
    return size * F.when(name.rlike(r"(?i)\.(gz|bgz)$"), 3.5).otherwise(1.0)


def bits_for(n: Column) -> Column:
    """The bits that tell n things apart."""
    return F.when(n <= 1, 0).otherwise(F.ceil(F.log2(n))).cast("int")


def approximate(codes: DataFrame, buckets_log2: int, code: str = "code") -> DataFrame:
    """``codes`` with hash, fp, low (the lesser bucket): what a two-bucket filter of 16-bit fingerprints can tell apart.

    A fingerprint's two buckets lead to each other, so the filter holds a key if and only if some key put in has the same
    (fp, low): an exact join on this pair gives the filter's answers, its false positives included.
    """
    hashed = codes.withColumn("hash", hashing.hash_mix(F.col(code)))
    first, second = hashing.bucket_pair(F.col("hash"), buckets_log2)
    return hashed.withColumn("fp", hashing.fingerprint(F.col("hash"))).withColumn("b1", first).withColumn("b2", second).withColumn("low", F.least("b1", "b2"))


def index_stats(codes: DataFrame, buckets_log2: int, code: str = "code") -> DataFrame:
    """inserted, failed, occupied, load_permille and saturated of the approximate filter."""
    kept = approximate(codes, buckets_log2, code).select("fp", "low").distinct()
    n = F.count("*")
    load = F.floor(n * 1000 / F.lit(SLOTS * 2**buckets_log2))
    return kept.agg(n.alias("inserted"), F.lit(0).cast("long").alias("failed"), n.alias("occupied"), load.alias("load_permille"), (load > WARN_LOAD * 10).alias("saturated"))


@dataclass(frozen=True)
class NativeLayout:
    """Where slots lie in a published bit-packed filter."""

    fingerprint_bits: int
    window_size: int
    windows: int
    slots: int
    subfilters: int

    @property
    def offset_bits(self) -> int:
        return 0 if self.window_size <= 1 else math.ceil(math.log2(self.window_size))

    @property
    def slot_bits(self) -> int:
        return self.fingerprint_bits + self.offset_bits + 1

    @property
    def window_bits(self) -> int:
        return self.slot_bits * self.window_size

    @property
    def slots_each(self) -> int:
        """Slots of a subfilter."""
        return -(-self.slots // self.subfilters)

    @property
    def subfilter_bits(self) -> int:
        used = self.slots_each * self.slot_bits
        return used + 512 - used % 512


def layout_bits(fingerprint: Column, window_size: Column, subfilters: Column, slots: Column) -> tuple[Column, Column, Column]:
    """Bits of a slot, a window and a subfilter as :class:`NativeLayout` has them, of columns."""
    slot = (fingerprint + bits_for(window_size) + 1).cast("int")
    used = F.floor((slots + subfilters - 1) / subfilters) * slot
    return slot, (slot * window_size).cast("int"), (used + 512 - used % 512).cast("long")
