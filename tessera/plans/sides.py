"""Both sides of a split under the names of their files, and many samples in one go.

Each task that reads and decides records writes them at once, in the order in which they come: a part of each side for each run of records that follow one another in a file. Parts are put into the
two files of their input (``X.matched.fastq.gz`` and ``X.unmatched.fastq.gz``) in the order of the records, each at its place, by many tasks; as gzip members one after the other
are a gzip file, they are copied as they are. Nothing is sorted or dealt anew. Which parts count is what tasks have reported: the parts of attempts that failed are left behind and removed with
the job's folder. A file gets its name when it is whole and takes the place of an older one, so a rerun gives the same files.

A sample whose files can't be read, or whose mates differ in number, is reported with its error; the others are written.
"""

from __future__ import annotations

import gzip as gz
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.index import Index
from tessera.plans.split import RECORD, split_read_pairs, split_reads
from tessera.sources import compressed, ranges
from tessera.sources.published import PublishedIndex
from tessera.sources.shared import as_local, workspace

PART = "name string, matched boolean, first long, path string, size long, records long"
PIECE = 8 << 20


class Run:
    """Two open parts for records of a file that follow one another."""

    def __init__(self, folder: str, name: str, first: int, gzip: bool):
        self.folder, self.name, self.first, self.gzip = folder, name, first, gzip
        self.next, self.open, self.records = first, {}, {True: 0, False: 0}

    def write(self, matched: bool, text: pa.Array) -> None:
        if not len(text):
            return
        if matched not in self.open:
            path = f"{self.folder}/{uuid.uuid4().hex}"
            f = open(path, "wb")
            self.open[matched] = path, f, compressed.Packer(f, "gzip" if self.gzip else "none")
        self.open[matched][2].write(("\n".join(text.to_pylist()) + "\n").encode("latin-1", "replace"))
        self.records[matched] += len(text)

    def close(self) -> list[tuple]:
        out = []
        for side in (True, False):
            path, size = None, 0
            if side in self.open:
                path, f, packer = self.open[side]
                packer.close()
                size = f.tell()
                f.close()
            out.append((self.name, side, self.first, path, size, self.records[side]))
        return out


def write_sides(split: DataFrame, out: str, gzip: bool = False, name: str = "sample") -> DataFrame:
    """Write both sides of split records (with dense ordinals, as read in ranges) below ``out``; returns file, matched, output, records and bytes.

    ``name``: the column with the name of a record's file. Records of a file must come in runs of ascending ordinals, as readers hand them out; where runs of one file are the same, two files share a name: an error.
    """
    spark, out = split.sparkSession, as_local(out)
    folder = f"{out}/_parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows = split.select(F.col(f"`{name}`").alias("name"), F.col("ordinal").cast("long").alias("ordinal"), "matched", *(F.coalesce(c, F.lit("")).alias(c) for c in RECORD))

    def write(batches):
        open_: dict[str, Run] = {}  # by file: mates come in turn
        for b in batches:
            if not b.num_rows:
                continue
            name_, all_ordinals = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            all_text = pc.binary_join_element_wise(*b.columns[3:], "\n")
            which, here = name_.indices.to_numpy(), name_.dictionary.to_pylist()
            for own in [x for x in open_ if x not in here]:
                yield from ranges.table(open_.pop(own).close(), PART).to_batches()
            for w, own in enumerate(here):
                rows_ = np.flatnonzero(which == w)
                ordinal, text, side_ = all_ordinals[rows_], all_text.take(pa.array(rows_)), b.column(2).take(pa.array(rows_))
                cuts = np.flatnonzero(np.diff(ordinal) != 1) + 1
                for a, e in zip([0, *cuts], [*cuts, len(ordinal)]):
                    run = open_.get(own)
                    if run is None or run.next != ordinal[a]:
                        if run is not None:
                            yield from ranges.table(run.close(), PART).to_batches()
                        run = open_[own] = Run(folder, own, int(ordinal[a]), gzip)
                    side = side_.slice(a, e - a)
                    for matched in (True, False):
                        run.write(matched, text.slice(a, e - a).filter(pc.equal(side, matched)))
                    run.next = int(ordinal[e - 1]) + 1
        for run in open_.values():
            yield from ranges.table(run.close(), PART).to_batches()

    try:
        kept = f"{workspace(spark, 'sides')}/parts"
        rows.mapInArrow(write, PART).write.parquet(kept)  # the parts that count
        parts = spark.read.schema(PART).parquet(kept)
        own = Window.partitionBy("name", "matched")  # a row for each range of a file
        before = F.sum("size").over(own.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
        twice = F.count("*").over(Window.partitionBy("name", "matched", "first")) > 1
        output = F.when(F.col("matched"), names.output_name(F.col("name"), True, gzip)).otherwise(names.output_name(F.col("name"), False, gzip))
        placed = parts.withColumns({"at": F.coalesce(before, F.lit(0)), "output": output, "twice": twice})
        placed = placed.where(F.when(F.col("twice"), F.raise_error(F.concat(F.lit("two files are named "), F.col("name"))).cast("boolean")).otherwise(F.lit(True)))

        def copy(batches):
            for b in batches:
                for r in b.to_pylist():
                    with open(os.open(f"{folder}/{r['output']}", os.O_RDWR | os.O_CREAT), "r+b") as to:
                        to.seek(r["at"])
                        if r["path"]:
                            with open(r["path"], "rb") as f:
                                while piece := f.read(PIECE):
                                    to.write(piece)
                yield b

        columns = "output string, name string, matched boolean, at long, path string, size long, records long"
        done = placed.select(*(c.split()[0] for c in columns.split(", "))).repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(copy, columns)
        made = done.groupBy(F.col("name").alias("file"), "matched", "output").agg(F.sum("records").alias("records"), F.sum("size").alias("bytes")).collect()  # two rows a file
        for r in made:
            here = f"{folder}/{r.output}"
            if os.path.getsize(here) != r.bytes:
                raise OSError(f"{r.output}: {os.path.getsize(here)} of {r.bytes} bytes were written")
            if gzip and not r.bytes:
                with open(here, "wb") as f:
                    f.write(gz.compress(b"", mtime=0))
        for r in made:
            os.replace(f"{folder}/{r.output}", f"{out}/{r.output}")
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return spark.createDataFrame(made, "file string, matched boolean, output string, records long, bytes long")


def split_all(spark: SparkSession, samples: DataFrame, index: Index | PublishedIndex, out: str, permille: int = 500, gzip: bool = False, max_length: int | None = None, **options) -> DataFrame:
    """Split all samples (sample, r1 and r2, which is null for single files) at once: sample, error, paired, reads, matched and pct of each.

    A first job maps all files and finds the broken ones; a second one reads, decides and writes all others. Counts of pairs are of their reads.
    """
    listed = [(r["sample"], r["r1"], r["r2"]) for r in samples.select("sample", "r1", "r2").collect()]  # names of files
    records, errors = [], None
    for paired in (False, True):
        some = [r for r in listed if (r[2] is not None) == paired]
        if not some:
            continue
        rows, broken = ranges.read_samples(spark, some, **options)
        said = split_read_pairs(rows, index, permille, max_length) if paired else split_reads(rows, index, permille, max_length=max_length)
        records.append(said.select("sample", "file", "mate", "ordinal", *RECORD, "matched"))
        errors = broken if errors is None else errors.unionByName(broken)
    if not records:
        return spark.createDataFrame([], "sample string, error string, paired boolean, reads long, matched long, pct double")
    both = records[0] if len(records) == 1 else records[0].unionByName(records[1])
    made = write_sides(both, out, gzip, name="file")
    of = spark.createDataFrame([(s, os.path.basename(f), r2 is not None) for s, r1, r2 in listed for f in (r1, r2) if f is not None], "sample string, file string, paired boolean")
    counts = of.join(made, "file", "left").groupBy("sample", "paired").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("reads"), F.coalesce(F.sum(F.when(F.col("matched"), F.col("records"))), F.lit(0)).alias("matched"))
    pct = F.when(F.col("reads") > 0, F.col("matched") * 100.0 / F.col("reads")).otherwise(0.0)
    return counts.join(errors, "sample", "left").select("sample", "error", "paired", "reads", "matched", pct.alias("pct"))
