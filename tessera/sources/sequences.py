"""FASTQ and FASTA as Python data sources: ``spark.read.format("fastq").load(path)``; streams of files: :func:`tessera.streaming.split.read_fastq_stream`.

Plain and block-gzip FASTQ files are cut into ranges of ``split`` bytes (128 MB; 0: whole files), which are the tasks; other gzip files can't be cut. A record
belongs to the range that holds the newline before it, and is found there by its marks (``@``, and ``+`` two lines on). ``ordinal`` counts
the records of a file; in a file of several ranges it counts within each range, the range's number standing from bit 40 on: ascending through the file, and
made dense by :func:`dense_ordinals`. FASTA files are read by one task each, as whole contigs or in stretches of ``stretch`` bases that overlap by ``overlap``.

Paths are opened as files of the machine or of a mounted shared store. On stores that only Spark reads, :func:`numbered_lines` reads the lines of text files
(plain, or with a codec that Hadoop knows), and :func:`fastq_from_text` or :func:`fasta_from_text` frame them.

Options: ``keepcr`` (default false: a carriage return at a line's end is removed), ``lastrecord`` (default true: a
record without a final newline is kept), ``permissive`` (bytes after the last block of a file end it quietly), ``sample`` and ``mate`` (values of these columns).
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.sources import compressed
from tessera.sources.shared import as_local

FASTQ_SCHEMA = "sample string, mate int, ordinal bigint, header string, seq string, plus string, qual string"
FASTA_SCHEMA = "file string, contig_ordinal int, header string, seq string"
STRETCH_SCHEMA = "file string, contig_ordinal int, header string, start bigint, seq string"
BATCH = 4096
SPLIT = 128 << 20
#: From this bit on an ordinal has the number of the file's range.
RANGE_BIT = 40


class FileRange(InputPartition):
    """The bytes from ``start`` up to ``end`` (None: all) of a file, its ``number``-th range."""

    def __init__(self, path: str, start: int = 0, end: int | None = None, number: int = 0):
        super().__init__(path)
        self.start, self.end, self.number = start, end, number


class FileRanges(InputPartition):
    """Ranges that one task reads one after another."""

    def __init__(self, parts: list[FileRange]):
        super().__init__(None)
        self.parts = parts


#: Bytes of small ranges that one task reads, where there are more than BOUND ranges.
TASK, BOUND = 32 << 20, 64


def grouped(parts: list[FileRange]) -> list[FileRanges]:
    """Ranges put together for tasks: each its own up to BOUND of them, else neighbours of about TASK bytes, in BOUND tasks at least."""
    size = [(os.path.getsize(p.value) if p.end is None else p.end) - p.start for p in parts]
    most = 0 if len(parts) <= BOUND else min(TASK, sum(size) // BOUND)
    out, held = [], 0
    for p, n in zip(parts, size):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(p)
        held += n
    return [FileRanges(x) for x in out]


def _files(options) -> list[str]:
    path = as_local(options.get("path", ""))
    found = [path] if os.path.isfile(path) else sorted(glob.glob(path)) if glob.has_magic(path) else sorted(os.path.join(path, x) for x in os.listdir(path) if x[0] not in "._") if os.path.isdir(path) else []
    if not found:
        raise FileNotFoundError(f"no files at {path!r}")
    return found


def _ranges(paths: list[str], options) -> list[FileRange]:
    step, out = int(options.get("split", SPLIT)), []
    for p in paths:
        size = os.path.getsize(p)
        if not step or size <= step or not compressed.can_be_split(p):
            out.append(FileRange(p))
        else:
            out += [FileRange(p, at, min(at + step, size), k) for k, at in enumerate(range(0, size, step))]
    return out


def _true(options, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def fastq_records(path: str, keep_cr: bool = False, last: bool = True, permissive: bool = False, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """Four lines a record; neither marks nor the length of qualities are checked in a file that is read as a whole."""
    lines = compressed.marked_lines(compressed.marked_stream(path, permissive, start, end))
    inside, held = True, []  # whether the newline before the next record lies in the range; lines read ahead
    if start:
        first = next(lines, None)
        if first is None or not first[1]:
            return
        while len(held) < 7 and (x := next(lines, None)) is not None:
            held.append(x)
        skip = next((k for k in range(4) if len(held) > k + 2 and held[k][0][:1] == b"@" and held[k + 2][0][:1] == b"+"), None)
        if skip is None:
            if len(held) == 7:
                raise ValueError(f"{path}: no record begins after byte {start}; read the file with split=0")
            return  # the rest of the last record
        inside = skip == 0 or held[skip - 1][1]
        del held[:skip]
    four: list[bytes] = []
    whole = None
    ended: bool | None = True
    while True:
        x = held.pop(0) if held else next(lines, None)
        if x is None:
            break
        if not four and not inside:
            if whole is not None:
                yield whole
            return
        line, ended = x
        four.append(line if keep_cr else line.removesuffix(b"\r"))
        if len(four) == 4:
            if whole is not None:
                yield whole
            whole, four, inside = tuple(four), [], ended is not False
    if whole is not None and (last or ended is not None or four):
        yield whole
    if four and last and len(four) == 3 and ended is not None:
        yield (*four, b"")  # an empty last line


def fastq_batches(part: FileRange, o) -> Iterator[pa.RecordBatch]:
    """The records of a range of a file, by the source's options."""
    sample, mate = o.get("sample", os.path.basename(part.value)), int(o.get("mate", 0))
    rows: list[tuple] = []
    first = part.number << RANGE_BIT

    def batch():
        cols = [pa.array([x[k].decode("latin-1") for x in rows], pa.string()) for k in range(4)]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([sample] * n, pa.string()), pa.array([mate] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), *cols], names=["sample", "mate", "ordinal", "header", "seq", "plus", "qual"])

    for r in fastq_records(part.value, _true(o, "keepcr", False), _true(o, "lastrecord", True), _true(o, "permissive", False), part.start, part.end):
        rows.append(r)
        if len(rows) == BATCH:
            yield batch()
            first += len(rows)
            rows = []
    if rows:
        yield batch()


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return grouped(_ranges(_files(self.options), self.options))

    def read(self, partition):
        for part in partition.parts:
            yield from fastq_batches(part, self.options)


class FastqWriter(DataSourceArrowWriter):
    """Writes records to parts of a folder; parts count only once the job commits. ``compression``: none, gzip, members (a gzip member for each batch) or bgzf.

    Parts and their temporary folder have the job's own name, so an append adds to what is there and jobs do not touch each other's files. Overwriting
    moves the new parts in first and then removes those that were there; a job that fails removes only its own.
    """

    def __init__(self, options, overwrite: bool):
        self.job = uuid.uuid4().hex
        self.path = as_local(options.get("path", ""))
        self.compression = options.get("compression", "gzip" if _true(options, "gzip", False) else "none")
        self.overwrite = overwrite

    def write(self, batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        os.makedirs(self.temporary, exist_ok=True)
        name = f"part-{ctx.partitionId():05d}-{self.job}.fastq" + {"none": "", "gzip": ".gz", "members": ".gz", "bgzf": ".bgz"}[self.compression]
        temporary = f"{self.temporary}/{ctx.taskAttemptId()}-{name}"
        n = 0
        with open(temporary, "wb") as f:
            out = compressed.Packer(f, self.compression)
            for b in batches:
                rows = b.to_pydict()
                out.write("".join(f"{x or ''}\n" for r in zip(*(rows[c] for c in ("header", "seq", "plus", "qual"))) for x in r).encode("latin-1"))
                n += b.num_rows
            out.close()
        return Written(temporary, name, n)

    @property
    def temporary(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def commit(self, messages):
        old = glob.glob(f"{glob.escape(self.path)}/part-*.fastq*") if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.temporary, f"{self.path}/{m.name}")
        for p in old:
            os.remove(p)
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        shutil.rmtree(self.temporary, ignore_errors=True)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, name: str, records: int):
        self.temporary, self.name, self.records = temporary, name, records


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return FASTQ_SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)

    def writer(self, schema, overwrite):
        return FastqWriter(self.options, overwrite)


def fasta_stretches(path: str, stretch: int | None = None, overlap: int = 0, permissive: bool = False) -> Iterator[tuple[int, str, int, str]]:
    """(ordinal, header, start, sequence) of contigs, in stretches that overlap (None: whole ones).

    A line that begins with ``>`` opens a contig, line ends within one do not cut it. What a stretch holds is all that is held.
    """
    ordinal, header, parts, size, start = 0, None, [], 0, 0

    def rest():
        return ordinal, header or "", start, b"".join(parts).decode("latin-1")

    for line in compressed.lines(compressed.stream(path, permissive)):
        line = line.replace(b"\r", b"")
        if line[:1] == b">":
            if header is not None or parts:
                yield rest()
                ordinal += 1
            header, parts, size, start = line[1:].decode("latin-1"), [], 0, 0
            continue
        for at in range(0, len(line), stretch or len(line) or 1):  # long lines too
            part = line[at : at + (stretch or len(line))]
            parts.append(part)
            size += len(part)
            if stretch and size >= stretch + overlap:
                whole = b"".join(parts)
                yield ordinal, header or "", start, whole.decode("latin-1")
                start += len(whole) - overlap
                parts = [whole[len(whole) - overlap :]] if overlap else []
                size = overlap
    if header is not None or parts:
        yield rest()


def fasta_contigs(path: str, permissive: bool = False) -> Iterator[tuple[str, str]]:
    """(header, sequence) of whole contigs."""
    for _, header, _, seq in fasta_stretches(path, permissive=permissive):
        yield header, seq


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [FileRange(p) for p in _files(self.options)]

    def read(self, partition):
        name, o = os.path.basename(partition.value), self.options
        stretch = int(o["stretch"]) if "stretch" in o else None
        for k, header, start, seq in fasta_stretches(partition.value, stretch, int(o.get("overlap", 0)), _true(o, "permissive", False)):
            yield (name, k, header, start, seq) if stretch else (name, k, header, seq)


class FastaSource(DataSource):
    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return STRETCH_SCHEMA if "stretch" in self.options else FASTA_SCHEMA

    def reader(self, schema):
        return FastaReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats ``fastq`` and ``fasta`` known to a session."""
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastaSource)


def dense_ordinals(records: DataFrame) -> DataFrame:
    """Records with ordinals that count through files of several ranges: the ranges' counts are summed up and joined back."""
    at = F.shiftright("ordinal", RANGE_BIT)
    each = records.groupBy("sample", "mate", at.alias("_range")).count()
    before = F.sum("count").over(Window.partitionBy("sample", "mate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("sample", "mate", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("ordinal") - F.shiftleft("_range", RANGE_BIT)
    return records.withColumn("_range", at).join(each, ["sample", "mate", "_range"]).withColumn("ordinal", within + F.col("_before")).select(*records.columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0) and value of text files in any store that Spark reads, many tasks a file.

    Lines keep their order within a block of a file; the blocks' counts of lines, summed up, are joined back.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    each = read.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each block
    return read.join(each, ["file", "_block"]).select("file", (F.col("_row") - F.col("_first") + F.col("_before")).alias("line_no"), "value")


def fastq_from_text(lines: DataFrame, file: str = "file", number: str = "line_no", text: str = "value") -> DataFrame:
    """file, ordinal and the four fields, from numbered lines (from 0) of each file; incomplete records are left out."""
    four = lines.select(F.col(file).alias("file"), F.floor(F.col(number) / 4).alias("ordinal"), (F.col(number) % 4).alias("k"), F.regexp_replace(text, "\r$", "").alias("value"))
    field = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    out = four.groupBy("file", "ordinal").agg(field(0).alias("header"), field(1).alias("seq"), field(2).alias("plus"), field(3).alias("qual"))
    return out.where("qual is not null")


def fasta_from_text(lines: DataFrame, file: str = "file", number: str = "line_no", text: str = "value") -> DataFrame:
    """file, contig_ordinal, header and seq, from numbered lines of each file."""
    rows = lines.select(F.col(file).alias("file"), F.col(number).alias("n"), F.regexp_replace(text, "\r", "").alias("value"))
    head = F.startswith("value", F.lit(">"))
    opened = F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct("n", "value"))))
    out = rows.withColumn("c", opened).groupBy("file", "c").agg(F.max(F.when(head, F.expr("substring(value, 2)"))).alias("header"), F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("seq"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("c")) - 1
    return out.where("header is not null or seq != ''").select("file", order.alias("contig_ordinal"), F.coalesce("header", F.lit("")).alias("header"), "seq")
