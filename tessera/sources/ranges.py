"""Maps of files: what a first pass over ranges finds, so that a second one starts anywhere and knows where it is.

FASTQ. A range is a stretch of a plain file, of the blocks of a block-gzip file, or of the members of another gzip file. The first pass counts the line ends of each; summed up
over a file they give the number of the line in which a range begins. So records are framed by their lines alone, ordinals are dense, and mates are
read together: a task opens R2 at the record with which its range of R1 begins, and a pair is one row.

Members of a gzip file are found without reading it from its start: tasks look for marks of members in their part of the file (a mark may lie across
parts), and inflate from each to its end. Compressed data hold such marks by chance, and may hold whole members that are no members of the file; the file's own are those that form
a chain from its first byte to its end, each beginning where the one before ends.

FASTA. The first pass tells how many contigs begin in a range, the last one's header, and the bases before the first and after the last; a range so knows its contig and its place in it. A
range's bases overlap those of the next by ``overlap``, so that each window lies in one of them whole.

A map has one row a range (128 MB) or member; a file's rows meet in one task, what is read meets nowhere. Paths are opened on a mounted store. The options are those of
:mod:`tessera.sources.sequences`.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import compressed
from tessera.sources.sequences import BATCH, FASTQ_SCHEMA, SPLIT, STRETCH_SCHEMA, _files, _true
from tessera.sources.shared import as_local, workspace

RANGE = "file string, number int, start long, end long, members boolean"
LINES = f"{RANGE}, lines long, open boolean, bytes long, error string"
#: The first line's number in a range (also if it began before), whether the range begins with a line, how many records the file has, and what is wrong with it.
PLACED = f"{RANGE}, line long, fresh boolean, records long, error string"
PAIR_FIELDS = ("header", "seq", "plus", "qual")
PAIR_SCHEMA = "sample string, ordinal long, file_1 string, file_2 string, " + ", ".join(f"{c}_{m} string" for m in (1, 2) for c in PAIR_FIELDS)


#: Stored bytes of ranges that one task reads at least, one range after another, where there are more ranges than BOUND.
TASK, BOUND = 32 << 20, 64


def tasks_for(files: list[str], split: int) -> int:
    """A task for each range; beyond BOUND of them a task reads many small ones, so the number of tasks follows the bytes."""
    ranges, total = sum(-(-max(1, os.path.getsize(f)) // split) for f in files), sum(os.path.getsize(f) for f in files)
    return max(1, min(ranges, 20_000, max(BOUND, -(-total // TASK))))


def near(files: list[str], split: int) -> int:
    """How many ranges that follow one another are read by one task: all of a task's, but in four stretches."""
    return max(1, sum(-(-max(1, os.path.getsize(f)) // split) for f in files) // (8 * tasks_for(files, split)))  # of two files a pair


def step_of(options: dict) -> int:
    return int(options.get("split", SPLIT)) or 1 << 62


def dealt(spark: SparkSession, files: list[str], split: int) -> DataFrame:
    """The ranges of files, one row each, dealt out to tasks (so many of them: rows this small would else be put together in one task); where members are still to be found, of compressed bytes."""
    rows = spark.createDataFrame([(f, os.path.getsize(f), compressed.kind(f) == "members") for f in files], "file string, size long, members boolean")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start")
    rows = rows.select("file", "size", "members", begin)
    rows = rows.select("file", (F.col("start") / split).cast("int").alias("number"), "start", F.least(F.col("start") + split, F.col("size")).alias("end"), "members")
    return rows.repartition(tasks_for(files, split))


def table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in names.split(", ")]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, list(zip(*rows)) or [()] * len(fields))})


# --- members ------------------------------------------------------------------------------------------------


def member_starts(path: str, start: int, end: int) -> Iterator[int]:
    """Places from ``start`` to below ``end`` where a member's head may begin."""
    with open(path, "rb") as f:
        f.seek(start)
        at, data = start, b""
        while at < end:
            piece = f.read(min(compressed.PIECE, max(end + 9 - at - len(data), 1)))  # a head may lie across the end
            data += piece
            k = data.find(b"\x1f\x8b\x08")
            while 0 <= k and at + k < end and (len(data) - k >= 10 or not piece):
                if compressed.plausible_head(data[k : k + 10]):
                    yield at + k
                k = data.find(b"\x1f\x8b\x08", k + 1)
            if not piece:
                return
            keep = 9  # a head may lie across
            at, data = at + len(data) - min(keep, len(data)), data[-keep:]


def inflated_member(path: str, start: int) -> tuple[int, int, int, bool] | None:
    """End, bytes, line ends and whether the last line is open, of the member that begins here; None if none does."""
    size = lines = 0
    last = b"\n"
    out = zlib.decompressobj(31)
    try:
        with open(path, "rb") as f:
            f.seek(start)
            at = start
            while data := f.read(compressed.PIECE):
                at += len(data)
                while data and not out.eof:  # bounded pieces, however well they are packed
                    got = out.decompress(data, compressed.PIECE)
                    size, lines, last = size + len(got), lines + got.count(b"\n"), got[-1:] or last
                    data = out.unconsumed_tail
                if out.eof:
                    return at - len(out.unused_data), size, lines, last != b"\n"
    except zlib.error:
        return None
    return None


def chained(rows: pa.Table, permissive: bool, split: int) -> list[tuple]:
    """A file's own members among those found, in ranges of about ``split`` stored bytes: rows of :data:`LINES`."""
    path, size = rows["file"][0].as_py(), os.path.getsize(rows["file"][0].as_py())
    found = {r["start"]: r for r in rows.to_pylist()}
    out, at = [], 0
    while at < size:
        own = found.get(at)
        if own is None:
            with open(path, "rb") as f:
                f.seek(at)
                padded = not any(piece.strip(b"\0") for piece in iter(lambda: f.read(compressed.PIECE), b""))
            if padded or permissive:
                break
            raise ValueError(f"{path}: no gzip member at byte {at}")
        if out and own["end"] - out[-1][2] <= split:  # one more for the range
            f, k, s, _, m, lines, open_, n = out[-1]
            out[-1] = (f, k, s, own["end"], m, lines + own["lines"], own["open"] if own["bytes"] else open_, n + own["bytes"])
        else:
            out.append((path, len(out), at, own["end"], True, own["lines"], own["open"], own["bytes"]))
        at = own["end"]
    return out


# --- FASTQ --------------------------------------------------------------------------------------------------


def pieces_of(path: str, start: int, end: int, members: bool, permissive: bool) -> Iterator[tuple[bytes, bool]]:
    """The bytes from a range's start on, and whether they lie in it."""
    return compressed.member_stream(path, start, end, permissive) if members else compressed.marked_stream(path, permissive, start, end)


def line_map(spark: SparkSession, files: list[str], split: int, options: dict, tolerant: bool = False) -> DataFrame:
    """The ranges of all files with the place of their first line (:data:`PLACED`). ``tolerant``: a file that can't be read gives one row with the error."""
    permissive, last_counts = _true(options, "permissive", False), _true(options, "lastrecord", True)

    def counted(r: dict) -> list[tuple]:
        if r["members"]:
            found = [(at, inflated_member(r["file"], at)) for at in member_starts(r["file"], r["start"], r["end"])]
            # a first row, so that a file without any member is heard of
            return [(r["file"], r["number"], -1, -1, True, 0, False, 0, None)] + [(r["file"], r["number"], at, m[0], True, m[2], m[3], m[1], None) for at, m in found if m is not None]
        lines, size, last = 0, 0, b"\n"
        for piece, inside in compressed.marked_stream(r["file"], permissive, r["start"], r["end"]):
            if not inside:
                break
            lines, size, last = lines + piece.count(b"\n"), size + len(piece), piece[-1:] or last
        return [(*r.values(), lines, last != b"\n", size, None)]

    def count(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    out += counted(r)
                except Exception as e:  # noqa: BLE001  whatever the file holds
                    if not tolerant:
                        raise
                    out.append((*r.values(), 0, False, 0, str(e)))
            yield from table(out, LINES).to_batches()

    def place(rows: pa.Table) -> pa.Table:
        path, wrong = rows["file"][0].as_py(), pc.drop_null(rows["error"].combine_chunks()).to_pylist()
        rows = rows.sort_by([("number", "ascending"), ("start", "ascending")])
        try:
            every = [] if wrong else chained(rows, permissive, split) if rows["members"][0].as_py() else [tuple(r.values())[:-1] for r in rows.to_pylist()]
        except ValueError as e:
            if not tolerant:
                raise
            wrong = [str(e)]
        if wrong:
            return table([(path, 0, 0, 0, False, 0, True, 0, wrong[0])], PLACED)
        out, line, fresh = [], 0, True
        for *of, lines, open_, size in every:
            out.append((*of, line, fresh))
            line += lines
            fresh = fresh if not size else not open_
        whole, more = divmod(line + (not fresh), 4)
        if last_counts:
            whole += more == 3 and fresh  # its last line is empty
        elif not more and not fresh:
            whole -= 1
        return table([(*r, whole, None) for r in out], PLACED)

    return dealt(spark, files, split).mapInArrow(count, LINES).groupBy("file").applyInArrow(place, PLACED)


@dataclass
class Lines:
    """The lines of a file from a range on, numbered; ``inside`` tells whether the last one handed out began before the range's end."""

    path: str
    start: int
    end: int
    members: bool
    line: int
    fresh: bool
    keep_cr: bool
    permissive: bool
    last_counts: bool

    def __iter__(self) -> Iterator[tuple[int, bytes, bool, bool]]:
        """(number, text, whether it began inside, whether it has an end)."""
        number, inside = self.line, True  # whether the line at hand began in the range
        rest, began = b"", self.fresh
        for piece, within in pieces_of(self.path, self.start, self.end, self.members, self.permissive):
            if not rest and began:
                inside = within
            *whole, tail = piece.split(b"\n")
            for text in whole:
                if began:
                    yield number, self.trimmed(rest + text), inside, True
                rest, began, number, inside = b"", True, number + 1, within
            rest = rest + tail if began else b""
        if rest and began:
            yield number, self.trimmed(rest), inside, False

    def trimmed(self, text: bytes) -> bytes:
        return text if self.keep_cr else text.removesuffix(b"\r")

    def records(self, first: int | None = None) -> Iterator[tuple[int, list[str]]]:
        """(ordinal, four fields) of the records that begin in the range; with ``first``, of all from that one on, wherever the range ends."""
        four: list[str] = []
        number, ended = 0, True
        for number, text, inside, ended in self:
            if not four and (number % 4 or (first is not None and number < 4 * first)):
                continue
            if not four and first is None and not inside:
                return
            four.append(text.decode("latin-1"))
            if len(four) == 4 and (ended or self.last_counts):
                yield number // 4, four
                four = []
        if len(four) == 3 and ended and self.last_counts:
            yield number // 4, [*four, ""]  # an empty last line


def opened(r: dict, o: dict) -> Lines:
    return Lines(r["file"], r["start"], r["end"], r["members"], r["line"], r["fresh"], _true(o, "keepcr", False), _true(o, "permissive", False), _true(o, "lastrecord", True))


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of FASTQ files as the source ``fastq`` gives them, but read in ranges whatever the compression, with dense ordinals."""
    options = {k: str(v) for k, v in options.items()}
    files = _files(options | {"path": path})
    return records_of(line_map(spark, files, step_of(options), options), tasks_for(files, step_of(options)), options).drop("file")


def records_of(where: DataFrame, tasks: int, options: dict) -> DataFrame:
    """The records of mapped ranges, with the names of their files; a column ``sample`` of ``where`` is taken as it is."""
    schema = FASTQ_SCHEMA.replace("bigint", "long") + ", file string"

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                name, mate = os.path.basename(r["file"]), int(options.get("mate", 0))
                sample = r.get("sample", options.get("sample", name))
                rows: list[tuple] = []
                for ordinal, four in opened(r, options).records():
                    rows.append((sample, mate, ordinal, *four, name))
                    if len(rows) == BATCH:
                        yield from table(rows, schema).to_batches()
                        rows = []
                yield from table(rows, schema).to_batches()

    return where.repartition(tasks).mapInArrow(read, schema)


def read_samples(spark: SparkSession, samples: list[tuple[str, str, str | None]], **options) -> tuple[DataFrame, DataFrame]:
    """Records of (sample, path of R1, path of R2 or None), all of one kind, and sample and error of those whose files can't be read.

    Singles: as the source ``fastq`` gives them, and file. Pairs: :data:`PAIR_SCHEMA`. The map of all files is made and kept first, so what is broken is known before the records are read.
    """
    options = {k: str(v) for k, v in options.items()}
    listed = [(s, m, as_local(f)) for s, *both in samples for m, f in zip((1, 2), both) if f is not None]
    missing = [(s, f"no file {f}") for s, _, f in listed if not os.path.isfile(f)]
    listed = [x for x in listed if os.path.isfile(x[2])]
    files, split = sorted({f for *_, f in listed}), step_of(options)
    paired = any(r2 is not None for *_, r2 in samples)
    of = spark.createDataFrame(listed, "sample string, mate int, file string")
    kept = f"{workspace(spark, 'map')}/ranges"
    where = line_map(spark, files, split, options, tolerant=True) if files else spark.createDataFrame([], PLACED)
    where = of.join(where, "file")
    if paired:
        where = where.groupBy("sample").applyInArrow(lambda rows: met(rows, tolerant=True), MET)
    where.write.parquet(kept)
    where = spark.read.schema(where.schema).parquet(kept)
    errors = where.where("error is not null").select("sample", "error").unionByName(spark.createDataFrame(missing, "sample string, error string")).groupBy("sample").agg(F.min("error").alias("error"))
    sound = where.where("error is null").join(F.broadcast(spark.createDataFrame(missing, "sample string, error string").select("sample").distinct()), "sample", "left_anti")  # of the caller's list
    tasks = tasks_for(files, split) if files else 1
    return (pairs_of(sound, tasks, options, near(files, split) if files else 1) if paired else records_of(sound, tasks, options)), errors


_WAY = "file string, number int, start long, end long, members boolean, line long, fresh boolean"
MET = "sample string, first long, last long, error string, " + ", ".join(f"{f.split()[0]}_{m} {f.split()[1]}" for m in (1, 2) for f in _WAY.split(", "))


def met(rows: pa.Table, tolerant: bool = False) -> pa.Table:
    """For each range of R1 the records that begin in it, and the range of R2 in which the first of them begins: rows of :data:`MET`."""
    one, two = ([r for r in rows.sort_by([("number", "ascending")]).to_pylist() if r["mate"] == m] for m in (1, 2))
    sample = rows["sample"][0].as_py()
    count = [side[0]["records"] if side else 0 for side in (one, two)]
    wrong = next((r["error"] for r in one + two if r["error"] is not None), None)
    if wrong is None and count[0] != count[1]:
        wrong = f"{sample}: R1 and R2 differ in their number of records ({count[0]} and {count[1]})"
    if wrong is not None:
        if not tolerant:
            raise ValueError(wrong)
        return table([(sample, 0, 0, wrong, *[None] * (MET.count(",") - 3))], MET)
    first = [min(count[0], -(-(r["line"] + (not r["fresh"])) // 4)) for r in one] + [count[0]]
    names, out, at = [f.split()[0] for f in _WAY.split(", ")], [], 0
    whole = [r["line"] + (not r["fresh"]) for r in two]  # the first line that begins in a range
    for r, begin, end in zip(one, first, first[1:]):
        if begin == end:
            continue
        while at + 1 < len(two) and whole[at + 1] <= 4 * begin:
            at += 1
        out.append((sample, begin, end, None, *(side[n] for side in (r, two[at]) for n in names)))
    return table(out, MET)


def pairs_of(where: DataFrame, tasks: int, options: dict, near_each: int = 1) -> DataFrame:
    """The pairs of :data:`MET` ranges. Neighbours are dealt to one task, where there are more ranges than tasks, which reads on in both files from one to the next."""
    place = "sample", F.floor(F.col("number_1") / F.lit(max(1, near_each)))

    def read(batches):
        at, sides, files = None, [], []  # where the files that are open have been read to
        for b in batches:
            for r in b.to_pylist():
                if at == (r["sample"], r["first"]):
                    at = r["sample"], r["last"]
                    yield from pairs(r, sides, files)
                    continue
                at = r["sample"], r["last"]
                sides = [opened({k[:-2]: v for k, v in r.items() if k.endswith(f"_{m}")}, options).records(r["first"]) for m in (1, 2)]
                files = [os.path.basename(r[f"file_{m}"]) for m in (1, 2)]
                yield from pairs(r, sides, files)

    def pairs(r, sides, files):
        rows: list[tuple] = []
        for ordinal in range(r["first"], r["last"]):
            (k, a), (m, c) = (next(side, (-1, [])) for side in sides)
            if (k, m) != (ordinal, ordinal):
                raise ValueError(f"{r['sample']}: the files are not as they were mapped")
            rows.append((r["sample"], ordinal, *files, *a, *c))
            if len(rows) == BATCH:
                yield from table(rows, PAIR_SCHEMA).to_batches()
                rows = []
        yield from table(rows, PAIR_SCHEMA).to_batches()

    dealt_ = where.repartition(tasks) if near_each <= 1 else where.repartition(tasks, *place).sortWithinPartitions("sample", "first")
    return dealt_.mapInArrow(read, PAIR_SCHEMA)


def read_pairs(spark: SparkSession, pairs: DataFrame | list[tuple[str, str, str]], **options) -> DataFrame:
    """sample, ordinal, files and the fields of both mates (:data:`PAIR_SCHEMA`) of (sample, path of R1, path of R2), without a join of records.

    Files whose numbers of records differ are an error. What is shuffled are ranges; records go from the files to their row.
    """
    options = {k: str(v) for k, v in options.items()}
    listed = [tuple(p) for p in (pairs.select("sample", "r1", "r2").collect() if isinstance(pairs, DataFrame) else pairs)]  # names of files
    files = sorted({as_local(f) for _, *both in listed for f in both})
    of = spark.createDataFrame([(s, m, as_local(f)) for s, *both in listed for m, f in zip((1, 2), both)], "sample string, mate int, file string")
    where = of.join(line_map(spark, files, step_of(options), options), "file").groupBy("sample").applyInArrow(lambda rows: met(rows), MET)
    return pairs_of(where, tasks_for(files, step_of(options)), options, near(files, step_of(options)))


# --- FASTA --------------------------------------------------------------------------------------------------

SUMMARY = f"{RANGE}, lead long, mark boolean, lead_header string, broken boolean, headers long, before long, after long, last_header string, in_header boolean, line_start boolean"
STATE = f"{RANGE}, ordinal int, header string, offset long, in_header boolean, line_start boolean"


def events(pieces: Iterator[tuple[bytes, bool]], line_start: bool = True, in_header: bool = False) -> Iterator[tuple[str, bytes, bool]]:
    """(kind, bytes, whether inside) of a FASTA stream: ``open`` where a header begins, ``header`` with its text where it ends, ``bases`` without line ends, and ``line`` after each piece (a line end if a line begins next)."""
    held, inside = b"", True
    for piece, inside in pieces:
        piece, at = piece.replace(b"\r", b""), 0
        while at < len(piece):
            if in_header:
                stop = piece.find(b"\n", at)
                if stop < 0:
                    held += piece[at:]
                    break
                yield "header", held + piece[at:stop], inside
                held, in_header, line_start, at = b"", False, True, stop + 1
            elif line_start and piece[at : at + 1] == b">":
                yield "open", b"", inside
                in_header, at = True, at + 1
            else:
                stop = piece.find(b"\n>", at)
                bases = piece[at : stop if stop >= 0 else len(piece)].replace(b"\n", b"")
                if bases:
                    yield "bases", bases, inside
                line_start, at = stop >= 0 or piece.endswith(b"\n"), stop + 1 if stop >= 0 else len(piece)
        yield "line", b"\n" if line_start and not in_header else b"", inside
    if in_header:
        yield "header", held, inside


def summed_up(r: dict, permissive: bool) -> tuple:
    """What a range holds if nothing is known of what comes before: a row of :data:`SUMMARY`."""
    lead, mark, lead_header, broken = 0, False, b"", False

    def rest(pieces):
        """The bytes after the first line end; notes what comes before it."""
        nonlocal lead, mark, lead_header, broken
        for piece, inside in pieces:
            if broken:
                yield piece, inside
                continue
            piece = piece.replace(b"\r", b"")
            if not inside and not mark:
                return
            head, end, after = piece.partition(b"\n")
            if inside:
                mark = mark or (not lead and head[:1] == b">")
                lead += len(head)
                broken = bool(end)
            if mark:
                lead_header += head
            if end and not inside:
                return  # the end of a header that began here
            if broken:
                yield after, inside

    headers = before = after = 0
    last, in_header, line_start = b"", False, True
    for kind, data, inside in events(rest(pieces_of(r["file"], r["start"], r["end"], r["members"], permissive))):
        if kind == "header" and in_header:
            last = data
        if not inside:
            if in_header and kind != "header":
                continue  # its text goes on
            break
        if kind == "open":
            headers, after, in_header = headers + 1, 0, True
        elif kind == "header":
            in_header = False
        elif kind == "bases":
            after += len(data)
            before += len(data) * (not headers)
        else:
            line_start = bool(data)
    return (*r.values(), lead, mark, lead_header[1:].decode("latin-1"), broken, headers, before, after, last.decode("latin-1"), in_header, line_start)


def states(rows: pa.Table) -> pa.Table:
    """Of a file's summaries, what holds where each range begins: rows of :data:`STATE`. An ordinal of -1: before all contigs."""
    out, ordinal, header, offset, in_header, line_start = [], -1, "", 0, False, True
    for r in rows.sort_by([("number", "ascending"), ("start", "ascending")]).to_pylist():
        out.append((r["file"], r["number"], r["start"], r["end"], r["members"], ordinal, header, offset, in_header, line_start))
        if not r["lead"] and not r["broken"]:
            continue  # nothing in it
        if not in_header:
            if line_start and r["mark"]:
                ordinal, header, offset, in_header = ordinal + 1, r["lead_header"], 0, True
            elif r["lead"]:
                ordinal, offset = max(ordinal, 0), offset + r["lead"]
        line_start = line_start and not r["lead"]
        if r["broken"]:
            if r["before"] and ordinal < 0:
                ordinal = 0
            if r["headers"]:
                ordinal, header, offset = ordinal + r["headers"], r["last_header"], r["after"]
            else:
                offset += r["after"]
            in_header, line_start = r["in_header"], r["line_start"]
    return table(out, STATE)


def stretches_of(r: dict, stretch: int, overlap: int, permissive: bool) -> Iterator[tuple[int, str, int, str]]:
    """(ordinal, header, start, bases) of a range's stretches; the last of a range goes on by ``overlap`` bases of the next."""
    ordinal, header, start = r["ordinal"], r["header"], r["offset"]
    parts, size, more, known = [], 0, overlap, r["in_header"]  # known: the header at hand is
    fresh = False  # the contig began here, and none of it has been handed out

    def rest():
        return ordinal, header, start, b"".join(parts).decode("latin-1")

    for kind, data, inside in events(pieces_of(r["file"], r["start"], r["end"], r["members"], permissive), r["line_start"], r["in_header"]):
        if kind == "open":
            if not inside:
                break
            if parts or fresh:
                yield rest()
            ordinal, header, parts, size, start, fresh, known = ordinal + 1, "", [], 0, 0, True, False
        elif kind == "header":
            header, known = header if known else data.decode("latin-1"), False
        elif kind == "bases" and inside:
            ordinal = max(ordinal, 0)
            for at in range(0, len(data), stretch):
                parts.append(data[at : at + stretch])
                size += len(parts[-1])
                if size >= stretch + overlap:
                    whole = b"".join(parts)
                    yield ordinal, header, start, whole.decode("latin-1")
                    start, fresh = start + len(whole) - overlap, False
                    parts, size = [whole[len(whole) - overlap :]] if overlap else [], overlap
        elif kind == "bases":
            if not parts:
                fresh = False  # all of it lies in the ranges that follow
                break
            parts.append(data[:more])
            more -= len(parts[-1])
            if not more:
                break
    if parts or fresh:
        yield rest()


def read_fasta_stretches(spark: SparkSession, path: str, stretch: int, overlap: int, **options) -> DataFrame:
    """file, contig_ordinal, header, start and seq of stretches of all contigs (:data:`tessera.sources.sequences.STRETCH_SCHEMA`), read in ranges whatever the compression."""
    options = {k: str(v) for k, v in options.items()}
    permissive, split = _true(options, "permissive", False), step_of(options)
    files = _files(options | {"path": path})
    plain, members = ([f for f in files if (compressed.kind(f) == "members") == m] for m in (False, True))
    where = None
    if plain:
        where = dealt(spark, plain, split)
    if members:
        found = line_map(spark, members, split, options).select("file", "number", "start", "end", "members").repartition(tasks_for(members, split))
        where = found if where is None else where.unionByName(found)

    def summaries(batches):
        for b in batches:
            yield from table([summed_up(r, permissive) for r in b.to_pylist()], SUMMARY).to_batches()

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                name, rows, size = os.path.basename(r["file"]), [], 0
                for row in stretches_of(r, stretch, overlap, permissive):
                    rows.append((name, *row))
                    size += len(row[3])
                    if size > 1 << 22:
                        yield from table(rows, STRETCH_SCHEMA.replace("bigint", "long")).to_batches()
                        rows, size = [], 0
                yield from table(rows, STRETCH_SCHEMA.replace("bigint", "long")).to_batches()

    placed = where.mapInArrow(summaries, SUMMARY).groupBy("file").applyInArrow(states, STATE)
    return placed.repartition(tasks_for(files, split)).mapInArrow(read, STRETCH_SCHEMA)
