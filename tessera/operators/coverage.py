"""Coverage: how many characters of a record lie under seeds that the reference holds, and the verdict.

``probe``: each record is decided where it lies, without a shuffle (so it also serves streams). An index below a checked number of bytes is sent to the
tasks as sorted numbers; a larger one becomes a static filter (:mod:`tessera.operators.static_filter`) that tasks map. Windows that the filter finds are looked up in a sorted table of all seeds, which tasks
map as well, so verdicts are the same whatever the size (of text, windows are taken as equal if both of their prints are). ``join`` and ``verified`` are exact for indexes of any size, and rows of one key are taken together. Of bases, what is shuffled is the stretches that hits cover, not windows. Of text, ``join`` semi-joins every window, ``verified`` those that the filter finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessera.functions.seeds import PIECE, TOGETHER, Seed, base_table, codes_of, text_prints
from tessera.operators.index import Index, read_seeds

_U = np.uint64


# --- join ---------------------------------------------------------------------------------------------------


def seed_hits(rows: DataFrame, key: str, text: str, index: Index) -> DataFrame:
    """key and pos of the windows whose seed is in the index: bases in a narrow stage; for text Spark broadcasts a small index by itself."""
    if index.dna:
        return found_windows(rows, key, text, index, exact=True).select(key, "pos")
    found = read_seeds(rows.select(key, text), key, text, index.seed, index.dna, index.canonical, index.alphabet)
    return found.join(index.codes, "seed", "left_semi").select(key, "pos")


def found_windows(rows: DataFrame, key: str, text: str, index, exact: bool = False) -> DataFrame:
    """key, pos and seed of the windows that a prober finds, exact (for bases) or not: a narrow stage, in which records that hold none give no rows."""
    sent = SparkContext.getOrCreate().broadcast(index.prober() if exact else index.prober(False))
    dna, seed = index.dna, index.seed

    def run(batches):
        own = sent.value
        for batch in batches:
            for part, at, pos, hit, code in own.found([t or "" for t in batch.column(1).to_pylist()]):
                of = pa.array(code.view(np.int64)) if dna else pa.array(["".join(part[h + a : h + a + n] for a, n in seed.runs) for h in hit.tolist()], pa.string())
                for s in range(0, len(at), 1 << 16):
                    k = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[k])), pa.array(pos[k].astype(np.int32)), of[k]], names=[key, "pos", "seed"])

    kind = StructType([StructField(key, rows.schema[key].dataType), StructField("pos", IntegerType()), StructField("seed", LongType() if dna else StringType())])
    return rows.select(key, text).mapInArrow(run, kind)


def found_stretches(rows: DataFrame, key: str, text: str, index) -> DataFrame:
    """key, start and end of the stretches of bases under significant places of a record's hits: a narrow stage, in which records without a hit give no rows. Those of a long record may overlap."""
    sent = SparkContext.getOrCreate().broadcast(index.prober())

    def run(batches):
        own = sent.value
        for batch in batches:
            for at, start, end in own.stretches([t or "" for t in batch.column(1).to_pylist()]):
                for s in range(0, len(at), 1 << 16):
                    k = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[k])), *(pa.array(x[k].astype(np.int32)) for x in (start, end))], names=[key, "start", "end"])

    kind = StructType([StructField(key, rows.schema[key].dataType), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return rows.select(key, text).mapInArrow(run, kind)


def covered_by_hits(hits: DataFrame, key: str, seed: Seed) -> DataFrame:
    """key and covered: characters under at least one significant place of a hit.

    A contiguous seed covers up to the next hit; a spaced one is taken as its runs, whose union is measured.
    """
    if seed.weight == seed.span:
        after = F.lead("pos").over(Window.partitionBy(key).orderBy("pos"))
        part = F.least(F.lit(seed.span), F.coalesce(after - F.col("pos"), F.lit(seed.span)))
        return hits.select(key, part.alias("part")).groupBy(key).agg(F.sum("part").alias("covered"))
    runs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in seed.runs))
    spans = hits.select(key, "pos", F.explode(runs).alias("r")).select(key, (F.col("pos") + F.col("r.a")).alias("start"), (F.col("pos") + F.col("r.a") + F.col("r.n")).alias("end"))
    return covered_by_stretches(spans, key)


def covered_by_stretches(spans: DataFrame, key: str) -> DataFrame:
    """key and covered: characters in the union of a key's stretches."""
    before = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    return spans.select(key, part.alias("part")).groupBy(key).agg(F.sum("part").alias("covered"))


# --- probe --------------------------------------------------------------------------------------------------


class Prober:
    """Decides records against sorted seeds: numbers of two bits a base, or two prints of each text window.

    Records are laid end to end, so that each step serves many of them; a longer one is gone through in pieces.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray | None, *how):
        """``first``: seeds or first prints, ``second``: the second prints of text windows; ``how``: see :meth:`describe`."""
        self.describe(*how)
        order = np.argsort(first) if second is None else np.lexsort((second, first))
        self.known, self.second = first[order], None if second is None else second[order]
        same = np.flatnonzero(np.append(np.diff(self.known) != 0, True))
        self.most = int(np.diff(np.append(-1, same)).max(initial=1))  # windows that share a first print
        # a table of bits, 16 a seed at least, tells most windows that are not known apart from the rest
        self.shift = _U(64 - max(22, int(16 * len(self.known) - 1).bit_length() if len(self.known) else 0))
        flags = np.zeros(1 << (64 - int(self.shift)), bool)
        flags[self.slot(self.known)] = True
        self.table = np.packbits(flags, bitorder="little")

    def describe(self, seed: Seed, dna: bool, canonical: bool, alphabet: str) -> None:
        self.seed, self.dna, self.canonical = seed, dna, canonical
        self.lut = base_table(alphabet) if dna else None

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("latin-1", "replace"), np.uint8) if self.dna else np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)

    def windows(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Codes of all windows, and which are valid (None: all)."""
        return codes_of(points, self.seed, self.lut, self.canonical) if self.dna else (text_prints(points, self.seed), None)

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Places of known windows, codes of all windows, and which are valid."""
        code, good = self.windows(points)
        hit = self.known_at(code)
        if good is not None:
            hit = hit[good[hit]]
        elif getattr(self, "second", None) is not None and len(hit):  # the second print decides
            own = self.ordered(code[hit])
            want, at, same = text_prints(points, self.seed, 1, hit), np.searchsorted(self.known, own), np.zeros(len(hit), bool)
            for k in range(self.most):
                i = np.minimum(at + k, len(self.known) - 1)
                same |= (self.known[i] == own) & (self.second[i] == want)
            hit = hit[same]
        return hit, code, good

    def ordered(self, code: np.ndarray) -> np.ndarray:
        """Codes in the form in which ``known`` has them."""
        return code

    def known_at(self, code: np.ndarray) -> np.ndarray:
        """Places of codes that are known."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        slot = self.slot(code)
        maybe = np.flatnonzero((self.table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        at = np.searchsorted(self.known, code[maybe])
        at[at == len(self.known)] = 0
        return maybe[self.known[at] == code[maybe]]

    def found(self, records: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, record, place in it, place in the text, code) of known windows, TOGETHER or PIECE characters at a time: short records are laid end to end, long ones cut."""
        span, at = self.seed.span, 0
        while at < len(records):
            if len(records[at]) > PIECE:
                for p in range(0, len(records[at]) - span + 1, PIECE):
                    part = records[at][p : p + PIECE + span - 1]
                    hit, code, _ = self.hits(self.points(part))
                    yield part, np.full(len(hit), at), p + hit, hit, code[hit]
                at += 1
                continue
            end, size = at, 0
            while end < len(records) and (end == at or size + len(records[end]) <= TOGETHER):
                size += len(records[end])
                end += 1
            whole, stop = "".join(records[at:end]), np.cumsum([len(r) for r in records[at:end]])
            hit, code, _ = self.hits(self.points(whole))
            row = np.searchsorted(stop, hit, "right")  # empty records hold no place
            inside = hit + span <= stop[row]
            row, hit = row[inside], hit[inside]
            yield whole, at + row, hit - np.append(0, stop)[row], hit, code[hit]
            at = end

    def stretches(self, records: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(record, start, end) of the stretches under significant places of known windows; those of a long record's pieces may overlap."""
        for _, row, place, hit, _ in self.found(records):
            if not len(hit):
                continue
            own = hit + row - hit[0] - row[0]  # with a free place between records
            size = int(own[-1]) + self.seed.span + 1
            mark = np.zeros(size, np.int64)
            for a, n in self.seed.runs:
                mark += np.bincount(own + a, minlength=size) - np.bincount(own + a + n, minlength=size)
            edges = np.flatnonzero(np.diff(np.cumsum(mark) > 0, prepend=False))
            start, end = edges[::2], edges[1::2]
            of = np.searchsorted(own, start, "right") - 1  # a hit of the same record
            yield row[of], place[of] + start - own[of], place[of] + end - own[of]

    def together(self, records: list[str]) -> np.ndarray:
        """covered, seeds and found of records: three rows of numbers."""
        span, size = self.seed.span, np.array([len(r) for r in records], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        whole = "".join(records)
        out = np.zeros((3, len(records)), np.int64)
        if len(whole) < span:
            return out
        hit, code, good = self.hits(self.points(whole))
        inside = np.zeros(len(whole) + 1, np.int32)  # windows that begin and end in one record
        fits = size >= span
        np.add.at(inside, begin[fits], 1)
        np.add.at(inside, begin[fits] + size[fits] - span + 1, -1)
        inside = np.cumsum(inside)[: len(code)] > 0
        if good is not None:
            inside &= good
        hit = hit[inside[hit]]
        sums = np.concatenate([[0], np.cumsum(inside)])
        ends = np.minimum(begin + size, len(code))
        out[1] = sums[np.maximum(ends, np.minimum(begin, len(code)))] - sums[np.minimum(begin, len(code))]
        out[2] = np.bincount(np.searchsorted(begin, hit, "right") - 1, minlength=len(records)) if len(hit) else 0
        if len(hit):
            mark = np.zeros(len(whole) + 1, np.int32)
            for a, n in self.seed.runs:
                mark[: len(whole)] += np.bincount(hit + a, minlength=len(whole))[: len(whole)].astype(np.int32)
                mark -= np.bincount(hit + a + n, minlength=len(whole) + 1).astype(np.int32)
            under = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
            out[0] = under[begin + size] - under[begin]
        return out

    def long(self, record: str) -> tuple[int, int, int]:
        """The same of one long record, whose windows are looked up in pieces."""
        seeds_, mark, found = 0, np.zeros(len(record), bool), 0
        for at in range(0, len(record) - self.seed.span + 1, PIECE):
            part = record[at : at + PIECE + self.seed.span - 1]
            hit, code, good = self.hits(self.points(part))
            seeds_ += len(code) if good is None else int(good.sum())
            found += len(hit)
            for p in self.seed.positions:
                mark[at + hit + p] = True
        return int(mark.sum()), seeds_, found

    def batch(self, records: list[str]) -> np.ndarray:
        """covered, seeds and found of any records."""
        out, at = np.zeros((3, len(records)), np.int64), 0
        while at < len(records):
            if len(records[at]) > PIECE:
                out[:, at] = self.long(records[at])
                at += 1
                continue
            end, size = at, 0
            while end < len(records) and (end == at or size + len(records[end]) <= TOGETHER):
                size += len(records[end])
                end += 1
            out[:, at:end] = self.together(records[at:end])
            at = end
        return out


PROBED = "covered long, seeds long, found long"


def probe(text: Column, index) -> Column:
    """A struct of :data:`PROBED` for each record; ``index``: an :class:`Index` or a published one."""
    sent = SparkContext.getOrCreate().broadcast(index.prober())

    @F.arrow_udf(PROBED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for texts in batches:
            got = own.batch([t or "" for t in texts.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(c) for c in got], names=["covered", "seeds", "found"])

    return run(text)


# --- verdict ------------------------------------------------------------------------------------------------


def coverage(rows: DataFrame, key: str, text: str, index, strategy: str = "auto", max_length: int | None = None) -> DataFrame:
    """key, length and covered of every record (0 for such as have no hit); ``max_length``: longer ones never match."""
    size = F.length(text).cast("int")
    asked = F.col(text) if max_length is None else F.when(size <= max_length, F.col(text))
    if strategy in ("auto", "probe"):
        return rows.select(key, size.alias("length"), probe(asked, index).alias("p")).select(key, F.coalesce("length", F.lit(0)).alias("length"), F.col("p.covered").alias("covered"))
    asked_rows = rows.select(key, asked.alias(text))
    if index.dna:
        found = covered_by_stretches(found_stretches(asked_rows, key, text, index), key)
    else:
        hits = found_windows(asked_rows, key, text, index).join(index.codes, "seed", "left_semi").select(key, "pos") if strategy == "verified" else seed_hits(asked_rows, key, text, index)
        found = covered_by_hits(hits, key, index.seed)
    return rows.select(key, F.coalesce(size, F.lit(0)).alias("length")).join(found, key, "left").select(key, "length", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def matches(covered: Column, length: Column, permille: int) -> Column:
    """The strict threshold: nothing matches at 1000, any covered character at 0."""
    return covered * 1000 > length * permille


def score(covered: Column, length: Column) -> Column:
    """Coverage in permille, floored; null for an empty record."""
    return F.when(length > 0, F.floor(covered * 1000 / length))


def verdicts(rows: DataFrame, key: str, text: str, index, permille: int = 500, **how) -> DataFrame:
    """key, covered, length and matched of every record."""
    return coverage(rows, key, text, index, **how).select(key, "covered", "length", matches(F.col("covered"), F.col("length"), permille).alias("matched"))
