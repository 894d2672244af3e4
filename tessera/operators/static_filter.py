"""A static filter of an index too large to be sent: built bucket by bucket in Spark tasks, mapped and probed where records lie.

Seeds are hashed to 64 bits without collisions (a bijection of base codes; text windows by their first print); the top bits say the bucket. A bucket's keys have three
slots each, one in each third of its block; the fingerprint of a key is the exclusive or of its slots. Slots are found by peeling: a key that is alone
in some slot is taken off, until none is left, and slots are set in the reverse order. Blocks have 1.23 slots a key, so peeling ends with all keys but for a rare bucket, which
takes another salt. All keys are found; another one is found with a probability of 2^-bits.

Each bucket is solved in one task from about :data:`BUCKET` keys and written at its place of one file in the shared folder, by position: a repeated or a second
attempt writes the same bytes. Where blocks begin follows from the buckets' counts, so what passes the driver is three numbers a bucket. Tasks map the file, whose pages
all workers of a machine share. Hashes are looked up as they come: on a filter of 491 MB sorting a million of them first took longer than it saved (5.4 against 8.1 million a second on a core).

The table of an index is the same hashes themselves, sorted, in another such file: a bucket is sorted in its task and written at its place, in the pass that solves it. What the filter finds and the table holds
is held, without an error, and no window is shuffled for it. Of text windows the table holds second prints as well, which decide as they do in an index that is sent.

An empty index gives a filter that holds nothing. The folder must be mounted on all machines, as for published filters.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import mix64
from tessera.operators.coverage import Prober
from tessera.sources.shared import as_local, workspace

_U = np.uint64
#: Keys of a bucket (between this and twice as many), and slots a key.
BUCKET, SPACE = 1 << 19, 1.23
TYPES = {8: np.uint8, 16: np.uint16, 32: np.uint32}


def third(keys: np.ndarray | int) -> np.ndarray | int:
    """Slots of a third of a block for so many keys."""
    return (keys * SPACE / 3).astype(np.int64) + 12 if isinstance(keys, np.ndarray) else int(keys * SPACE / 3) + 12


def spots(x: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The three slots (3 x keys) of mixed hashes in a block of thirds of ``size``."""
    low = _U(0xFFFFFFFF)
    turned = (x, (x << _U(21)) | (x >> _U(43)), (x << _U(42)) | (x >> _U(22)))
    wide = np.asarray(size, _U)
    return np.stack([(((t & low) * wide) >> _U(32)).astype(np.int64) + k * np.asarray(size, np.int64) for k, t in enumerate(turned)])


def marks(x: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprints of mixed hashes."""
    return ((x ^ (x >> _U(32))) & _U((1 << bits) - 1)).astype(TYPES[bits])


def salted(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return mix64(h + np.asarray(salt, _U))


def peel(at: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(keys, the slots that they own) in rounds, None if some keys never come to stand alone."""
    n = at.shape[1]
    count = np.bincount(at.ravel(), minlength=slots)
    sums = np.zeros(slots, np.int64)  # of the numbers of the keys in a slot: of one key its number
    for row in at:
        np.add.at(sums, row, np.arange(n))
    rounds, taken, alone = [], 0, np.flatnonzero(count == 1)
    while len(alone):
        keys, first = np.unique(sums[alone], return_index=True)
        rounds.append((keys, alone[first]))
        taken += len(keys)
        left = at[:, keys]
        for row in left:
            np.subtract.at(count, row, 1)
            np.subtract.at(sums, row, keys)
        left = left.ravel()
        alone = np.unique(left[count[left] == 1])
    return rounds if taken == n else None


def solve(h: np.ndarray, size: int, bits: int) -> tuple[int, np.ndarray]:
    """The salt and the slots of a block that holds distinct hashes."""
    for salt in range(100):
        x = salted(h, salt)
        at = spots(x, size)
        rounds = peel(at, 3 * size)
        if rounds is not None:
            break
    else:
        raise ValueError("no salt parts the keys of a bucket")
    block, print_ = np.zeros(3 * size, TYPES[bits]), marks(x, bits)
    for keys, own in reversed(rounds):
        a, b, c = at[:, keys]
        block[own] = print_[keys] ^ block[a] ^ block[b] ^ block[c]  # its own slot is still zero
    return salt, block


@dataclass(frozen=True)
class SeedTable:
    """A file of ``n`` sorted hashes; ``second``: of text windows, a file of their second prints; ``most``: windows that share a hash."""

    path: str
    n: int
    second: str | None = None
    most: int = 1

    def rows(self) -> np.ndarray:
        return self.numbers(self.path)

    def seconds(self) -> np.ndarray | None:
        return None if self.second is None else self.numbers(self.second)

    def numbers(self, path: str) -> np.ndarray:
        return np.asarray(np.memmap(path, _U, "r", shape=(self.n,))) if self.n else np.zeros(0, _U)

    @staticmethod
    def holds(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which hashes are held."""
        if not len(rows):
            return np.zeros(len(h), bool)
        return rows[np.minimum(np.searchsorted(rows, h), len(rows) - 1)] == h


@dataclass(frozen=True)
class StaticFilter:
    """Where the blocks of a filter file begin (in slots), the sizes of their thirds and their salts; ``top``: bits that say the bucket; ``table``: the hashes themselves."""

    path: str
    bits: int
    top: int
    begin: np.ndarray
    size: np.ndarray
    salt: np.ndarray
    table: SeedTable | None = None

    def slots(self) -> np.ndarray:
        total = int(self.begin[-1] + 3 * self.size[-1])
        return np.asarray(np.memmap(self.path, TYPES[self.bits], "r", shape=(total,)))

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.top)).astype(np.int64) if self.top else np.zeros(len(h), np.int64)

    def holds(self, slots: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which hashes are held (true for every one put in)."""
        of = self.bucket(h)
        x = salted(h, self.salt[of])
        a, b, c = spots(x, self.size[of]) + self.begin[of]
        return (slots[a] ^ slots[b] ^ slots[c]) == marks(x, self.bits)


def dealt(hashes: DataFrame, n: int, bucket: int) -> tuple[DataFrame, int, np.ndarray]:
    """Hashes by bucket (their top bits), how many bits these are, and how many hashes each bucket has."""
    top = max(0, math.floor(math.log2(max(1, n / bucket))))
    of = F.shiftrightunsigned("h", 64 - top).cast("int") if top else F.lit(0)
    rows = hashes.select(of.alias("bucket"), "*")
    count = np.zeros(1 << top, np.int64)
    for of, keys in rows.groupBy("bucket").count().collect():  # a row for each bucket
        count[of] = keys
    # one task a bucket or a few, whatever the session's number of shuffle partitions is
    return rows.repartition(min(1 << top, max(hashes.sparkSession.sparkContext.defaultParallelism, (1 << top) // 4)), "bucket"), top, count


def build_filter(hashes: DataFrame, n: int, bits: int = 32, bucket: int = BUCKET) -> StaticFilter:
    """A filter of ``n`` hashes (a column ``h`` of longs), which are distinct or have different second prints (a column ``second``), and their table: buckets in their order, each sorted, are all in order."""
    if bits not in TYPES:
        raise ValueError("a fingerprint has 8, 16 or 32 bits")
    spark = hashes.sparkSession
    spread, top, count = dealt(hashes, n, bucket)
    size = third(count)
    begin, row = np.cumsum(3 * size) - 3 * size, np.cumsum(count) - count
    folder, width = as_local(workspace(spark, "filter")), bits // 8
    path, table = f"{folder}/blocks.bin", SeedTable(f"{folder}/rows.bin", int(count.sum()), f"{folder}/seconds.bin" if "second" in hashes.columns else None)
    for file, bytes_ in ((path, int(3 * size.sum()) * width), (table.path, 8 * table.n), (table.second, 8 * table.n)):
        if file is not None:
            with open(file, "wb") as f:
                f.truncate(bytes_)

    def write(rows: pa.Table) -> pa.Table:
        of = rows["bucket"][0].as_py()
        h, *second = (rows[c].to_numpy().view(_U) for c in rows.column_names[1:])
        order = np.lexsort((*second, h))
        different, share = np.unique(h, return_counts=True)
        salt, block = solve(different, int(size[of]), bits)
        for file, at, what in ((path, int(begin[of]) * width, block), (table.path, 8 * int(row[of]), h[order]), *((table.second, 8 * int(row[of]), s[order]) for s in second)):
            with open(file, "r+b") as f:
                f.seek(at)
                f.write(what.tobytes())
        return pa.table({"bucket": pa.array([of], pa.int32()), "salt": pa.array([salt], pa.int32()), "most": pa.array([share.max()], pa.int32())})

    salts, most = np.zeros(1 << top, np.int64), 1
    for of, salt, share in spread.groupBy("bucket").applyInArrow(write, "bucket int, salt int, most int").collect():  # a row for each bucket
        salts[of], most = salt, max(most, share)
    return StaticFilter(path, bits, top, begin, size, salts, replace(table, most=most))


def build_table(hashes: DataFrame, n: int, bucket: int = BUCKET) -> SeedTable:
    """The table alone of :func:`build_filter`."""
    return build_filter(hashes, n, bucket=bucket).table


class FilterProber(Prober):
    """Finds windows by a mapped filter alone: all that are held, and others with a probability of 2^-bits each."""

    def __init__(self, of: StaticFilter, *how):
        self.describe(*how)
        self.of = of

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "mapped"}

    def known_at(self, code: np.ndarray) -> np.ndarray:
        if not hasattr(self, "mapped"):
            self.mapped = self.of.slots()
        return np.flatnonzero(self.of.holds(self.mapped, mix64(code)))


class ExactProber(FilterProber):
    """As :class:`FilterProber`, but what the filter finds is looked up in the table of all hashes: what is held, and no other (of text: what has both prints of a window that is)."""

    def __getstate__(self):
        return {k: v for k, v in super().__getstate__().items() if k not in ("known", "second")}

    def ordered(self, code: np.ndarray) -> np.ndarray:
        return mix64(code)

    def known_at(self, code: np.ndarray) -> np.ndarray:
        if not hasattr(self, "known"):
            self.known, self.second, self.most = self.of.table.rows(), self.of.table.seconds(), self.of.table.most
        maybe = super().known_at(code)
        return maybe[SeedTable.holds(self.known, self.ordered(code[maybe]))]
