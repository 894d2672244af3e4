"""Published indexes: a bit-packed windowed filter with a pickled description, as two files or in a tar archive."""

from __future__ import annotations

import io
import os
import pickle
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import bucket_of
from tessera.functions.seeds import Seed
from tessera.operators.coverage import Prober, probe
from tessera.operators.index import NativeLayout

INFO_SCHEMA = (
    "filtertype string, universe bigint, nsubfilters bigint, nslots bigint, nwindows bigint, windowsize int, fprBits int, maxsteps int, "
    "hash struct<subfilter:string,window:string,fingerprint:string,offset:string>, k int, seed array<int>, span int, rcmode string, checksum string"
)
_U = np.uint64


class _Plain(pickle.Unpickler):
    """Builds plain values and numpy scalars only."""

    def find_class(self, module, name):
        if (module, name) in {("_codecs", "encode"), ("numpy", "dtype"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in an index description")


def read_info(data: bytes) -> dict:
    """The description as a flat dict: of the pickled three parts the first describes the filter, the last the seeds."""
    parts = _Plain(io.BytesIO(data)).load()
    if not isinstance(parts, (tuple, list)) or len(parts) < 3:
        raise ValueError("an index description has three parts")
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    of_filter, of_seeds = ({k: plain(v) for k, v in parts[i].items()} for i in (0, 2))
    # names in the description (fixed values) by the names used here
    named = {"filtertype": "filtertype", "universe": "universe", "nsubfilters": "nsubfilters", "nslots": "nslots", "nwindows": "nwindows_per_subfilter", "windowsize": "windowsize", "fprBits": "target_fpr", "maxsteps": "maxsteps"}
    out = {own: of_filter.get(name) for own, name in named.items()}
    out["hash"] = {k: of_filter.get(f"{k}_hashfunc_str") for k in ("subfilter", "window", "fingerprint", "offset")}
    out["k"], out["rcmode"] = of_seeds.get("k"), of_seeds.get("rcmode")
    out["seed"] = [int(plain(x)) for x in of_seeds.get("mask") or range(int(out["k"] or 0))]
    out["span"] = max(out["seed"], default=-1) + 1
    out["checksum"] = None if of_filter.get("checksum") is None else str(of_filter["checksum"])
    return out


def info_frame(spark: SparkSession, info: dict) -> DataFrame:
    """The description as one row."""
    h = info.get("hash") or {}
    names = [f.split()[0] for f in re.sub(r"struct<[^>]*>", "struct", INFO_SCHEMA).split(", ")]
    row = {n: info.get(n) for n in names} | {"hash": {k: h.get(k) for k in ("subfilter", "window", "fingerprint", "offset")}}
    return spark.createDataFrame([row], INFO_SCHEMA)


@dataclass(frozen=True)
class Description:
    """What a lookup needs, checked."""

    layout: NativeLayout
    bits: int
    factors: tuple[int, int, int, int]  # subfilter, window, fingerprint, offset
    seed: Seed

    @staticmethod
    def of(info: dict) -> Description:
        if info.get("filtertype") != "windowed_cuckoo":
            raise ValueError(f"filters of type {info.get('filtertype')!r} are not supported")
        if info.get("rcmode") not in (None, "max"):
            raise ValueError(f"strand mode {info['rcmode']!r} is not supported")
        universe = int(info["universe"])
        bits = universe.bit_length() - 1
        if universe != 1 << bits or bits % 2:
            raise ValueError("the universe must be a power of four")
        places = info["seed"]
        mask = "".join("#" if i in set(places) else "_" for i in range(info["span"]))

        def factor(name: str) -> int:
            m = re.fullmatch(r"linear(\d+)", str(info["hash"][name]))
            if not m:
                raise ValueError(f"hash {info['hash'][name]!r} is not supported")
            return int(m[1])

        layout = NativeLayout(int(info["fprBits"]), int(info["windowsize"]), int(info["nwindows"]), int(info["nslots"]), int(info["nsubfilters"]))
        if 2 * layout.window_bits > 64:
            raise ValueError("two windows must fit in 64 bits")
        return Description(layout, bits, tuple(factor(n) for n in ("subfilter", "window", "fingerprint", "offset")), Seed(mask))

    def places(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The fingerprint, the two windows' first bits, and the offset of codes."""
        x = self.layout
        sub, win, fp, off = self.factors
        print_ = bucket_of(fp, code, (1 << x.fingerprint_bits) - 1, self.bits) + _U(1)
        one = bucket_of(win, code, x.windows, self.bits)
        step = bucket_of(off, print_, x.windows - x.window_size + 1, self.bits)
        two = (one + step) % _U(x.windows)
        base = bucket_of(sub, code, x.subfilters, self.bits) * _U(x.subfilter_bits)
        w = _U(x.window_bits // x.window_size)
        return print_, base + one * w, base + two * w, step


def window_bits(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` bits (up to 57) at each bit place of little-endian bytes, each by one read of eight bytes."""
    if len(raw) < 8:
        raw = np.concatenate([raw, np.zeros(8 - len(raw), np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # from each byte on
    byte = np.minimum(at >> _U(3), _U(len(raw) - 8))
    return (words[byte.astype(np.int64)] >> (at - (byte << _U(3)))) & _U((1 << size) - 1)


def contains(raw: np.ndarray, what: Description, code: np.ndarray) -> np.ndarray:
    """Whether the filter holds each code: a slot of the first window with choice 0, or of the second with choice 1.

    Codes are looked up as they come: on a filter of 858 MB sorting a million of them by their windows first took longer than it saved (3.3 against 6.1 million codes a second on a core).
    """
    x = what.layout
    print_, one, two, _ = what.places(code)
    found = np.zeros(len(code), bool)
    for choice, at in ((0, one), (1, two)):
        window = window_bits(raw, at, x.window_bits)
        for j in range(x.window_size):
            slot = (window >> _U(j * x.slot_bits)) & _U((1 << x.slot_bits) - 1)
            want = print_ | _U(j << x.fingerprint_bits) | _U(choice << (x.fingerprint_bits + x.offset_bits))
            found |= slot == want
    return found


class PublishedProber(Prober):
    """Decides records against a filter file, which each task maps into memory (a shared or shipped path)."""

    def __init__(self, path: str, what: Description, alphabet: str):
        self.describe(what.seed, True, True, alphabet)
        self.path, self.what = path, what

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "raw"}

    def known_at(self, code: np.ndarray) -> np.ndarray:
        if not hasattr(self, "raw"):
            self.raw = np.asarray(np.memmap(self.path, np.uint8, "r"))
        return np.flatnonzero(contains(self.raw, self.what, code))


@dataclass(frozen=True)
class PublishedIndex:
    """A published filter in the place of an index of one's own: it is always probed, whatever its size."""

    path: str
    what: Description
    alphabet: str = "strict"
    small = True
    dna = canonical = True

    @property
    def seed(self) -> Seed:
        return self.what.seed

    def prober(self) -> PublishedProber:
        return PublishedProber(self.path, self.what, self.alphabet)


def probe_published(text: Column, filter_path: str, what: Description, alphabet: str = "strict") -> Column:
    """As :func:`tessera.operators.coverage.probe`, on a filter file."""
    return probe(text, PublishedIndex(filter_path, what, alphabet))


def settle(one: np.ndarray, two: np.ndarray, size: int, slots: int, rounds: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each code within ``size`` from the begin of one of its windows, and which window: all codes at once, in rounds.

    A code takes a free slot of its windows, else it takes the place of a code that lies there, which goes on in the next round. Of codes that want one slot the first gets it.
    """
    rng, near = np.random.default_rng(seed), np.arange(size)
    owner, at, side = np.full(slots, -1, np.int64), np.full(len(one), -1, np.int64), np.zeros(len(one), np.int64)
    pending = np.arange(len(one))
    for _ in range(rounds):
        if not len(pending):
            return at, side
        wanted = np.concatenate([one[pending, None] + near, two[pending, None] + near], axis=1)
        free = owner[wanted] < 0
        room = free.any(1)
        pick = np.where(room, (free * rng.random(free.shape)).argmax(1), rng.integers(2 * size, size=len(pending)))
        slot, first = np.unique(wanted[np.arange(len(pending)), pick], return_index=True)
        taker, moved = pending[first], owner[slot]
        moved = moved[moved >= 0]
        at[moved] = -1
        owner[slot], at[taker], side[taker] = taker, slot, pick[first] // size
        lost = np.ones(len(pending), bool)
        lost[first] = False
        pending = np.concatenate([pending[lost], moved])
    if len(pending):
        raise ValueError(f"the filter is too small for the codes: {len(pending)} of {len(one)} have no slot")
    return at, side


def packed(values: np.ndarray, bits: int) -> Iterator[bytes]:
    """Numbers of ``bits`` bits in a row, lowest bit first, some at a time."""
    places = np.arange(bits, dtype=np.uint64)
    for s in range(0, len(values), 1 << 18):  # whole bytes each
        yield np.packbits(((values[s : s + (1 << 18), None] >> places) & _U(1)).astype(np.uint8), bitorder="little").tobytes()


def subfilter_values(code: np.ndarray, what: Description, rounds: int = 5000) -> np.ndarray:
    """The slots' values of a subfilter that holds the codes (all of it)."""
    x = what.layout
    print_, one, two, _ = what.places(code)
    base = bucket_of(what.factors[0], code, x.subfilters, what.bits) * _U(x.subfilter_bits)
    begin = [((w - base) // _U(x.slot_bits)).astype(np.int64) for w in (one, two)]
    at, side = settle(*begin, x.window_size, x.slots_each, rounds)
    within = (at - np.where(side == 0, *begin)).astype(_U)
    out = np.zeros(x.slots_each, _U)
    out[at] = print_ | within << _U(x.fingerprint_bits) | side.astype(_U) << _U(x.fingerprint_bits + x.offset_bits)
    return out


def write_filter(codes: DataFrame, what: Description, path: str, code: str = "seed") -> int:
    """Write a filter file that holds all distinct ``codes`` (longs); returns how many there are.

    Codes are dealt by their subfilter; each is filled in one task and written at its place in the file, by position, so a second attempt writes the same bytes. Take as many subfilters as
    leave some million codes in each. ``path`` is on a store that all machines mount.
    """
    x, spark = what.layout, codes.sparkSession

    def deal(batches):
        for b in batches:
            sub = bucket_of(what.factors[0], b.column(0).to_numpy().view(_U), x.subfilters, what.bits)
            yield pa.RecordBatch.from_arrays([pa.array(sub.astype(np.int32)), b.column(0)], names=["sub", "code"])

    def fill(rows: pa.Table) -> pa.Table:
        own = np.unique(rows["code"].to_numpy().view(_U))
        with open(path, "r+b") as f:
            f.seek(rows["sub"][0].as_py() * (x.subfilter_bits // 8))
            for piece in packed(subfilter_values(own, what), x.slot_bits):
                f.write(piece)
        return pa.table({"n": pa.array([len(own)], pa.int64())})

    with open(path, "wb") as f:
        f.truncate(x.subfilters * x.subfilter_bits // 8 + 8)
    dealt = codes.select(F.col(code).cast("long").alias("code")).mapInArrow(deal, "sub int, code long")
    dealt = dealt.repartition(min(x.subfilters, max(x.subfilters // 4, spark.sparkContext.defaultParallelism)), "sub")
    return dealt.groupBy("sub").applyInArrow(fill, "n long").agg(F.sum("n")).first()[0] or 0


def describe(seed: Seed, codes: int, window_size: int = 2, fingerprint_bits: int = 14, load: float = 0.7, subfilters: int = 1, factors: tuple[int, int, int, int] = (62591, 9123457, 51234567, 884421)) -> bytes:
    """A pickled description of a filter that has room for so many codes, which fall to subfilters by chance."""
    each = codes / subfilters
    windows = max(2 * window_size, int((each + 6 * each**0.5 * (subfilters > 1)) / load)) | 1
    of_filter = {"filtertype": "windowed_cuckoo", "universe": 4**seed.weight, "nsubfilters": subfilters, "nslots": subfilters * (windows + window_size - 1), "nwindows_per_subfilter": windows, "windowsize": window_size, "target_fpr": fingerprint_bits, "maxsteps": 500}
    of_filter |= {f"{n}_hashfunc_str": f"linear{v}" for n, v in zip(("subfilter", "window", "fingerprint", "offset"), factors)}
    return pickle.dumps((of_filter, {}, {"mask": seed.positions, "k": seed.weight, "rcmode": "max"}), 2)


def unpack(archive: str, folder: str) -> tuple[str, str]:
    """The filter and description of a tar archive, written to ``folder``; other entries are passed over."""
    found: dict[str, str] = {}
    with tarfile.open(archive, "r:*") as tar:
        first = True
        for entry in tar:
            if not entry.isfile():
                continue
            suffix = os.path.splitext(entry.name)[1]
            if first and suffix == ".hash":
                raise ValueError("indexes of this older kind are not supported")
            if first and suffix != ".filter":
                raise ValueError(f"the archive begins with {entry.name!r}, not with a filter")
            first = False
            if suffix in (".filter", ".info"):
                path = os.path.join(folder, "index" + suffix)
                with open(path, "wb") as out, tar.extractfile(entry) as data:
                    while piece := data.read(1 << 20):
                        out.write(piece)
                found[suffix] = path
    if set(found) != {".filter", ".info"}:
        raise ValueError("the archive lacks a filter or its description")
    return found[".filter"], found[".info"]


def load_published(filter_path: str, info_path: str) -> tuple[str, Description]:
    """A filter file and its checked description."""
    for path, suffix in ((filter_path, ".filter"), (info_path, ".info")):
        if not path.endswith(suffix):
            raise ValueError(f"{path} is not a {suffix} file")
    with open(info_path, "rb") as f:
        what = Description.of(read_info(f.read()))
    need = what.layout.subfilter_bits * what.layout.subfilters // 8
    if os.path.getsize(filter_path) < need:
        raise ValueError(f"the filter has {os.path.getsize(filter_path)} bytes, its description asks for {need}")
    return filter_path, what
