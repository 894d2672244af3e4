"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of equal length are interchangeable, so a packing is a multiset of *patterns* (how many pieces of which
lengths share a bin) and the search works on counts: its size follows the capacity (at most one count per length
from 1 to the capacity), not the number of documents. What grows with the data is done in Spark: encoding,
counting lengths, ranking pieces among those of their length, and looking up each piece's bin by its rank.

An individual maps patterns to numbers of bins. Crossover injects a share of the other parent's best-filled bins
whole, removes bins of this parent until no piece is there twice (worst filled first), and puts the
documents of removed bins back by best fit, longest first. Mutation dissolves badly filled bins. Islands are
Spark tasks that evolve small populations; after each epoch their elites move on to the next island. The
search ends at the lower bound (tokens / capacity, rounded up) or after a fixed number of epochs, and no result is worse than
best-fit decreasing, from which it starts.

Edge cases: a null text is empty and gives one piece, the end token; repeated rows are packed each for itself;
null or equal ids only order pieces among those of their length; a very long text is encoded whole where it lies and cut into pieces; an empty table gives an empty result; columns
of the input other than id and text are not read by :func:`pieces`, and :func:`pack` keeps all columns and gives new
ones free names.
"""

from __future__ import annotations

import functools
import json
import math
import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, unused

CAPACITY = 1024
END = 2
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 6, 4, 6, 4
#: Characters on which both libraries' rules agree beyond doubt; other texts are encoded by the slower library.
PLAIN = re.compile("[\t\n\r -~¡-ɏ‐-‧‰-⁞]*")

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first
Packing = dict[Pattern, int]


# --- the search, on counts ---------------------------------------------------------------------------------


def fill(p: Pattern) -> int:
    return sum(n * k for n, k in p)


def _with(p: Pattern, n: int, k: int) -> Pattern:
    d = dict(p)
    d[n] = d.get(n, 0) + k
    return tuple(sorted(d.items(), reverse=True))


def best_fit(packing: Packing, counts: dict[int, int], capacity: int) -> Packing:
    """Add pieces (length: how many), longest first, each to the fullest bin that has room, else to a new one."""
    room: dict[int, dict[Pattern, int]] = defaultdict(dict)
    for p, c in packing.items():
        room[capacity - fill(p)][p] = c
    for n in sorted(counts, reverse=True):
        left = counts[n]
        for r in sorted(r for r in room if r >= n):
            if not left:
                break
            group, room[r] = room[r], {}
            for p, c in group.items():
                k = r // n
                full = min(c, left // k) if left else 0
                part = left - full * k if full < c and left else 0
                if full:
                    q = _with(p, n, k)
                    room[r - n * k][q] = room[r - n * k].get(q, 0) + full
                    left -= full * k
                if 0 < part < k:
                    q = _with(p, n, part)
                    room[r - n * part][q] = room[r - n * part].get(q, 0) + 1
                    left -= part
                    full += 1
                if c > full:
                    room[r][p] = room[r].get(p, 0) + c - full
        if left:
            k = capacity // n
            for m, c in ((k, left // k), (left % k, 1)):
                if m and c:
                    q = ((n, m),)
                    room[capacity - n * m][q] = room[capacity - n * m].get(q, 0) + c
    return {p: c for group in room.values() for p, c in group.items()}


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, a more uneven filling leaves more room together."""
    return -sum(packing.values()), sum(c * (fill(p) / capacity) ** 2 for p, c in packing.items())


def crossover(a: Packing, b: Packing, capacity: int, rng: random.Random) -> Packing:
    """``a`` with well-filled bins of ``b``: inject, remove duplicates, best-fit what was displaced."""
    best = sorted(b, key=fill, reverse=True)
    best = best[: max(1, len(best) // 2)]
    injected = {p: max(1, round(b[p] * rng.random())) for p in best if rng.random() < 0.5}
    need: dict[int, int] = defaultdict(int)
    for p, c in injected.items():
        for n, k in p:
            need[n] += k * c
    kept, displaced = dict(a), defaultdict(int)
    for p in sorted(a, key=lambda p: (fill(p), rng.random())):
        c = kept[p]
        take = max((min(c, -(-need[n] // k)) for n, k in p if need[n] > 0), default=0)
        if take:
            kept[p] = c - take
            for n, k in p:
                gone = k * take
                same = min(max(need[n], 0), gone)
                need[n] -= same
                displaced[n] += gone - same
    out = {p: c for p, c in kept.items() if c}
    for p, c in injected.items():
        out[p] = out.get(p, 0) + c
    return best_fit(out, {n: c for n, c in displaced.items() if c}, capacity)


def mutate(a: Packing, capacity: int, rng: random.Random) -> Packing:
    """Dissolve some of the badly filled bins and put their pieces back."""
    out, loose = dict(a), defaultdict(int)
    for p in sorted(a, key=fill)[: max(2, len(a) // 8)]:
        if fill(p) < capacity:
            c = rng.randint(0, out[p])
            out[p] -= c
            for n, k in p:
                loose[n] += k * c
    return best_fit({p: c for p, c in out.items() if c}, {n: c for n, c in loose.items() if c}, capacity)


def evolve(population: list[Packing], capacity: int, generations: int, seed: int) -> list[Packing]:
    rng, size = random.Random(seed), len(population)
    for _ in range(generations):
        parents = sorted(population, key=lambda p: fitness(p, capacity), reverse=True)
        young = [crossover(rng.choice(parents), rng.choice(parents), capacity, rng) for _ in range(size)]
        young += [mutate(parents[0], capacity, rng)]
        population = sorted(parents + young, key=lambda p: fitness(p, capacity), reverse=True)[:size]
    return population


def search(spark, counts: dict[int, int], capacity: int, islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS, seed: int = 1) -> Packing:
    """The best packing found for so many pieces of each length. All that moves is bounded by the capacity."""
    first = best_fit({}, counts, capacity)
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    if sum(first.values()) <= least:
        return first
    rng = random.Random(seed)
    groups = [[first] + [mutate(first, capacity, rng) for _ in range(population - 1)] for _ in range(islands)]
    for epoch in range(epochs):

        def island(batches, epoch=epoch):
            for batch in batches:
                for k, blob in zip(batch["k"].to_pylist(), batch["blob"].to_pylist()):
                    out = evolve(pickle.loads(blob), capacity, generations, seed * 1_000_003 + epoch * 1009 + k)
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "blob": pa.array([pickle.dumps(out)], pa.binary())})

        sent = spark.createDataFrame([(k, pickle.dumps(g)) for k, g in enumerate(groups)], "k int, blob binary").repartition(islands, "k")
        got = sorted(sent.mapInArrow(island, "k int, blob binary").collect(), key=lambda r: r[0])
        groups = [pickle.loads(bytes(r[1])) for r in got]
        elites = [g[0] for g in groups]
        for k, g in enumerate(groups):  # the elite of each island moves on to the next
            g[-1] = elites[k - 1]
        best = max(elites, key=lambda p: fitness(p, capacity))
        if sum(best.values()) <= least:
            break
    return best


# --- pieces to bins ----------------------------------------------------------------------------------------


class Layout:
    """Where the pieces of each length lie, by their rank among those of their length."""

    def __init__(self, packing: Packing):
        used: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for p, c in sorted(packing.items(), key=lambda x: (-fill(x[0]), x[0])):
            at = 0
            for n, k in p:
                rows.append((n << 44 | used[n], first, k, at))
                used[n] += k * c
                at += n * k
            first += c
        rows.sort()
        self.key, self.first, self.each, self.at = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.bins = first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) | rank
        s = np.searchsorted(self.key, key, "right") - 1
        nth = key - self.key[s]
        return self.first[s] + nth // self.each[s], self.at[s] + nth % self.each[s] * length


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, names: tuple[str, str] = ("sequence_id", "offset"), **search_args) -> DataFrame:
    """``pieces`` with the bin and the place in the bin of each; give a stored table, it is read three times.

    ``length``: whole numbers from 1 to ``capacity``. Pieces of one length are told apart by a salted rank: no
    task ranks all pieces of a common length.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): r[1] for r in pieces.groupBy(F.col(f"`{length}`")).count().collect()}  # one row a length
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    layout = spark.sparkContext.broadcast(Layout(search(spark, counts, capacity, **search_args)))
    salt, rank, before, spot, *names = unused(pieces, "salt", "rank", "before", "spot", *names)
    n, keys = F.col(f"`{length}`"), [F.col(f"`{c}`") for c in order]
    salts = max(256, math.ceil(sum(counts.values()) / 100_000))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    earlier = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)  # over salts x lengths counts
    starts = salted.groupBy(n.alias(length), salt).count().select(length, salt, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(length, salt).orderBy(*keys)) - 1).join(starts, [length, salt])

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        bins, at = layout.value.find(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(bins, pa.int64()), pa.array(at, pa.int64())], names=["sequence_id", "offset"])

    placed = ranked.withColumn(spot, place(n.cast("long"), F.col(rank) + F.col(before)))
    return placed.select(*(F.col(f"`{c}`") for c in pieces.columns), F.col(f"{spot}.sequence_id").alias(names[0]), F.col(f"{spot}.offset").alias(names[1]))


# --- encoding ----------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to token ids as the tokenizers library gives them (special tokens in a text included).

    The same byte-level vocabulary is run by tiktoken, several times as fast, where both libraries' character
    classes agree; other texts go to the tokenizers library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if i not in special.values()}
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    slow = []

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, allowed_special=allowed)
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens: full ones, but for the first."""
    head = total % capacity if total > capacity else total
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, total, capacity)]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (with ``with_ids`` also ids) of the pieces of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(encode(t.as_py() or ""), end).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    part = ids[s : s + n]
                    rows.append((k, s, n, zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
            cols = list(zip(*rows)) or [()] * (5 if with_ids else 4)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[doc_id, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, **search_args) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    cut_up = Scratch(docs.sparkSession, "pack").write(pieces(docs, tokenizer, capacity=capacity, end=end).withColumn("row_no", F.monotonically_increasing_id()))  # tells repeated rows apart
    return pack(cut_up, order=("doc_id", "piece", "ids_crc32", "row_no"), capacity=capacity, **search_args).drop("row_no")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, **search_args) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves; a group holds at most ``capacity`` tokens."""
    cut_up = Scratch(docs.sparkSession, "pack").write(pieces(docs, tokenizer, capacity=capacity, end=end, with_ids=True))
    packed = pack(cut_up, order=("doc_id", "piece", "ids_crc32"), capacity=capacity, **search_args)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
