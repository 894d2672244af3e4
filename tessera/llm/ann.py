"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long bit string (signs of projections on orthonormal random directions). Sorted, the
strings form the tree: all vectors below a node are one stretch of the array, those that share a prefix.
A query descends in all trees to its longest prefix matches and then ascends in all of them at once, bit by
bit; so the length of the prefix varies with how dense the data are around the query. Candidates are compared by exact cosine.

A query ascends twice at most: until the stretches hold :data:`START` candidates together, and then, if the k-th of these lies at an angle at which a point may
well have been missed so far, to the level where such a point has met the query in some tree with the probability :data:`RECALL`
(:func:`needed_level`). Near neighbours end the search early; data without any structure need a share of all points.

In Spark a tree's array is cut by its first bits (and, where a cell is crowded, dealt into chunks of it);
each piece is sorted and searched in one task, with the queries whose stretch meets it (:data:`ASKED` of them at most, more are dealt out). The level of the first
stretch follows from counts of prefixes of up to :data:`COUNT_BITS` bits (a table of bounded size,
2^17 numbers a tree). Trees are worked through a few at a time, so the disk holds the vectors a few times only. Equal vectors
are one point with its smallest ids, however many there are; equal queries are searched once.

Edge cases: vectors that are null, zero, hold null or non-finite components, or are not of the most common
length take no part, nor do rows with a null id; rows of the same id are never neighbours of each other;
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; only
the id and the vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

TREES, BITS, COUNT_BITS = 16, 32, 16
TREES_AT_ONCE = 2
#: Points of a cell, of a chunk of a crowded cell, and queries that meet a chunk together.
CELL, CHUNK, ASKED = 16_384, 32_768, 16_384
#: Candidates of a query's first stretch, and the probability with which its k-th neighbour is to be met.
START, RECALL = 2048, 0.92
SEED = 11


def needed_level(score: Column, trees: int, recall: float) -> Column:
    """The level at which a point of this cosine has met the query in some tree with the probability ``recall``.

    A random plane parts two vectors with a probability of their angle / pi, so strings agree on L bits with (1 - angle / pi)^L.
    """
    same = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), score))) / math.pi
    each = 1 - (1 - recall) ** (1 / trees)
    return F.when(same >= 1 - 1e-9, BITS).when(same <= 0, 0).otherwise(F.least(F.lit(BITS), F.floor(math.log(each) / F.log(same)))).cast("int")


def directions(tree: int, dim: int, seed: int = SEED) -> np.ndarray:
    """BITS directions, orthonormal in groups of up to ``dim``."""
    rng, parts = np.random.default_rng([seed, tree]), []
    while sum(map(len, parts)) < BITS:
        parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T)
    return np.concatenate(parts)[:BITS].astype(np.float32)


def hash_strings(x: np.ndarray, trees: list[int], seed: int = SEED) -> np.ndarray:
    """The bit strings (as numbers, first bit highest) of vectors: vectors x trees."""
    if not len(x):
        return np.zeros((0, len(trees)), np.int64)
    planes = np.concatenate([directions(t, x.shape[1], seed) for t in trees])
    bits = (x.astype(np.float32) @ planes.T > 0).reshape(len(x), len(trees), BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _vectors(column) -> np.ndarray:
    """Vectors from their bytes."""
    if not len(column):
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec (its bytes) of the rows that take part."""
    v = F.col("v")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sizes = rows.where(sound).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0][0] if sizes else 0

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat.astype("<f8")], pa.binary())], names=["vec_id", "vec"])

    return rows.where(sound & (F.size("v") == dim)).mapInArrow(run, "vec_id long, vec binary")


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of vectors x with y, in double precision; a vector's does not depend on the others (as it may in a product)."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum()))


def top_in_stretches(points: np.ndarray, strings: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ids: np.ndarray | None = None):
    """Of sorted ``strings``, each query's k best among those from its ``low`` to below its ``high``; ties go to the smaller of ``ids``.

    Queries of one stretch are compared in one product of single precision. All points that its error leaves in doubt are
    compared in double precision. Yields (query, places of points, cosines).
    """
    ids = np.arange(len(points)) if ids is None else ids
    doubt = 2 * (points.shape[1] + 8) * 2.0**-24  # twice the error: rounded components, products and sums
    unit = (points / np.sqrt((points * points).sum(1, keepdims=True))).astype(np.float32)
    a, b = np.searchsorted(strings, low), np.searchsorted(strings, high)
    order = np.lexsort((b, a))
    for part in np.split(order, np.flatnonzero(np.diff(a[order]) | np.diff(b[order])) + 1):
        if not len(part) or a[part[0]] == b[part[0]]:
            continue
        block = unit[a[part[0]] : b[part[0]]]
        for at in range(0, len(part), 256):
            some = part[at : at + 256]
            q = queries[some]
            near = (q / np.sqrt((q * q).sum(1, keepdims=True))).astype(np.float32) @ block.T
            m = min(k, near.shape[1])
            least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m] - doubt
            for i, row, edge in zip(some, near, least):
                places = np.flatnonzero(row >= edge) + a[part[0]]
                exact = cosine(points[places], queries[i])
                first = np.lexsort((ids[places], -exact))[:k]
                yield i, places[first], exact[first]


def search(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, seed: int = SEED, start: int = START, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest (by cosine) found for each row that ``queries`` (on vec_id) picks."""
    scratch = Scratch(df.sparkSession, "ann")
    spark = df.sparkSession
    rows = scratch.write(valid(df, vec_id, vector).withColumn("cid", F.unhex(F.md5("vec"))))
    # equal vectors: one point, with as many of its smallest ids as a result can need
    salted = rows.groupBy("cid", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    points = salted.groupBy("cid").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    points = scratch.write(points)
    asked = rows.where(queries).select("vec_id", "cid", "vec")
    n = points.count()
    finest = min(COUNT_BITS, max(1, math.ceil(math.log2(max(n, 2)))))
    first_bits = min(finest, max(0, math.ceil(math.log2(max(1, n / CELL)))))

    def strings(batches, of=tuple(range(trees))):
        for b in batches:
            h = hash_strings(_vectors(b.column(1)), list(of), seed)
            keep = np.repeat(np.arange(b.num_rows), len(of))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in b.columns] + [pa.array(np.tile(np.array(of, np.int32), b.num_rows)), pa.array(h.reshape(-1))], names=[*b.schema.names, "tree", "string"])

    # how many points lie below each node: at most trees x 2^COUNT_BITS numbers
    nodes = points.select("cid", "vec").mapInArrow(strings, "cid binary, vec binary, tree int, string long").groupBy("tree", F.shiftright("string", BITS - finest).alias("node")).count().toPandas()
    fine = np.zeros((trees, 1 << finest), np.int64)
    fine[nodes["tree"].to_numpy(int), nodes["node"].to_numpy(int)] = nodes["count"].to_numpy(int)
    counts = [fine]
    while counts[-1].shape[1] > 1:
        counts.append(counts[-1].reshape(trees, -1, 2).sum(2))
    counts = spark.sparkContext.broadcast(counts[::-1])  # by level, from the root
    wanted = min(max(start, 2 * (k + 1)), n)

    def levels(batches):
        """The level at which a query stops: ascending in all trees until they hold enough."""
        for b in batches:
            h = hash_strings(_vectors(b.column(1)), list(range(trees)), seed)
            level = np.zeros(b.num_rows, np.int32)
            for at in range(finest + 1):
                held = counts.value[at][np.arange(trees), h >> (BITS - at)].sum(1)
                level[held >= wanted] = at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(level)], names=[*b.schema.names, "level"])

    once = scratch.write(asked.select("cid", "vec").dropDuplicates(["cid"]).mapInArrow(levels, "cid binary, vec binary, level int"))

    def place(batches, of, spread):
        """Points go to one chunk of their cell, queries to all chunks of all cells that their stretch meets."""
        shift = BITS - first_bits
        for b in strings(batches, of):
            tree, string = b.column("tree").to_numpy(), b.column("string").to_numpy()
            chunks = lambda t, c: np.maximum(1, -(-counts.value[first_bits][t, c] // CHUNK))
            if not spread:
                cell = string >> shift
                own = np.array([int.from_bytes(x[:6], "big") for x in b.column("cid").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array((own % chunks(tree, cell)).astype(np.int32))], names=[*b.schema.names, "cell", "chunk"])
                continue
            level = b.column("level").to_numpy()
            at, cell, chunk = [], [], []
            for i in range(b.num_rows):
                wide = max(0, first_bits - int(level[i]))
                begin = (int(string[i]) >> shift) >> wide << wide
                for c in range(begin, begin + (1 << wide)):
                    for s in range(int(chunks(tree[i], c))):
                        at.append(i), cell.append(c), chunk.append(s)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in b.columns] + [pa.array(cell, pa.int64()), pa.array(chunk, pa.int32())], names=[*b.schema.names, "cell", "chunk"])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.binary()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.take(np.argsort(left["string"].to_numpy()))
        points, queries = (_vectors(t["vec"]) for t in (left, right))
        cut = BITS - right["level"].to_numpy().astype(np.int64)
        low = right["string"].to_numpy() >> cut << cut
        smallest = pc.list_element(left["ids"], 0).to_numpy()
        found = list(top_in_stretches(points, left["string"].to_numpy(), queries, low, low + (np.int64(1) << cut), k + 1, smallest))
        if not found:
            return empty
        asks = np.concatenate([np.full(len(p), i) for i, p, _ in found])
        places = np.concatenate([p for _, p, _ in found])
        return pa.table({"query": right["cid"].take(pa.array(asks)), "score": pa.array(np.concatenate([s for *_, s in found])), "ids": left["ids"].take(pa.array(places))})

    key = ["tree", "cell", "chunk", "turn"]
    plain = "cid binary, vec binary, ids array<long>, tree int, string long, cell long, chunk int"

    def ascend(queries_: DataFrame) -> DataFrame:
        """query, score and ids of the best in the stretches of all trees at the queries' levels."""
        kept, several = None, queries_.count() > ASKED
        for at in range(0, trees, TREES_AT_ONCE):
            of = tuple(range(trees)[at : at + TREES_AT_ONCE])
            stored = points.mapInArrow(lambda bs, of=of: place(bs, of, False), plain).drop("cid").withColumn("turn", F.lit(0))
            sent = queries_.mapInArrow(lambda bs, of=of: place(bs, of, True), "cid binary, vec binary, level int, tree int, string long, cell long, chunk int").withColumn("turn", F.lit(0))
            if several:  # crowds of queries are dealt out, each part meets the points of the chunk
                sent = scratch.write(sent)
                crowds = sent.groupBy("tree", "cell", "chunk").count().where(F.col("count") > ASKED).select("tree", "cell", "chunk", F.ceil(F.col("count") / ASKED).cast("int").alias("turns"))
                if not crowds.isEmpty():
                    sent = sent.drop("turn").join(crowds, ["tree", "cell", "chunk"], "left").withColumn("turn", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("turns")), F.lit(0)).cast("int")).drop("turns")
                    stored = stored.drop("turn").join(crowds, ["tree", "cell", "chunk"], "left").withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1))).drop("turns")
            new = scratch.write(stored.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(best, "query binary, score double, ids array<long>"))
            kept = new if kept is None else kept.union(new)
        return kept

    # first as far up as few candidates ask; then to where the k-th of them would have been met
    kept = ascend(once)
    ranked = kept.groupBy("query", "ids").agg(F.max("score").alias("score"))
    so_far = F.sum(F.size("ids")).over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = ranked.withColumn("n", so_far).where(F.col("n") > k).groupBy("query").agg(F.max("score").alias("score"))  # with the query itself
    wider = once.withColumnRenamed("cid", "query").join(last, "query", "left").withColumn("needed", F.coalesce(needed_level(F.col("score"), trees, recall), F.lit(0)))
    wider = scratch.write(wider.where("needed < level").select(F.col("query").alias("cid"), "vec", F.col("needed").alias("level")))
    if not wider.isEmpty():
        kept = kept.union(ascend(wider))

    # a query's finds: at most (k + 1) from each piece that it met
    found = kept.groupBy("query", "ids").agg(F.max("score").alias("score"))
    nearest = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("r") <= k + 1)
    whole = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")).distinct().join(nearest, "query")
    each = whole.select("query_id", "query", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
