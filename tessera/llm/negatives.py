"""Hard negatives by integer inner products, most of which are told from a rotation's leading components.

Components become whole numbers, floor(256 x). Products of whole vectors are the scores; to find an anchor's best rows, vectors are turned by an orthogonal
matrix (the principal axes of a bounded sample, :data:`SAMPLE`; turning changes no product). Products are summed up over leading components first: what the
others can still add lies within the product of the two residual norms (Cauchy and Schwarz), widened by a bound of the rounding errors. A pair whose
interval can't reach the asked range of scores, or the best that others have for certain, is given up early; what survives all components is
multiplied in whole numbers, which alone decide. So results are exact, whatever the axes are.

In Spark rows and anchors are dealt into blocks by a hash of their ids; each block of rows meets each block of anchors in one task (anchors are a stated
query set), which gives each anchor's best of the block. Blocks have at most about :data:`BLOCK` rows of either kind, so rows are copied once for every BLOCK anchors. Nothing
is grouped by label or by vector, so neither can be hot; in a block of repeated rows (one label, one vector) only those of the
smallest ids that a result can need are kept. A first pass finds the positives, a second one the negatives of their ranges.

Edge cases: rows with a null id, label or vector, an empty vector, null or non-finite components take no part, nor do vectors whose
squares of whole components sum up to 2^62 or more, as their scores could leave the range of a long; vectors of different lengths have no product, so they are not compared; rows that repeat in
id, label and vector count once; rows that share an anchor's id are never its positives; ties go to the smaller id; an anchor without positives, and a positive without negatives
in its range (as all of negative score are), give no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Rows of a block at most (about), rows that the axes are fitted on, and anchors that are worked on together.
BLOCK, SAMPLE, TOGETHER = 32_768, 20_000, 128
#: Leading components after which pairs are given up, as shares of all.
STAGES = (0.25, 0.5, 1.0)
SCALE = 256


def whole_rows(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label, vec (bytes of 32-bit whole components) and key (a digest of label and vec) of the rows that take part, each once."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 31) / SCALE)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")))

    def run(batches):
        for b in batches:
            vectors = [np.array(v, "<i4") for v in b.column(2).to_pylist()]
            fits = [float((v.astype(np.float64) ** 2).sum()) < 2.0**62 for v in vectors]
            kept = pa.record_batch([b.column(0), b.column(1), pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "label", "vec"])
            yield kept.filter(pa.array(fits, pa.bool_()))

    packed = rows.mapInArrow(run, "vec_id long, label long, vec binary")
    return packed.withColumn("key", F.unhex(F.md5(F.concat(F.encode(F.col("label").cast("string"), "UTF-8"), F.lit(b"|"), F.col("vec")))))


def vectors_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def axes(rows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The most common length of vectors in the sample, and its principal axes as columns, largest share first."""
    every = max(1, math.ceil(n / SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(every)) == 0).select("vec")
    common = sample.groupBy((F.length("vec") / 4).cast("int").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return 1, np.eye(1)
    dim = common[0]["dim"]

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = vectors_of(b.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    got = sample.where(F.length("vec") == 4 * dim).repartition(1).mapInArrow(moments, "m binary").collect()  # one matrix
    return dim, np.linalg.eigh(np.frombuffer(got[0]["m"]).reshape(dim, dim))[1][:, ::-1].copy()


class Side:
    """Vectors of one length: whole, turned, and the norms of what is left after each stage."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray, stages: list[int]):
        self.whole, self.turned = whole, whole.astype(np.float64) @ turn
        square = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        dim = whole.shape[1]
        self.left = {r: np.sqrt(square[:, r]) if r < dim else np.zeros(len(whole)) for r in stages}
        self.norm = np.sqrt((whole.astype(np.float64) ** 2).sum(1))


def stages_of(dim: int) -> list[int]:
    return sorted({max(1, round(dim * s)) for s in STAGES} | {dim})


def slack(dim: int) -> float:
    """A bound of the rounding errors of turning, of residual norms and of summing up, as a share of the product of norms."""
    return 8 * dim * (dim + 2) * 2.0**-53


def surviving(a: Side, rows: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, product up to rounding) of ``allowed`` ones whose product can lie from ``low`` to ``high``, and for a ``k`` among the k best of the anchor.

    All pairs of the block are summed up together while many are left, then only those that are.
    """
    dim = a.whole.shape[1]
    error = slack(dim)
    stages, before = stages_of(dim), 0
    sums, open_, at = np.zeros(allowed.shape), allowed, None
    for r in stages:
        if at is None:
            sums += a.turned[:, before:r] @ rows.turned[:, before:r].T
            room = np.outer(a.left[r], rows.left[r]) + error * np.outer(a.norm, rows.norm)
            if k is not None and sums.shape[1] > k:  # the k-th best that is certain
                sure = np.where(allowed, sums - room, -np.inf)
                low = np.maximum(low, np.partition(sure, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k])
            open_ = open_ & (sums + room >= low[:, None]) & (sums - room <= high[:, None])
            if np.count_nonzero(open_) * 8 < open_.size:
                at = np.nonzero(open_)
                sums = sums[at]
        else:
            i, j = at
            sums = sums + np.concatenate([np.einsum("ij,ij->i", a.turned[i[s : s + 65536], before:r], rows.turned[j[s : s + 65536], before:r]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            room = a.left[r][i] * rows.left[r][j] + error * a.norm[i] * rows.norm[j]
            keep = (sums + room >= low[i]) & (sums - room <= high[i])
            at, sums = (i[keep], j[keep]), sums[keep]
        before = r
    if at is None:
        at = np.nonzero(open_)
        sums = sums[at]
    return at[0], at[1], sums


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    return np.lexsort((ids, -score))[:k]


def needed_repeats(table: pa.Table, k: int) -> pa.Table:
    """Of rows of one label and vector those of the k + 1 smallest ids, each id once: an anchor itself may be one of them."""
    order = np.lexsort((table["vec_id"].to_numpy(), np.array(table["key"].to_pylist(), "S16") if table.num_rows else np.zeros(0, "S16")))
    table = table.take(pa.array(order))
    key, ids = np.array([k_.hex() for k_ in table["key"].to_pylist()], "U32"), table["vec_id"].to_numpy()
    new_key = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    new_row = new_key | (np.append(True, ids[1:] != ids[:-1]) if len(key) else new_key)
    table, new_key = table.filter(pa.array(new_row)), new_key[new_row]
    nth = np.arange(len(new_key)) - np.maximum.accumulate(np.where(new_key, np.arange(len(new_key)), 0))
    return table.filter(pa.array(nth <= k))


def by_length(left: pa.Table, right: pa.Table, fitted: tuple[int, np.ndarray]):
    """(rows, anchors, their sides, rows' ids and labels) for each length of vectors, anchors some at a time."""
    lengths = [np.array([len(v) // 4 for v in t["vec"].to_pylist()], np.int64) for t in (left, right)]
    for dim in np.intersect1d(*lengths).tolist():
        turn = fitted[1] if dim == fitted[0] else np.eye(dim)
        rows = left.filter(pa.array(lengths[0] == dim))
        rows_side = Side(vectors_of(rows["vec"], dim), turn, stages_of(dim))
        asked = right.filter(pa.array(lengths[1] == dim))
        for s in range(0, asked.num_rows, TOGETHER):
            some = asked.slice(s, TOGETHER)
            yield rows, some, rows_side, Side(vectors_of(some["vec"], dim), turn, stages_of(dim))


def mine(df: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives of the rows that ``anchors`` (on vec_id) picks.

    An anchor's positives are its best rows of its ``label``; a positive's negatives are the best rows of other labels whose
    score is from ``low_pct`` to ``high_pct`` per cent of the positive's.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.write(whole_rows(df, vec_id, vector, label))
    n = rows.count()
    asked = rows.where(anchors).dropDuplicates(["vec_id", "key"])
    fitted = axes(rows, n)
    cores = max(1, spark.sparkContext.defaultParallelism)
    row_blocks = max(1, math.ceil(n / block), min(cores, math.ceil(n / 1024)))  # as many as there are cores, unless they become tiny
    anchor_blocks = max(1, math.ceil(asked.count() / block))
    tasks = min(10_000, 2 * row_blocks * anchor_blocks)  # blocks are few bytes for the work that they are: they are not put together in few tasks
    places = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    hashed = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")

    def dealt():
        read = spark.read.schema(rows.schema).parquet(rows.tessera_path)  # a frame of its own beside the anchors'
        return read.withColumn("rb", hashed(1, row_blocks)).withColumn("ab", places(anchor_blocks)).repartition(tasks, "rb", "ab").groupBy("rb", "ab")

    def spread(questions: DataFrame):
        return questions.withColumn("ab", hashed(2, anchor_blocks)).withColumn("rb", places(row_blocks)).repartition(tasks, "rb", "ab").groupBy("rb", "ab")

    def like(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each anchor's best rows of its label in the block."""
        out = []
        left = needed_repeats(left, positives)
        for some, asks, b, a in by_length(left, right, fitted):
            ids, own = some["vec_id"].to_numpy(), asks["vec_id"].to_numpy()
            allowed = (asks["label"].to_numpy()[:, None] == some["label"].to_numpy()) & (own[:, None] != ids)
            i, j, _ = surviving(a, b, allowed, np.full(len(own), -np.inf), np.full(len(own), np.inf), positives)
            score = np.concatenate([(a.whole[i[s : s + 65536]] * b.whole[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
            cut = np.searchsorted(i, np.arange(len(own) + 1))
            for x in range(len(own)):
                at = slice(cut[x], cut[x + 1])
                for p in best(score[at], ids[j[at]], positives) + cut[x]:
                    out.append((int(own[x]), asks["key"][x].as_py(), int(ids[j[p]]), int(score[p]), some["key"][int(j[p])].as_py()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["vec_id", "key", "positive_id", "score", "positive_key"])

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each anchor's positives the best rows of other labels within their range, in the block."""
        out = []
        left = needed_repeats(left, negatives)
        for some, asks, b, a in by_length(left, right, fitted):
            ids, own = some["vec_id"].to_numpy(), asks["vec_id"].to_numpy()
            ranges = [[(at, p, -(-low_pct * p // 100), high_pct * p // 100) for at, p in enumerate(scores)] for scores in asks["scores"].to_pylist()]
            ranges = [[r for r in rs if r[2] <= r[3]] for rs in ranges]
            low = np.array([min((float(r[2]) for r in rs), default=np.inf) for rs in ranges])
            high = np.array([max((float(r[3]) for r in rs), default=-np.inf) for rs in ranges])
            # whole numbers beyond 2^53 are rounded as floats
            low, high = low - np.abs(low) * 2.0**-52, high + np.abs(high) * 2.0**-52
            low[~np.isfinite(low)], high[~np.isfinite(high)] = np.inf, -np.inf
            allowed = asks["label"].to_numpy()[:, None] != some["label"].to_numpy()
            i, j, about = surviving(a, b, allowed, low, high)
            cut = np.searchsorted(i, np.arange(len(own) + 1))
            error = slack(a.whole.shape[1])
            for x in range(len(own)):
                js, value = j[cut[x] : cut[x + 1]], about[cut[x] : cut[x + 1]]
                room = error * a.norm[x] * b.norm[js] + np.abs(value) * 2.0**-52
                for at, p, lo, hi in ranges[x]:
                    sure = np.where((value - room >= lo) & (value + room <= hi), value - room, -np.inf)
                    least = np.partition(sure, len(sure) - negatives)[len(sure) - negatives] if len(sure) >= negatives else -np.inf
                    left_ = js[(value + room >= max(lo, least)) & (value - room <= hi)]
                    score = b.whole[left_] @ a.whole[x]
                    left_, score = left_[(score >= lo) & (score <= hi)], score[(score >= lo) & (score <= hi)]
                    for q in best(score, ids[left_], negatives):
                        out.append((int(own[x]), asks["key"][x].as_py(), at, int(ids[left_[q]]), int(score[q]), some["key"][int(left_[q])].as_py()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["vec_id", "key", "at", "negative_id", "score", "negative_key"])

    found = dealt().cogroup(spread(asked)).applyInArrow(like, "vec_id long, key binary, positive_id long, score long, positive_key binary")
    order = Window.partitionBy("vec_id", "key").orderBy(F.desc("score"), "positive_id", "positive_key")
    chosen = scratch.write(found.withColumn("at", F.row_number().over(order) - 1).where(F.col("at") < positives).drop("positive_key"))
    # an anchor has a few positives
    lists = chosen.groupBy("vec_id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "score"))).alias("p")).select("vec_id", "key", F.col("p.score").alias("scores"))
    questions = asked.join(lists, ["vec_id", "key"])
    against = dealt().cogroup(spread(questions)).applyInArrow(unlike, "vec_id long, key binary, at int, negative_id long, score long, negative_key binary")
    order = Window.partitionBy("vec_id", "key", "at").orderBy(F.desc("score"), "negative_id", "negative_key")
    ranked = against.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives).withColumnRenamed("score", "negative_score")
    both = ranked.join(chosen.withColumnRenamed("score", "positive_score"), ["vec_id", "key", "at"])
    return both.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
