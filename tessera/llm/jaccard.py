"""N-gram Jaccard join by parity sketches: XOR-hash, pigeonhole per size band, verify, connect.

A text's set holds its distinct word n-grams, as 64-bit hashes. Texts with equal sets make one class, known
by a 128-bit fingerprint, so copies cost nothing further. For sets of sizes a and b with a similarity of num/den or more the symmetric
difference has at most d = (a + b)(den - num) / (den + num) members. Each member flips one bit of a parity sketch, so
the Hamming distance of two sketches is at most their symmetric difference. A size band's sketches are cut
into d + 1 + s parts (for the band's largest d): d flips leave s + 1 parts equal at least. Of its parts a set shows all but the s
with the fewest members, in an order of parts that all sets share; the greatest of the equal parts is then shown by
both. So classes that show no part in common cannot link, no link is lost, and (nearly) empty parts, which many texts share, are never
shown. (A part also holds the XOR of its members' hashes, so that parts are equal only if their
members are.) Pairs whose sketches are further apart than their sizes allow are dropped before any set is made.

Parts with more than one class are handled as stars first: each member is compared, by sketches and then on the sets
themselves, with the least class of its part. Links give components. What is left are parts whose members still
lie in different components, such as those of many texts that are alike, but not enough. They are settled by rare-first prefixes:
the members of a set are put in a common order, rare ones first; linked sets share one of their first
n - ceil(n num/den) + 1, and what stands before the first one they share counts towards their difference. Copies that were edited
apart begin with their own edits and so are not paired. Pairs that are already connected are never made.

Counts grow with the data only in Spark: nothing is collected, nothing broadcast by hand, and groups are formed with
partial aggregation or by joins that the adaptive planner can split.

Edge cases: texts without words (null and empty ones too) have an empty set, link with nothing and are their own component; with fewer
words than n the whole sequence is the one member; repeated rows and equal ids are one class if their sets
are equal; a null id does not take part in the smallest id of its component; a very long text is one set, built where it lies; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, unused

WORDS = 5
NUM, DEN = 80, 100
#: Parts that are not shown, as a percentage of those that are.
SPARE = 35
#: Sizes of a band differ by this factor at most.
BAND = 1.5
#: Up to so many ids of 8 bytes are broadcast to pick texts; beyond, texts and ids are shuffled.
BROADCAST = 1_000_000
#: Rounds of stars before what is left is paired.
STARS = 2
#: Words whose hashes a task keeps.
CACHE = 300_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a whole text."""
    words = (text or "").encode("utf-8").lower().split()  # ASCII letters and white space only
    m = len(words)
    if not m:
        return np.zeros(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, m)
    width = min(n, m)
    out = np.full(m - width + 1, width, _U)
    for k in range(width):
        out = (out ^ h[k : m - width + 1 + k]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return np.unique(_mix(out))


class Bands:
    """Size bands and, for each, into how many parts its sketches are cut."""

    def __init__(self, num: int, den: int, band: float = BAND):
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 31:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * max(band, den / num) + 0.999)))

    def most(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def parts(self, g: int) -> int:
        hi = self.edges[g + 1] - 1
        shown = self.most(hi, hi * self.den // self.num) + 1
        return shown + -(-shown * SPARE // 100)

    def shown(self, g: int) -> int:
        """How many of its parts a set shows."""
        hi = self.edges[g + 1] - 1
        return self.most(hi, hi * self.den // self.num) + 1

    def groups(self, n: int) -> list[int]:
        """The bands in which a set of size n meets others: its own, and the one below if it can link there."""
        if self.most(n, n * self.den // self.num) < 1 and self.most(n, n) < 1:
            return []  # only equal sets link
        g = int(np.searchsorted(self.edges, n, "right")) - 1
        below = g > 0 and n * self.num <= (self.edges[g] - 1) * self.den
        return [g - 1, g] if below else [g]


#: The bits of a part that tell its members' parity; the others hold the XOR of their hashes.
PARITY = 24


def sketch(hashes: np.ndarray, parts: int, shown: int) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketch of a set of sorted hashes, in so many parts of 64 bits, and the places of those shown."""
    part = ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)  # ascending, as the hashes are
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    own = _mix(hashes)
    flips = (own & ~_U((1 << PARITY) - 1)) | (_U(1) << (hashes & _U(0xFFFF)) % _U(PARITY))
    out, size = np.zeros(parts, _U), np.zeros(parts, np.int64)
    if len(starts):
        out[part[starts]] = np.bitwise_xor.reduceat(flips, starts)
        size[part[starts]] = np.diff(starts, append=len(hashes))
    places = np.sort(np.lexsort((np.arange(parts), out, size))[parts - shown :])  # an order by the part alone
    return out.view(np.int64), places.astype(np.int32)


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    flipped = a.view(_U) ^ b.view(_U)
    return int(np.maximum(np.bitwise_count(flipped & _U((1 << PARITY) - 1)), flipped != 0).sum())


SKETCHES = pa.list_(pa.struct([("band", pa.int32()), ("parts", pa.list_(pa.int64())), ("shown", pa.list_(pa.int32()))]))


def profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, fp (of the set), n (its size) and its sketches (band, parts, places shown) of each row of (doc_id, text)."""

    def run(batches):
        bands, cache = Bands(num, den), WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                sets = [shingles(t.as_py(), n, cache) for t in b.column(1)]
                made = [[dict(zip(("band", "parts", "shown"), (g, *sketch(s, bands.parts(g), bands.shown(g))))) for g in bands.groups(len(s))] for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(made, SKETCHES)], names=["doc_id", "fp", "n", "sketches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp binary, n long, sketches array<struct<band:int,parts:array<bigint>,shown:array<int>>>")


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """fp and the members (as bytes) of the sets of the texts."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingles(t.as_py(), n, cache).tobytes() for t in batch.slice(at, 1000).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["fp", "members"])

    return texts.select("text").mapInArrow(run, "fp binary, members binary")


def sketches_allow(num: int, den: int) -> Column:
    """Whether two sets of sizes n_a and n_b with sketches s_a and s_b can link."""
    bands = Bands(num, den)

    def test(n_a: pa.Array, n_b: pa.Array, s_a: pa.Array, s_b: pa.Array) -> pa.Array:
        out = []
        for a, b, x, y in zip(n_a.to_pylist(), n_b.to_pylist(), s_a, s_b):
            x, y = ({p["band"].as_py(): p["parts"].values.to_numpy() for p in v} for v in (x, y))
            g = next(iter(x.keys() & y.keys()), None)
            out.append(g is not None and distance(x[g], y[g]) <= bands.most(a, b))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(test, "boolean")("n_a", "n_b", "s_a", "s_b")


#: Words of the small sketches that go with rare members.
FOLD = 4


def folds(named: DataFrame) -> DataFrame:
    """cid and a parity sketch of FOLD x 64 bits of the whole set, as columns f0, f1, ..."""

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, FOLD), _U)
            for i, v in enumerate(b.column(1)):
                h = _mix(np.frombuffer(v.as_buffer(), _U) ^ _U(0x51ED))
                odd = np.bincount((h & _U(64 * FOLD - 1)).astype(np.int64), minlength=64 * FOLD) & 1
                out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(_U)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, k].view(np.int64)) for k in range(FOLD))], names=["cid", *(f"f{k}" for k in range(FOLD))])

    return named.select("cid", "members").mapInArrow(run, "cid long, " + ", ".join(f"f{k} long" for k in range(FOLD)))


def rare_first(named: DataFrame, num: int, den: int) -> DataFrame:
    """cid, n, token and place of the first members of each set, in a common order with rare ones first.

    ``named``: cid, n and members. Members of one set alone come before all others and find nothing, so they are only counted.
    """

    def tokens(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(2)]
                rows = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(sets), pa.int64())], names=["cid", "n", "token"])

    every = named.select("cid", "n", "members").mapInArrow(tokens, "cid long, n long, token long")
    often = every.groupBy("token").count().where("count > 1")
    order = Window.partitionBy("cid").orderBy("count", "token")
    of_set = Window.partitionBy("cid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = every.join(often, "token").withColumn("place", F.row_number().over(order) - 1 + F.col("n") - F.count(F.lit(1)).over(of_set))
    most = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    return placed.where(F.col("place") < most).select("cid", "n", "token", "place")


def common_members(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many members two sets (sorted hashes as bytes) have in common."""
    out = []
    for x, y in zip(a, b):
        p, q = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
        at = np.searchsorted(p, q)
        at[at == len(p)] = 0
        out.append(int((p[at] == q).sum()) if len(p) else 0)
    return pa.array(out, pa.int64())


def linked(common: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return common * den >= (a + b - common) * num


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the least node of its component) for the nodes of ``edges`` (a, b: bigint).

    Labels sink along the edges and then along themselves (pointer jumping) until none changes.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        sunk = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = scratch.write(sunk.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        scratch.drop(labels)
        labels = new
        if new.where("label < old").isEmpty():
            scratch.drop(both)
            return new.select("node", "label")


def widened(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, label) with more edges (a, b): only the components that these join are worked on."""
    ends = [edges.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")), c, "left").select("a", "b", F.coalesce(f"l_{c}", c).alias(f"l_{c}")) for c in "ab"]
    between = ends[0].join(ends[1], ["a", "b"]).select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).where("a != b").distinct()
    tops = components(between, scratch)
    known = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = tops.join(labels.select("node"), "node", "left_anti")
    return scratch.write(known.union(fresh.select("node", "label")))


def _ident(column: str) -> Column:
    """An id as a number that may be shared by chance; only what it finds is looked at closely."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, group_id and fp of each row.

    Rows of one class_id have equal sets (fp is the set's fingerprint); group_id numbers the components; component_id is the smallest id of
    the component. Rows with an empty set have neither class nor group.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    profiled = scratch.write(profiles(docs, n, num, den))
    classes = profiled.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    keyed = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()))
    rows = scratch.write(profiled.drop("sketches"))
    classes = scratch.write(keyed.drop("sketches"))
    scratch.drop(profiled)
    scratch.release()

    # parts that classes share; only their members go on
    bands = keyed.select("cid", "n", F.explode("sketches").alias("s"))
    shown = F.transform("s.shown", lambda i: F.xxhash64("s.band", i, F.get("s.parts", i)))
    parts = bands.select("cid", "n", F.explode(shown).alias("key"))
    shared = scratch.write(parts.groupBy("key").agg(F.count("*").alias("in_part"), F.min("cid").alias("lead")).where("in_part > 1"))
    scratch.release()
    members = scratch.write(parts.join(shared, "key"))
    scratch.drop(shared)

    def near_in_size(x: Column, y: Column) -> Column:
        return F.least(x, y) * den >= F.greatest(x, y) * num

    def picked(table: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
        """``table`` without rows that a join with ``wanted`` (distinct values of ``column``) drops anyhow, where that costs no shuffle."""
        wanted = scratch.write(wanted)
        return table.join(F.broadcast(wanted), column, "left_semi") if wanted.count() <= BROADCAST else table

    def make_sets(nodes: DataFrame) -> DataFrame:
        """fp and members of the classes ``nodes`` (cid), from a text of each."""
        wanted = scratch.write(classes.join(nodes, "cid", "left_semi").select("fp", _ident("rep").alias("ident")))
        idents = wanted.select("ident").distinct()
        if wanted.count() <= BROADCAST:
            idents = F.broadcast(idents)
        texts = docs.withColumn("ident", _ident("doc_id")).join(idents, "ident", "left_semi")
        made = sets_of(texts, n).groupBy("fp").agg(F.first("members").alias("members"))
        return scratch.write(made)

    def linking(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Those of the distinct pairs (a, b) that link: first by their sketches, then by the sets themselves."""
        pairs = scratch.write(pairs)
        ends = picked(keyed, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid")
        left, right = (ends.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}"), F.col("sketches").alias(f"s_{c}")) for c in "ab")
        near = pairs.join(left, "a").join(right, "b").where(sketches_allow(num, den)).select("a", "b", "n_a", "n_b", "fp_a", "fp_b")
        near = scratch.write(near)
        if sets is None:
            sets = make_sets(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        else:
            sets = picked(sets, near.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct(), "fp")
        left, right = (sets.select(F.col("fp").alias(f"fp_{c}"), F.col("members").alias(f"m_{c}")) for c in "ab")
        both = near.join(left, "fp_a").join(right, "fp_b").withColumn("common", F.arrow_udf(common_members, "long")("m_a", "m_b"))
        out = scratch.write(both.where(linked(F.col("common"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b"))
        scratch.release()
        return out

    sizes = members.select(F.col("cid").alias("lead"), F.col("n").alias("lead_n")).distinct()
    stars = members.where("cid != lead").select("cid", "n", "lead").distinct().join(sizes, "lead").where(near_in_size(F.col("n"), F.col("lead_n")))
    edges = linking(stars.select(F.col("lead").alias("a"), F.col("cid").alias("b")))
    labels = components(edges, scratch)

    # members of parts that still lie apart
    labelled = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("in_part").alias("in_part")).where("x < y and in_part > 2").select("key")
    left_over = scratch.write(labelled.join(apart, "key", "left_semi").select("cid", "n", "label").distinct())
    scratch.release()
    sets = make_sets(left_over.select("cid"))
    named = left_over.join(classes.select("cid", "fp"), "cid").join(sets, "fp").select("cid", "n", "members")
    small = scratch.write(folds(named))
    first = scratch.write(rare_first(named, num, den))
    scratch.release()

    def apart_at_most(x: str, y: str) -> Column:
        """Whether the difference can be small enough: by what stands before the first common member, and by the small sketches."""
        flips = sum((F.bit_count(F.col(f"f{k}{x}").bitwiseXOR(F.col(f"f{k}{y}"))) for k in range(FOLD)), F.lit(0))
        return F.greatest(F.col(f"place{x}") + F.col(f"place{y}"), flips) * (den + num) <= (F.col(f"n{x}") + F.col(f"n{y}")) * (den - num)

    def relabelled() -> DataFrame:
        return first.join(small, "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(f"cid{x}", f"cid{y}").alias("a"), F.greatest(f"cid{x}", f"cid{y}").alias("b")]

    fold = [f"f{k}" for k in range(FOLD)]
    for _ in range(STARS):  # each with the one that shows a member first: what these connect is not paired below
        here = relabelled()
        leads = here.groupBy("token").agg(F.min(F.struct("place", "cid", "n", "label", *fold)).alias("l")).select("token", *(F.col(f"l.{c}").alias(f"{c}_l") for c in ("place", "cid", "n", "label", *fold)))
        leads = scratch.write(leads)  # so that the join's sides are dealt out for it alone, and a hot token's rows can be split
        to_lead = here.join(leads, "token").where((F.col("label") != F.col("label_l")) & near_in_size(F.col("n"), F.col("n_l")) & apart_at_most("", "_l"))
        more = linking(to_lead.select(*pair("", "_l")).distinct(), sets)
        if more.isEmpty():
            break
        labels = widened(labels, more, scratch)
    here = scratch.write(relabelled())
    x, y = (here.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "label", "place", *fold))) for s in "xy")
    ordered = F.struct("place_x", "cid_x") < F.struct("place_y", "cid_y")
    rest = x.join(y, "token").where((F.col("label_x") != F.col("label_y")) & near_in_size(F.col("n_x"), F.col("n_y")) & apart_at_most("_x", "_y") & ordered)
    more = linking(rest.select(*pair("_x", "_y")).distinct(), sets)
    if not more.isEmpty():
        labels = widened(labels, more, scratch)
    scratch.drop(keyed)

    named = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    known = classes.select("fp", "cid", "rep").join(named.join(least, "label").select(F.col("node").alias("cid"), "label", "least"), "cid", "left")
    known = known.select("fp", F.col("cid").alias("class_id"), F.coalesce("label", "cid").alias("group_id"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(known, "fp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_id", "group_id", "fp")


def jaccard_components(docs: DataFrame, **args) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and group_id of each row (see :func:`grouped`)."""
    return grouped(docs, **args).drop("fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` with one row of each group: that of the smallest id.

    Rows without words all stay. Among rows that share the smallest id (or a null one) of a group one stays.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    got = scratch.write(grouped(docs, doc_id, text, n, num, den).withColumn("ident", _ident("doc_id")))
    (ident, fp, turn) = unused(docs, "ident", "fp", "turn")
    mine = F.col(f"`{doc_id}`")
    rows = docs.withColumn(ident, F.xxhash64(F.coalesce(mine.cast("string"), F.lit(""))))
    many = scratch.write(got.groupBy("ident").count().where("count > 1").select(F.col("ident").alias(ident)))
    gone = got.where("n_shingles > 0 and not doc_id <=> component_id").select(F.col("ident").alias(ident))
    leave = scratch.write(gone.union(many).distinct())
    if leave.count() <= BROADCAST:
        leave = F.broadcast(leave)
    kept = rows.join(leave, ident, "left_anti")
    if not many.isEmpty():  # rows that share their id: told apart by their sets

        def prints(texts: pa.Array) -> pa.Array:
            cache = WordHashes()
            return pa.array([xxhash.xxh3_128_digest(shingles(t.as_py(), n, cache).tobytes()) for t in texts], pa.binary())

        same = rows.join(many, ident, "left_semi").withColumn(fp, F.arrow_udf(prints, "binary")(F.col(f"`{text}`")))
        known = got.select(F.col("fp").alias(fp), "class_id", "group_id", "component_id").where("class_id is not null").dropDuplicates([fp])
        renamed = unused(same, "class_id", "group_id", "component_id")
        known = known.select(fp, *(F.col(c).alias(r) for c, r in zip(("class_id", "group_id", "component_id"), renamed)))
        same = same.join(known, fp, "left")
        group = F.col(renamed[1])
        order = Window.partitionBy(group).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        named = same.where(group.isNotNull() & mine.eqNullSafe(F.col(renamed[2]))).withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
        kept = kept.select(*(F.col(f"`{c}`") for c in docs.columns)).union(named.select(*(F.col(f"`{c}`") for c in docs.columns)))
        kept = kept.union(same.where(group.isNull()).select(*(F.col(f"`{c}`") for c in docs.columns)))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
