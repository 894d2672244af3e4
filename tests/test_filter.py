"""The static filter of large indexes: peeling, blocks in a file, and verdicts through it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, seeds
from tessera.functions.seeds import CONTIGUOUS_25, SPACED_29_33, Seed
from tessera.operators import coverage, index, static_filter
from tessera.plans import split
from tests.test_seeds import brute_covered, brute_seeds, random_dna


def hashes(n, seed=1):
    return hashing.mix64(np.random.default_rng(seed).choice(1 << 40, n, replace=False).astype(np.uint64))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 1000, 30_000])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_a_block_holds_its_keys(n, bits):
    h, size = hashes(n), static_filter.third(n)
    salt, block = static_filter.solve(h, size, bits)
    of = static_filter.StaticFilter("", bits, 0, np.zeros(1, np.int64), np.array([size]), np.array([salt]))
    assert of.holds(block, h).all()
    others = hashes(200_000, 2)
    others = others[~np.isin(others, h)]
    false = of.holds(block, others).sum()
    assert false <= 4 * len(others) / 2**bits + 5


def test_keys_that_do_not_part_are_told():
    at = np.array([[0, 0], [1, 1], [2, 2]])
    assert static_filter.peel(at, 3) is None


def test_many_buckets(spark):
    h = hashes(20_000)
    rows = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    of = static_filter.build_filter(rows, 20_000, 16, bucket=1000)
    assert of.top == 4 and of.holds(of.slots(), h).all()
    assert of.holds(of.slots(), hashes(100_000, 2)[20_000:]).sum() < 20
    empty = static_filter.build_filter(rows.where("false"), 0)
    assert empty.holds(empty.slots(), h).sum() == 0
    with pytest.raises(ValueError):
        static_filter.build_filter(rows, 20_000, 12)


@pytest.fixture
def large(monkeypatch):
    """Every index counts as too large to be sent, and has several buckets."""
    monkeypatch.setattr(index, "PROBE_LIMIT", 0)
    monkeypatch.setattr(static_filter.build_filter, "__defaults__", (32, 200))


def test_bases_through_the_filter(spark, large):
    seed, genome = Seed(SPACED_29_33), random_dna(3000, 9)
    own = index.build_index(spark.createDataFrame([(genome,)], "s string"), "s", seed)
    assert not own.small and own.filter.top > 2
    rng = random.Random(4)
    reads = [(k, genome[at : at + 150] if k % 2 else random_dna(150, k)) for k, at in enumerate(rng.randrange(2850) for _ in range(60))] + [(97, None), (98, ""), (99, genome[:1500] + "N" + genome[1600:])]
    df = spark.createDataFrame(reads, "k long, s string")
    known = {s for _, s in brute_seeds(genome, seed)}
    want = {k: brute_covered(s, known, seed) if s else 0 for k, s in reads}
    for how in ("auto", "verified", "join"):
        assert {r.k: r.covered for r in coverage.coverage(df, "k", "s", own, strategy=how).collect()} == want
    plan = coverage.coverage(df, "k", "s", own)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    records = df.select(F.lit("a").alias("sample"), F.lit(0).alias("mate"), F.col("k").alias("ordinal"), F.col("s").alias("seq"))
    assert "Exchange" not in split.split_reads(records, own)._jdf.queryExecution().executedPlan().toString()


def test_text_through_the_filter(spark, large):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé 日🎉") for _ in range(300))
    seed = Seed(CONTIGUOUS_25)
    own = index.build_index(spark.createDataFrame([(passage,)], "s string"), "s", seed, dna=False)
    docs = [(0, "x" * 40 + passage[20:90] + "y" * 9), (1, passage), (2, "nothing of it"), (3, None), (4, passage[:24])]
    df = spark.createDataFrame(docs, "k long, s string")
    want = {0: 70, 1: 300, 2: 0, 3: 0, 4: 0}
    for how in ("auto", "verified", "join"):
        assert {r.k: r.covered for r in coverage.coverage(df, "k", "s", own, strategy=how).collect()} == want


def test_false_finds_are_verified(spark, large):
    """With fingerprints of eight bits some windows are found that are not there; the join takes them out."""
    seed, genome = Seed(CONTIGUOUS_25), random_dna(2000, 9)
    own = index.build_index(spark.createDataFrame([(genome,)], "s string"), "s", seed)
    own.filter_bits = 8
    df = spark.createDataFrame([(k, random_dna(400, 100 + k)) for k in range(60)], "k long, s string")
    found = coverage.found_windows(df, "k", "s", own)
    n = found.count()
    assert 20 < n < 60 * 376 / 256 * 2
    assert found.join(own.codes, "seed", "left_semi").count() == 0
    assert coverage.coverage(df, "k", "s", own, strategy="verified").agg(F.sum("covered")).first()[0] == 0


def test_prints_that_collide_are_told_apart():
    p = coverage.Prober(np.array([5, 5, 5, 9], np.uint64), np.array([3, 1, 2, 4], np.uint64), Seed("###"), False, False, "strict")
    assert p.most == 3 and p.second.tolist() == [1, 2, 3, 4]


def shuffled_windows(df):
    """The expressions of the plan's exchanges, and whether something is joined on seeds."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x], "LeftSemi" in plan


def test_hits_of_bases_are_verified_where_they_lie(spark, large):
    """F16: false finds of eight bits are taken out by the mapped table; no window is shuffled."""
    seed, genome = Seed(SPACED_29_33), random_dna(2000, 9)
    own = index.build_index(spark.createDataFrame([(genome,)], "s string"), "s", seed).mapped(8)
    texts = [None, "", genome[:33], genome[:20], *(random_dna(400, 100 + k) for k in range(60)), genome[5:400] + "N" + genome[401:900]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, s string")
    known = {s for _, s in brute_seeds(genome, seed)}
    want = sorted((k, pos) for k, t in enumerate(texts) for pos, s in brute_seeds(t or "", seed) if s in known)
    hits = coverage.seed_hits(df, "k", "s", own)
    assert shuffled_windows(hits) == ([], False)
    assert sorted(map(tuple, hits.collect())) == want
    assert coverage.found_windows(df, "k", "s", own).count() > len(want)
    rows = np.unique(static_filter.build_table(own.hashes(), own.size, 200).rows())
    assert len(rows) == own.size == len(known) and (np.diff(own.table.rows().astype(object)) > 0).all() and (own.table.rows() == rows).all()
    empty = static_filter.build_table(own.hashes().where("false"), 0)
    assert not empty.holds(empty.rows(), rows).any()


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_stretches_take_the_place_of_windows(spark, large, monkeypatch, piece):
    """stretches are shuffled, one for a run of hits; rows of one key are taken together; long records are cut."""
    monkeypatch.setattr(coverage, "PIECE", piece)
    seed, genome = Seed(SPACED_29_33), random_dna(900, 9)
    own = index.build_index(spark.createDataFrame([(genome,)], "s string"), "s", seed)
    texts = [(0, genome), (1, genome[10:160]), (1, genome[10:60] + random_dna(100, 5)), (2, genome[:33]), (3, genome[7:40]), (3, None), (4, ""), (5, random_dna(300, 6))]
    df = spark.createDataFrame(texts, "k long, s string")
    got = [tuple(r) for r in coverage.found_stretches(df, "k", "s", own).collect() if piece > 40]
    assert sorted(got)[:3] == [(0, 0, 900), (1, 0, 50), (1, 0, 150)][: len(got)] and len(got) in (0, 3 + 2 * len(seed.runs))
    want = {0: 900, 1: 150, 2: seed.weight, 3: seed.weight, 4: 0, 5: 0}
    for how in ("join", "verified"):
        c = coverage.coverage(df, "k", "s", own, strategy=how)
        assert {r.k: r.covered for r in c.collect()} == want and not shuffled_windows(c)[1]


@pytest.mark.parametrize("bits", [8, 32])
def test_scores_do_not_depend_on_the_way_of_the_index(spark, monkeypatch, bits):
    """an index that is mapped decides as one that is sent, however many false finds its filter has."""
    seed, genome = Seed(SPACED_29_33), random_dna(2000, 9)
    texts = [None, "", genome[:33], genome[:20], *(random_dna(400, 100 + k) for k in range(60)), genome[5:400] + "N" + genome[401:900]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, s string")
    known = {s for _, s in brute_seeds(genome, seed)}
    want = {k: brute_covered(t, known, seed) * 1000 // len(t) if t else None for k, t in enumerate(texts)}
    for limit, buckets in ((index.PROBE_LIMIT, 1 << 19), (0, 1 << 19), (0, 200)):
        monkeypatch.setattr(index, "PROBE_LIMIT", limit)
        monkeypatch.setattr(static_filter.build_filter, "__defaults__", (32, buckets))
        own = index.build_index(spark.createDataFrame([(genome,)], "s string"), "s", seed)
        own.filter_bits = bits
        assert own.small == (limit > 0)
        c = coverage.coverage(df, "k", "s", own)
        assert "Exchange" not in c._jdf.queryExecution().executedPlan().toString()
        assert {r.k: r.score for r in c.select("k", coverage.score(F.col("covered"), F.col("length")).alias("score")).collect()} == want


def test_coverage_of_text_does_not_depend_on_the_way_of_the_index(spark, large):
    """of texts, too, what a filter of eight bits finds is held."""
    rng = random.Random(5)
    passage, seed = "".join(rng.choice("abcdé 日🎉") for _ in range(2000)), Seed(CONTIGUOUS_25)
    own = index.build_index(spark.createDataFrame([(passage,)], "s string"), "s", seed, dna=False).mapped(8)
    others = ["".join(rng.choice("abcdé 日🎉") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([None, "", passage, others[0] + passage[50:99], *others])), "k long, s string")
    want = {0: 0, 1: 0, 2: 2000, 3: 49} | {k: 0 for k in range(4, 64)}
    assert own.table.n == own.size == len({passage[i : i + 25] for i in range(1976)}) and own.filter.top > 2
    c = coverage.coverage(df, "k", "s", own)
    assert {r.k: r.covered for r in c.collect()} == want and "Exchange" not in c._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [1 << 19, 20])
def test_second_prints_decide_in_a_mapped_index(spark, monkeypatch, bucket):
    """First prints that many windows share: that of the last character alone."""
    monkeypatch.setattr(seeds, "_PRINTS", ((np.uint64(0), np.uint64(1)), seeds._PRINTS[1]))
    seed, rng = Seed("###"), random.Random(3)
    passage, asked = ("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n)) for n in (400, 9000))
    points = np.frombuffer("".join(sorted({passage[i : i + 3] for i in range(398)})).encode("utf-32-le"), np.uint32)
    first, second = (seeds.text_prints(points, seed, k, np.arange(0, len(points), 3)) for k in (0, 1))
    rows = [(int(h), int(s)) for h, s in zip(hashing.mix64(first).view(np.int64), second.view(np.int64))]
    of = static_filter.build_filter(spark.createDataFrame(rows, "h long, second long"), len(rows), 8, bucket=bucket)
    assert of.table.most == coverage.Prober(first, second, seed, False, False, "").most > 5
    want = [i for i in range(len(asked) - 2) if asked[i : i + 3] in passage]
    own = static_filter.ExactProber(of, seed, False, False, "")
    assert len(want) > 100 and own.hits(own.points(asked))[0].tolist() == want
