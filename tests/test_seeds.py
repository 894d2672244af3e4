import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, seeds
from tessera.functions.seeds import CONTIGUOUS_25, SPACED_29_33, Seed
from tessera.operators import coverage, index

CODE = dict(zip("ACTGU", "01232"))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute_seeds(seq, seed, canonical=True):
    out = []
    for i in range(len(seq) - seed.span + 1):
        win = seq[i : i + seed.span].upper()
        if set(win) - set("ACGTU"):
            continue
        f = "".join(CODE[win[p]] for p in seed.positions)
        b = "".join(str(int(c) ^ 2) for c in reversed(f))
        out.append((i, max(f, b) if canonical else f))
    return out


def brute_covered(seq, known, seed):
    return len({i + p for i, s in brute_seeds(seq, seed) if s in known for p in seed.positions})


def random_dna(n, seed=0, letters="ACGT"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def test_mask_is_checked():
    s = Seed(SPACED_29_33)
    assert (s.weight, s.span, s.runs) == (29, 33, [(0, 6), (7, 7), (15, 3), (19, 7), (27, 6)])
    for bad in ("", "_##", "##_###", "#x#", "#" * 33):
        with pytest.raises(ValueError):
            Seed(bad)


@pytest.mark.parametrize("mask", [SPACED_29_33, CONTIGUOUS_25, "##_##"])
def test_seeds_as_by_hand(spark, mask):
    seed = Seed(mask)
    rows = [(0, random_dna(120, 1)), (1, random_dna(120, 2, "ACGTN")), (2, "acgu" * 20), (3, ""), (4, "ACG"), (5, None), (6, "1234ACGT" * 9)]
    df = spark.createDataFrame(rows, "k int, s string")
    got = {(r.k, r.pos, r.seed) for r in index.read_seeds(df, "k", "s", seed).collect()}
    assert got == {(k, i, s) for k, t in rows if t for i, s in brute_seeds(t, seed)}


def test_strand_does_not_matter(spark):
    s = random_dna(200, 3)
    df = spark.createDataFrame([(0, s), (1, rc(s))], "k int, s string")
    by = {}
    for r in index.read_seeds(df, "k", "s", Seed(SPACED_29_33)).collect():
        by.setdefault(r.k, set()).add(r.seed)
    assert by[0] == by[1]


def test_lenient_alphabet(spark):
    """Letters whose bits make a base are taken for one, others are not."""
    df = spark.createDataFrame([("ACGTURSBDWVNYKMH-.",)], "s string")
    strict, lenient = df.select(seeds.base_codes(F.col("s")), seeds.base_codes(F.col("s"), "reference")).first()
    assert strict == "01322............."
    want = "".join(str(c) if (c := (ord(x) >> 1) & 7) <= 3 else "." for x in "ACGTURSBDWVNYKMH-.")
    assert lenient == want


@pytest.mark.parametrize("mask", [SPACED_29_33, CONTIGUOUS_25])
def test_coverage_strategies_agree_with_brute_force(spark, mask):
    seed, ref = Seed(mask), random_dna(600, 5)
    r = random.Random(6)
    reads = []
    for k in range(40):
        a = r.randrange(0, 450)
        s = list(ref[a : a + 150])
        for _ in range(k % 8):
            s[r.randrange(150)] = r.choice("ACGTN")
        s = "".join(s)
        reads.append((k, rc(s) if k % 2 and "N" not in s else s))
    reads += [(100, random_dna(150, 7)), (101, ""), (102, None), (103, "ACGT"), (104, ref[:150].lower()), (105, ref * 2)]
    df = spark.createDataFrame(reads, "k int, s string")
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    known = {s for _, s in brute_seeds(ref, seed)}
    want = {k: (len(s or ""), brute_covered(s or "", known, seed)) for k, s in reads}
    for how in ("join", "probe"):
        got = {x.k: (x.length, x.covered) for x in coverage.coverage(df, "k", "s", own, strategy=how).collect()}
        assert got == want, how
    guarded = {x.k: x.covered for x in coverage.coverage(df, "k", "s", own, max_length=1024).collect()}
    assert guarded[105] == 0 and guarded[0] == want[0][1]


def test_text_outside_the_basic_plane(spark):
    seed = Seed(CONTIGUOUS_25)
    passage = "ein Satz mit 😀 und é und noch viel mehr davon"
    df = spark.createDataFrame([(0, "x" * 30 + passage + "y" * 9), (1, "nichts davon steht in diesem langen Satz hier")], "k int, s string")
    own = index.build_index(spark.createDataFrame([(passage,)], "s string"), "s", seed, dna=False)
    for how in ("join", "probe"):
        assert {x.k: x.covered for x in coverage.coverage(df, "k", "s", own, strategy=how).collect()} == {0: len(passage), 1: 0}


def test_threshold_edges(spark):
    df = spark.createDataFrame([(100, 100), (50, 100), (51, 100), (0, 100), (1, 100), (0, 0)], "c int, n int")
    hit = lambda p: [r[0] for r in df.select(coverage.matches(F.col("c"), F.col("n"), p)).collect()]
    assert hit(1000) == [False] * 6
    assert hit(500) == [True, False, True, False, False, False]
    assert hit(0) == [True, True, True, False, True, False]
    assert [r[0] for r in df.select(coverage.score(F.col("c"), F.col("n"))).collect()] == [1000, 500, 510, 0, 10, None]


def test_coverage_is_not_the_share_of_seeds(spark):
    """Two hits far apart cover twice their span, though few of the seeds are found."""
    seed, ref = Seed(CONTIGUOUS_25), random_dna(50, 8)
    read = ref[:25] + random_dna(50, 9) + ref[25:]
    own = index.build_index(spark.createDataFrame([(ref[:25],), (ref[25:],)], "s string"), "s", seed)
    got = spark.createDataFrame([(0, read)], "k int, s string").select(coverage.probe(F.col("s"), own).alias("p")).first().p
    assert (got.covered, got.found, got.seeds) == (50, 2, 76)


def test_approximate_filter_is_a_join_on_fingerprint_and_bucket(spark):
    """Against a filter that is filled by moving fingerprints about."""
    M = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & M
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & M
        return x ^ x >> 31

    def spots(key, mask):
        h = mix(key)
        fp = max(1, h >> 48)
        return fp, h & mask, (h & mask) ^ (mix(fp) & mask)

    mask, r = (1 << 8) - 1, random.Random(1)
    table = [[] for _ in range(mask + 1)]
    keys = r.sample(range(1 << 40), 700)
    inserted = 0
    for k in keys:
        fp, a, b = spots(k, mask)
        if fp in table[a] or fp in table[b]:
            continue
        inserted += 1
        at = a if len(table[a]) < 4 else b
        for _ in range(500):
            if len(table[at]) < 4:
                break
            i = r.randrange(4)
            table[at][i], fp = fp, table[at][i]
            at ^= mix(fp) & mask
        table[at].append(fp)
        assert len(table[at]) <= 4
    rows = spark.createDataFrame([(k,) for k in keys], "code long")
    stats = index.index_stats(rows, 8).first()
    assert (stats.inserted, stats.failed, stats.load_permille) == (inserted, 0, inserted * 1000 // 1024)
    asked = keys[:50] + r.sample(range(1 << 40), 3000)
    put = index.approximate(rows, 8).select("fp", "low").distinct()
    found = index.approximate(spark.createDataFrame([(k,) for k in asked], "code long"), 8).join(put, ["fp", "low"], "left_semi")
    want = sorted(k for k in asked if (s := spots(k, mask)) and (s[0] in table[s[1]] or s[0] in table[s[2]]))
    assert sorted(x.code for x in found.collect()) == want
    assert spark.createDataFrame([(None,), (-1,)], "code long").select(hashing.hash_mix(F.col("code"))).first()[0] is None


def test_index_is_saved_and_loaded(spark, tmp_path):
    own = index.build_index(spark.createDataFrame([(random_dna(100, 2),)], "s string"), "s", Seed(CONTIGUOUS_25))
    own.save(str(tmp_path / "i"))
    own.save(str(tmp_path / "i"))  # an existing one is replaced
    assert own.load(str(tmp_path / "i")).codes.count() == 76


def test_digest_of_keys_equals_exploded_windows(spark, monkeypatch):
    """Keys that come in many rows, go on over batches and chunks, or have no window; no window is shuffled."""
    import random

    from pyspark.sql import functions as F

    from tessera.functions import seeds
    from tessera.operators import index

    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTACGTN") for _ in range(n)) for n in (0, 24, 25, 40, 90, 200, 300)] + ["ACG" * 40, "A" * 60, "N" * 50, "u" * 30]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *texts])) for _ in range(150)] + [(99, t) for t in texts * 4] + [(100, "N" * 60)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(5)
    monkeypatch.setattr(seeds, "TOGETHER", 256)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for mask, canonical in ((seeds.CONTIGUOUS_25, False), (seeds.SPACED_29_33, True), ("#" * 32, True)):
            seed = seeds.Seed(mask)
            each = index.read_seeds(df, "k", "s", seed, canonical=canonical)
            want = each.groupBy("k").agg(F.count("*"), F.count_distinct("seed"), F.min("seed"), F.max("seed"), F.min("pos")).collect()
            own = index.seed_digest(df, "k", "s", seed, canonical)
            text = [seeds.code_text(F.col(c), seed.weight).alias(c) for c in ("least", "most", "first")]
            got = own.select("k", "n", "different", *text).collect()
            assert {tuple(r)[:5] for r in got} == {tuple(r)[:5] for r in want} and len(got) == len(want)
            starts = {(r.k, r.pos, r.seed) for r in each.collect()}
            least = {r[0]: r[5] for r in want}
            assert all((r.k, least[r.k], r.first) in starts for r in got)
            assert "Generate" not in own._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_joined_to_one_sequence(spark):
    """Windows that lie across rows and parts, some rows shorter than a window, are all found; none is made up."""
    from pyspark.sql import functions as F

    from tessera.operators import index

    texts = [random_dna(n, n) for n in (160, 3, 0, 1, 40, 33, 7, 500, 2, 90)] * 4
    rows = [(k, f"{t}") for k, t in enumerate(texts)] + [(200, None)]
    seed, whole = Seed(SPACED_29_33), "".join(texts)
    for parts in (1, 7, 30):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            long = index.joined_stretches(spark.createDataFrame(rows, "k int, s string"), "k", "s", seed.span - 1, stretch=100)
            got = [r.s for r in index.read_seeds(long.select(F.lit(0).alias("k"), "s"), "k", "s", seed).select(F.col("seed").alias("s")).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(got) == sorted(x for _, x in brute_seeds(whole, seed))


def test_sizes_beyond_64_bits(spark, tmp_path):
    from tessera import queries

    spark.createDataFrame([(1, 5), (1_000_000, 5), (1_200_000, 5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r for r in queries.QUERIES["index_sizing"](spark, str(tmp_path)).collect()}
    assert got[1_000_000]["size"] == 7 * 10**18 + 5 and got[1]["size"] == 12
    assert got[1_200_000]["size"] is None and got[1_200_000].human == f"{round(7 * 1_200_000**3 / 2**30)} GB"
    assert got[1_200_000].bases == float(7 * 1_200_000**3 + 5) * 3.5 and got[1_200_000].buckets_log2 == 31


def test_packing_leaves_no_arrays_behind():
    """what is put together for a batch is gone with it, without a search for cycles."""
    import gc
    import tracemalloc

    text = np.frombuffer(random_dna(1 << 16, 3).encode(), np.uint8)
    lut = seeds.base_table("strict")
    gc.collect()
    gc.disable()
    try:
        tracemalloc.start()
        for _ in range(20):
            seeds.codes_of(text, Seed(SPACED_29_33), lut, True)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held < 8 << 20


def test_seeds_are_dealt_before_they_are_gathered(spark):
    """no aggregation of seeds lies between their making and their exchange."""
    df = spark.createDataFrame([(random_dna(200, 1),)], "s string").coalesce(1)
    plan = index.build_index(df, "s", Seed(SPACED_29_33)).codes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(seed" in plan and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning(seed") :]
