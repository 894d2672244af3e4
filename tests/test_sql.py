from tessera.functions import sql
from tessera.functions.seeds import SPACED_29_33, Seed
from tests.test_seeds import brute_covered, brute_seeds, random_dna, rc


def test_functions_in_sql(spark):
    sql.register_sql(spark)
    a, seed = random_dna(90, 4), Seed(SPACED_29_33)
    n = a[:50] + "N" + a[51:]
    spark.createDataFrame([(0, a), (1, n), (2, None), (3, "ACG")], "k int, s string").createOrReplaceTempView("reads_for_sql")
    got = spark.sql(f"SELECT k, t.pos, t.seed FROM reads_for_sql, LATERAL seeds(s, '{SPACED_29_33}') t").collect()
    assert {(r.k, r.pos, r.seed) for r in got} == {(k, i, x) for k, s in ((0, a), (1, n)) for i, x in brute_seeds(s, seed)}
    r = spark.sql("SELECT revcomp(s) AS r, seed_codes(s) AS c, canonical_seed(seed_codes(s)) = canonical_seed(seed_codes(revcomp(s))) AS same FROM reads_for_sql WHERE k = 0").first()
    assert r.r == rc(a) and set(r.c) <= set("0123") and r.same
    known = {x for _, x in brute_seeds(a, seed)}
    r = spark.sql(f"SELECT covered_bases(collect_list(t.pos), '{SPACED_29_33}') AS c FROM reads_for_sql, LATERAL seeds(s, '{SPACED_29_33}') t WHERE k = 1").first()
    assert r.c == brute_covered(n, known, seed)
    assert [tuple(x) for x in spark.sql("SELECT read_matches(50, 100, 500), read_matches(51, 100, 500)").collect()] == [(False, True)]


def test_seed_lists_in_sql(spark):
    """As the table function has them, of whole batches; nulls give no rows."""
    sql.register_sql(spark)
    texts = [random_dna(n, n) for n in (0, 20, 33, 90, 400)] + [None, "acgu" * 20, "N" * 40]
    spark.createDataFrame(list(enumerate(texts)), "k int, s string").createOrReplaceTempView("lists_for_sql")
    for mask in (SPACED_29_33, "#" * 25):
        w = Seed(mask).weight
        got = spark.sql(f"SELECT k, pos, lpad(conv(code, 10, 4), {w}, '0') AS seed FROM lists_for_sql LATERAL VIEW inline(seed_list(s, '{mask}')) t AS pos, code").collect()
        want = spark.sql(f"SELECT k, t.pos, t.seed FROM lists_for_sql, LATERAL seeds(s, '{mask}') t").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 300
