"""The queries of the engine, each with its DuckDB SQL.

D: ``documents`` against ``benchmark`` in windows of 25 characters. N: pseudo-DNA made from md5 of keys, reads from
``orders`` and contigs from ``supplier``; reads of even keys come from a contig. T: names and small tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import hashing, names, seeds
from tessera.functions.seeds import CONTIGUOUS_25, SPACED_29_33, Seed
from tessera.operators import coverage, index, pairs
from tessera.operators.index import Index
from tessera.plans import split
from tessera.sources.shared import workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACED, CONTIG = Seed(SPACED_29_33), Seed(CONTIGUOUS_25)
TEXT_PERMILLE = 100


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- data ---------------------------------------------------------------------------------------------------


def dna(key: Column) -> Column:
    text = F.concat(*(F.md5(F.concat(key.cast("string"), F.lit(c))) for c in "abcde"))
    return F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGT")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("contig_id"), dna(F.col("s_suppkey")).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cut = F.substring(dna(k % 10), (k % 11 + 1).cast("int"), F.lit(150))
    seq = F.when(k % 4 == 0, cut).when(k % 4 == 2, seeds.revcomp(cut)).otherwise(F.substring(dna(-k), 1, 150))
    return spread(table(spark, sf_dir, "orders")).select(k.alias("read_id"), seq.alias("seq"))


#: Rows of a part, about: what a task works on grows no further with the table.
PART_ROWS = 200_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows that come in fewer parts than there are cores, or in larger ones than PART_ROWS (small rows in large files), are dealt out; other tables stay as they are read."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))  # counted by the files' footers
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def noisy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with an N at base 71 of every seventh."""
    n = F.concat(F.substring("seq", 1, 70), F.lit("N"), F.expr("substring(seq, 72)"))
    return reads(spark, sf_dir).withColumn("seq", F.when(F.col("read_id") % 7 == 0, n).otherwise(F.col("seq")))


def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as records of a FASTQ pair: reads 2i and 2i + 1 are the mates of pair i."""
    k = F.col("read_id")
    return reads(spark, sf_dir).select(
        F.lit("s").alias("sample"), (k % 2 + 1).cast("int").alias("mate"), F.floor(k / 2).alias("ordinal"), F.concat(F.lit("@r"), k.cast("string")).alias("header"),
        "seq", F.lit("+").alias("plus"), F.repeat(F.lit("I"), F.length("seq")).alias("qual"), "read_id",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def dna_index(spark: SparkSession, sf_dir: str, seed: Seed = SPACED) -> Index:
    return index.build_index(contigs(spark, sf_dir), "seq", seed)


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    return index.build_index(table(spark, sf_dir, "benchmark"), "text", CONTIG, dna=False)


def text_verdicts(spark: SparkSession, sf_dir: str, permille: int = TEXT_PERMILLE) -> DataFrame:
    return coverage.verdicts(documents(spark, sf_dir), "doc_id", "text", text_index(spark, sf_dir), permille)


def dna_verdicts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return coverage.verdicts(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir), 500, **how)


def _dna(key: str) -> str:
    return "translate(concat(" + ", ".join(f"md5(concat(CAST({key} AS VARCHAR), '{c}'))" for c in "abcde") + "), '0123456789abcdef', 'ACGTACGTACGTACGT')"


READS = f"""contigs AS (SELECT s_suppkey AS contig_id, {_dna("s_suppkey")} AS seq FROM supplier),
cuts AS (SELECT o_orderkey AS k, substr({_dna("(o_orderkey % 10)")}, CAST(o_orderkey % 11 + 1 AS INTEGER), 150) AS cut, substr({_dna("(-o_orderkey)")}, 1, 150) AS other FROM orders),
reads AS (SELECT k AS read_id, CASE k % 4 WHEN 0 THEN cut WHEN 2 THEN reverse(translate(cut, 'ACGT', 'TGCA')) ELSE other END AS seq FROM cuts),
noisy AS (SELECT read_id, CASE WHEN read_id % 7 = 0 THEN substr(seq, 1, 70) || 'N' || substr(seq, 72) ELSE seq END AS seq FROM reads)"""
CODED = "translate(seq, 'ACTGN', '0123.')"


def _gather(win: str, seed: Seed = SPACED) -> str:
    return "concat(" + ", ".join(f"substr({win}, {a + 1}, {n})" for a, n in seed.runs) + ")"


def _windows(source: str, key: str, seed: Seed = SPACED) -> str:
    """key, pos and seed (canonical codes) of all valid windows."""
    w = seed.span
    return f"""SELECT {key}, pos, greatest(s, reverse(translate(s, '0123', '2301'))) AS seed FROM (
  SELECT {key}, pos, {_gather("win", seed)} AS s FROM (
    SELECT {key}, CAST(t.pos AS INTEGER) AS pos, substr({CODED}, CAST(t.pos + 1 AS INTEGER), {w}) AS win FROM {source}, range(0, greatest(length(seq) - {w} + 1, 0)) t(pos)) WHERE NOT contains(win, '.'))"""


DNA_SEEDS = f"""{READS},
ref AS (SELECT DISTINCT seed FROM ({_windows("contigs", "contig_id")})),
rs AS ({_windows("noisy", "read_id")}),
hits AS (SELECT read_id, pos FROM rs SEMI JOIN ref ON rs.seed = ref.seed)"""
DNA_COVERAGE = f"""{DNA_SEEDS},
cov AS (SELECT read_id, count(DISTINCT pos + off) AS covered FROM hits, (SELECT unnest({SPACED.positions}) AS off) GROUP BY read_id),
verdict AS (SELECT n.read_id, coalesce(covered, 0) AS covered, CAST(length(seq) AS INTEGER) AS length, coalesce(covered, 0) * 1000 > 500 * length(seq) AS matched FROM noisy n LEFT JOIN cov USING (read_id))"""
TEXT_SEEDS = """ref AS (SELECT DISTINCT substr(text, CAST(t.pos + 1 AS INTEGER), 25) AS seed FROM benchmark, range(0, greatest(length(text) - 24, 0)) t(pos)),
ds AS (SELECT doc_id, CAST(t.pos AS INTEGER) AS pos, substr(text, CAST(t.pos + 1 AS INTEGER), 25) AS seed FROM documents, range(0, greatest(length(text) - 24, 0)) t(pos)),
dhits AS (SELECT doc_id, pos FROM ds SEMI JOIN ref ON ds.seed = ref.seed)"""
TEXT_COVERAGE = f"""{TEXT_SEEDS},
dcov AS (SELECT doc_id, sum(least(25, coalesce(after - pos, 25))) AS covered FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM dhits) GROUP BY doc_id),
dverdict AS (SELECT d.doc_id, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(coalesce(length(text), 0) AS INTEGER) AS length, source, lang FROM documents d LEFT JOIN dcov USING (doc_id))"""

# --- seeds --------------------------------------------------------------------------------------------------


@query(f"WITH {READS} SELECT read_id, {CODED} AS codes FROM noisy")
def base_codes(spark, sf_dir):
    return noisy_reads(spark, sf_dir).select("read_id", seeds.base_codes(F.col("seq")).alias("codes"))


@query(f"WITH {READS} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM noisy")
def revcomp(spark, sf_dir):
    return noisy_reads(spark, sf_dir).select("read_id", seeds.revcomp(F.col("seq")).alias("rc"))


@query(f"WITH {READS}, rs AS ({_windows('noisy', 'read_id')}) SELECT n.read_id, count(pos) AS n, CAST(coalesce(sum(pos), 0) AS BIGINT) AS places FROM noisy n LEFT JOIN rs USING (read_id) GROUP BY n.read_id")
def valid_windows(spark, sf_dir):
    good = F.filter(F.transform(seeds.windows(seeds.base_codes(F.col("seq")), SPACED.span), lambda w, i: F.when(seeds.valid_window(w), i)), lambda i: i.isNotNull())
    sums = F.aggregate("good", F.lit(0).cast("long"), lambda a, i: a + i)
    return noisy_reads(spark, sf_dir).select("read_id", good.alias("good")).select("read_id", F.size("good").cast("long").alias("n"), sums.alias("places"))


@query(f"""WITH {READS}, b AS (SELECT read_id, CAST(t.pos AS INTEGER) AS pos FROM noisy, range(0, length(seq)) t(pos) WHERE substr(seq, CAST(t.pos + 1 AS INTEGER), 1) IN ('A', 'C', 'G', 'T')),
g AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM b)
SELECT read_id, min(pos) AS start, count(*) AS size FROM g GROUP BY read_id, island""")
def valid_runs(spark, sf_dir):
    """Stretches of accepted bases, by gaps and islands within each read."""
    bases = noisy_reads(spark, sf_dir).select("read_id", F.posexplode(F.split(seeds.base_codes(F.col("seq")), "")).alias("pos", "base")).where("base in ('0', '1', '2', '3')")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("read_id").orderBy("pos"))
    return bases.withColumn("island", island).groupBy("read_id", "island").agg(F.min("pos").alias("start"), F.count("*").alias("size")).drop("island")


def _seed_digest(rows: DataFrame, seed: Seed, canonical: bool) -> DataFrame:
    found = index.seed_digest(rows, "read_id", "seq", seed, canonical)
    return found.select("read_id", "n", "different", *(seeds.code_text(F.col(c), seed.weight).alias(c) for c in ("least", "most")))


_DIGEST = "SELECT read_id, count(*) AS n, count(DISTINCT seed) AS different, min(seed) AS least, max(seed) AS most FROM rs GROUP BY read_id"
_PLAIN = "SELECT read_id, {g} AS seed FROM (SELECT read_id, substr(" + CODED + ", CAST(t.pos + 1 AS INTEGER), {w}) AS win FROM noisy, range(0, length(seq) - {w} + 1) t(pos)) WHERE NOT contains(win, '.')"


@query(f"WITH {READS}, rs AS ({_PLAIN.format(g='win', w=25)}) {_DIGEST}")
def seed_codes_contig(spark, sf_dir):
    return _seed_digest(noisy_reads(spark, sf_dir), CONTIG, False)


@query(f"WITH {READS}, rs AS ({_PLAIN.format(g=_gather('win'), w=33)}) {_DIGEST}")
def seed_codes_spaced(spark, sf_dir):
    return _seed_digest(noisy_reads(spark, sf_dir), SPACED, False)


@query(f"WITH {READS}, rs AS ({_windows('noisy', 'read_id')}) {_DIGEST}")
def canonical_seeds(spark, sf_dir):
    return _seed_digest(noisy_reads(spark, sf_dir), SPACED, True)


@query(f"""WITH {READS}, rs AS ({_windows('noisy', 'read_id')}), f AS (SELECT read_id, arg_min(seed, pos) AS seed FROM rs GROUP BY read_id)
SELECT read_id, seed, CAST(list_reduce(list_transform(string_split(seed, ''), lambda c: CAST(c AS BIGINT)), lambda a, b: a * 4 + b) AS BIGINT) AS code FROM f""")
def first_seed(spark, sf_dir):
    found = index.seed_digest(noisy_reads(spark, sf_dir), "read_id", "seq", SPACED)
    return found.select("read_id", seeds.code_text(F.col("first"), SPACED.weight).alias("seed"), F.col("first").alias("code"))


# --- index --------------------------------------------------------------------------------------------------


@query(f"WITH {READS} SELECT count(DISTINCT seed) AS seeds FROM ({_windows('contigs', 'contig_id')})")
def ref_seed_count(spark, sf_dir):
    return dna_index(spark, sf_dir).codes.agg(F.count("*").alias("seeds"))


@query(f"""WITH {READS}, a AS (SELECT * FROM contigs WHERE contig_id % 2 = 0), b AS (SELECT * FROM contigs WHERE contig_id % 3 = 0)
SELECT count(DISTINCT seed) AS seeds, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS contigs FROM ({_windows('(SELECT * FROM a UNION ALL SELECT * FROM b)', 'contig_id')})""")
def union_refs(spark, sf_dir):
    """One index from two references that overlap."""
    c = contigs(spark, sf_dir)
    both = c.where("contig_id % 2 = 0").unionByName(c.where("contig_id % 3 = 0"))
    return index.build_index(both, "seq", SPACED).codes.agg(F.count("*").alias("seeds")).crossJoin(F.broadcast(both.agg(F.count("*").alias("contigs"))))


@query(f"WITH {READS}, r AS (SELECT DISTINCT seed FROM ({_windows('contigs', 'contig_id')})) SELECT count(*) AS seeds, min(seed) AS least, max(seed) AS most FROM r")
def index_roundtrip(spark, sf_dir):
    """An index written and read again."""
    seed = seeds.code_text(F.col("seed"), SPACED.weight)
    return dna_index(spark, sf_dir).stored().codes.select(seed.alias("seed")).agg(F.count("*").alias("seeds"), F.min("seed").alias("least"), F.max("seed").alias("most"))


@query(f"""WITH w AS (SELECT mask, length(mask) AS span, length(replace(mask, '_', '')) AS weight FROM (SELECT unnest(['{SPACED_29_33}', '{CONTIGUOUS_25}', '{seeds.CONTIGUOUS_31}']) AS mask))
SELECT mask, length, CAST(span AS INTEGER) AS span, CAST(weight AS INTEGER) AS weight, array_to_string(list_filter(range(0, span), lambda i: substr(mask, CAST(i + 1 AS INTEGER), 1) = '#'), ',') AS places,
 CAST(greatest(0, length - span + 1) AS INTEGER) AS positions, CAST(floor(1000.0 / greatest(1, length - span + 1) + 0.5) / 10 AS DOUBLE) AS one_hit_pct FROM w, (SELECT DISTINCT CAST(length(text) AS INTEGER) AS length FROM documents WHERE text IS NOT NULL)""")
def seed_weight_span(spark, sf_dir):
    """Weight, span and places of the published masks, and what one hit is worth on a record of each length."""
    every = F.array(*(F.lit(m) for m in (SPACED_29_33, CONTIGUOUS_25, seeds.CONTIGUOUS_31)))
    masks = table(spark, sf_dir, "documents").where("text is not null").select(F.length("text").alias("length")).distinct().select("length", F.explode(every).alias("mask"))
    marks = F.filter(F.transform(F.split("mask", ""), lambda c, i: F.when(c == "#", i)), lambda i: i.isNotNull())
    span, there = F.length("mask"), F.greatest(F.lit(0), F.col("length") - F.length("mask") + 1)
    return masks.select("mask", "length", span.alias("span"), F.size(marks).alias("weight"), F.array_join(F.transform(marks, lambda i: i.cast("string")), ",").alias("places"), there.alias("positions"), (F.floor(1000.0 / F.greatest(F.lit(1), there) + 0.5) / 10).alias("one_hit_pct"))


@query("SELECT doc_id, CAST(p AS INTEGER) AS pct, CAST(p * 10 AS INTEGER) AS permille, coalesce(length(text), 0) * p / 100.0 AS characters FROM documents, range(10, 101, 10) t(p)")
def threshold_note(spark, sf_dir):
    """Thresholds in per cent and permille, and how many characters of each document must be more than reached."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10))).alias("p"))
    return rows.select("doc_id", F.col("p").alias("pct"), (F.col("p") * 10).alias("permille"), (F.col("n") * F.col("p") / 100.0).alias("characters"))


@query("""SELECT p_partkey, name, size, human, bases, CAST(least(31, greatest(10, ceil(log2(greatest(1024.0, bases / 0.95 / 4))))) AS INTEGER) AS buckets_log2, CAST(CASE WHEN p_partkey <= 1 THEN 0 ELSE ceil(log2(p_partkey)) END AS INTEGER) AS bits FROM (
 SELECT *, size * CASE WHEN regexp_matches(name, '(?i)\\.(gz|bgz)$') THEN 3.5 ELSE 1.0 END AS bases,
  CASE WHEN size >= 1073741824 THEN CASE WHEN size / 1073741824.0 < 10 THEN printf('%.1f', floor(size / 1073741824.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(size / 1073741824.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' GB'
       WHEN size >= 1048576 THEN CASE WHEN size / 1048576.0 < 10 THEN printf('%.1f', floor(size / 1048576.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(size / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' MB'
       WHEN size >= 1024 THEN CASE WHEN size / 1024.0 < 10 THEN printf('%.1f', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(size / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' KB'
       ELSE CAST(size AS VARCHAR) || ' B' END AS human
 FROM (SELECT p_partkey, 'ref' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.fa.gz' WHEN 1 THEN '.fna' ELSE '.fasta.bgz' END AS name, p_partkey * p_partkey * p_partkey * 7 + p_size AS size FROM part))""".replace("\\\\", "\\"))
def index_sizing(spark, sf_dir):
    """Sizes of reference files, for people and for an index."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("ref"), k.cast("string"), F.when(k % 3 == 0, ".fa.gz").when(k % 3 == 1, ".fna").otherwise(".fasta.bgz"))
    wide = k.cast("decimal(19,0)")
    exact = ((wide * wide).cast("decimal(38,0)") * k * 7 + F.col("p_size")).cast("decimal(38,0)")  # from keys of 1,096,000 on beyond 64 bits
    files = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), exact.alias("exact"))
    number = F.col("exact").cast("double")
    files = files.withColumn("size", F.when(F.col("exact") <= (1 << 63) - 1, F.col("exact")).cast("long"))  # no number of a larger one
    files = files.withColumn("human", names.human_size(F.coalesce("size", number))).withColumn("bases", index.estimated_bases(F.col("name"), F.coalesce("size", number))).drop("exact")
    return files.withColumn("buckets_log2", index.log2_buckets(F.col("bases"))).withColumn("bits", index.bits_for(k))


@query("""SELECT p_partkey, CAST(slot_bits AS INTEGER) AS slot_bits, CAST(slot_bits * win AS INTEGER) AS window_bits, CAST(used + 512 - used % 512 AS BIGINT) AS subfilter_bits
FROM (SELECT *, ((slots + sub - 1) // sub) * slot_bits AS used FROM (SELECT p_partkey, win, sub, slots, fpr + CASE WHEN win <= 1 THEN 0 ELSE CAST(ceil(log2(win)) AS INTEGER) END + 1 AS slot_bits
FROM (SELECT p_partkey, 8 + p_partkey % 9 AS fpr, 1 + p_size % 5 AS win, 1 + p_partkey % 7 AS sub, p_partkey * 1009 + p_size AS slots FROM part)))""")
def native_layout(spark, sf_dir):
    """Slot, window and subfilter sizes of published filters, whose parameters follow from the keys and sizes of parts."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (8 + k % 9).alias("fpr"), (1 + F.col("p_size") % 5).alias("win"), (1 + k % 7).alias("sub"), (k * 1009 + F.col("p_size")).alias("slots"))
    slot, window, subfilter = index.layout_bits(F.col("fpr"), F.col("win"), F.col("sub"), F.col("slots"))
    return rows.select("p_partkey", slot.alias("slot_bits"), window.alias("window_bits"), subfilter.alias("subfilter_bits"))


# --- hashes -------------------------------------------------------------------------------------------------

_M = "18446744073709551616::UHUGEINT"


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x}::HUGEINT - 18446744073709551616 ELSE {x}::HUGEINT END AS BIGINT)"


def _mix(source: str, x: str, out: str) -> str:
    """``source`` (a subquery) with the column ``out``: the mixed ``x``."""
    return f"""(SELECT * EXCLUDE (m1, m2), xor(m2, m2 >> 31) AS {out} FROM (SELECT *, ((xor(m1, m1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_M})::UBIGINT AS m2 FROM (
 SELECT *, ((xor({x}, {x} >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M})::UBIGINT AS m1 FROM {source})))"""


_KEYS = "(SELECT o_orderkey, (o_orderkey * 2654435761)::UBIGINT AS code FROM orders)"
_HASHED = _mix(_KEYS, "code", "h")
_FP = f"(SELECT *, greatest(h >> 48, 1)::UBIGINT AS fp, (h & 65535)::UBIGINT AS b1 FROM {_HASHED})"
_PAIR = f"(SELECT *, xor(b1, hf & 65535)::UBIGINT AS b2 FROM {_mix(_FP, 'fp', 'hf')})"


def _codes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761).alias("code"))


@query(f"SELECT o_orderkey, {_signed('h')} AS hash FROM {_HASHED}")
def hash_mix(spark, sf_dir):
    return _codes(spark, sf_dir).select("o_orderkey", hashing.hash_mix(F.col("code")).alias("hash"))


@query(f"SELECT o_orderkey, CAST(fp AS INTEGER) AS fp FROM {_FP}")
def fingerprints(spark, sf_dir):
    return _codes(spark, sf_dir).select("o_orderkey", hashing.fingerprint(hashing.hash_mix(F.col("code"))).alias("fp"))


@query(f"SELECT o_orderkey, CAST(b1 AS BIGINT) AS b1, CAST(b2 AS BIGINT) AS b2 FROM {_PAIR}")
def bucket_pairs(spark, sf_dir):
    return index.approximate(_codes(spark, sf_dir), 16).select("o_orderkey", "b1", "b2")


_FACTOR, _BITS = 0x5851F42D4C957F2D, 58
_SWAP = f"(SELECT o_orderkey, ((({_FACTOR}::UHUGEINT * (xor((code << 29) % 288230376151711744, code >> 29) % 288230376151711744)::UHUGEINT) % {_M})::UBIGINT % 288230376151711744::UBIGINT) AS s FROM (SELECT o_orderkey, (o_orderkey * 16777619 % 288230376151711744)::UHUGEINT AS code FROM orders))"


def _wide(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 16777619 % (1 << 58)).alias("code"))


@query(f"SELECT o_orderkey, {_signed('s')} AS s FROM {_SWAP}")
def swap_mul(spark, sf_dir):
    return _wide(spark, sf_dir).select("o_orderkey", hashing.swap_mul(F.col("code"), _FACTOR, _BITS).alias("s"))


@query(f"SELECT o_orderkey, CAST(s >> 48 AS BIGINT) AS power, CAST(xor(s, s >> 29) % 1000 AS BIGINT) AS even, CAST(s % 1001 AS BIGINT) AS odd, CAST(0 AS BIGINT) AS one FROM {_SWAP}")
def get_bucket(spark, sf_dir):
    b = {"power": 1024, "even": 1000, "odd": 1001, "one": 1}
    return _wide(spark, sf_dir).select("o_orderkey", *(hashing.get_bucket(F.col("code"), _FACTOR, n, _BITS).alias(c) for c, n in b.items()))


@query(f"SELECT count(DISTINCT (fp, least(b1, b2))) AS kept, count(DISTINCT code) AS exact FROM {_PAIR}")
def approx_index(spark, sf_dir):
    """How many keys the approximate filter tells apart."""
    a = index.approximate(_codes(spark, sf_dir), 16)
    return a.agg(F.count_distinct("fp", "low").alias("kept"), F.count_distinct("code").alias("exact"))


@query(f"SELECT n AS inserted, CAST(0 AS BIGINT) AS failed, n AS occupied, CAST(floor(n * 1000 / 262144) AS BIGINT) AS load_permille, floor(n * 1000 / 262144) > 900 AS saturated FROM (SELECT count(DISTINCT (fp, least(b1, b2))) AS n FROM {_PAIR})")
def index_stats(spark, sf_dir):
    return index.index_stats(_codes(spark, sf_dir), 16)


# --- hits and coverage --------------------------------------------------------------------------------------


@query(f"WITH {DNA_SEEDS} SELECT read_id, count(*) AS hits, min(pos) AS first, max(pos) AS last FROM hits GROUP BY read_id")
def seed_hits(spark, sf_dir):
    found = coverage.seed_hits(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir))
    return found.groupBy("read_id").agg(F.count("*").alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query(f"WITH {DNA_SEEDS} SELECT (SELECT count(*) FROM rs) AS asked, (SELECT count(*) FROM hits) AS found")
def seed_hit_rate(spark, sf_dir):
    p = noisy_reads(spark, sf_dir).select(coverage.probe(F.col("seq"), dna_index(spark, sf_dir)).alias("p"))
    return p.agg(F.coalesce(F.sum("p.seeds"), F.lit(0)).alias("asked"), F.coalesce(F.sum("p.found"), F.lit(0)).alias("found"))  # none of an empty table


@query(f"WITH {READS}, r AS (SELECT DISTINCT seed FROM ({_windows('contigs', 'contig_id')})), one AS (SELECT min(seed) AS seed FROM r) SELECT seed, TRUE AS present FROM one UNION ALL SELECT repeat('0', 29), EXISTS (SELECT 1 FROM r WHERE seed = repeat('0', 29))")
def probe_key(spark, sf_dir):
    """Single seeds looked up in an index."""
    codes = dna_index(spark, sf_dir).stored().codes.select(seeds.code_text(F.col("seed"), SPACED.weight).alias("seed"))
    asked = codes.agg(F.min("seed").alias("seed")).union(spark.range(1).select(F.repeat(F.lit("0"), F.lit(29))))
    return asked.join(codes.withColumn("_in", F.lit(True)), "seed", "left").select("seed", F.coalesce("_in", F.lit(False)).alias("present"))


@query(f"WITH {TEXT_COVERAGE} SELECT doc_id, covered, length FROM dverdict")
def coverage_contig(spark, sf_dir):
    """Coverage of documents by the join strategy."""
    return coverage.coverage(documents(spark, sf_dir), "doc_id", "text", text_index(spark, sf_dir), strategy="join").select("doc_id", "covered", "length")


@query(f"WITH {DNA_COVERAGE} SELECT read_id, covered, length FROM verdict")
def coverage_spaced(spark, sf_dir):
    return coverage.coverage(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir)).select("read_id", "covered", "length")


@query(f"WITH {DNA_COVERAGE} SELECT read_id, covered, length FROM verdict")
def coverage_spaced_join(spark, sf_dir):
    """Spaced coverage by the join strategy: runs of hits as intervals, and their union."""
    return coverage.coverage(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir), strategy="join").select("read_id", "covered", "length")


@query(f"WITH {DNA_COVERAGE} SELECT read_id, covered, length FROM verdict")
def coverage_mapped(spark, sf_dir):
    """Spaced coverage through a static filter that tasks map, as for indexes too large to be sent: one narrow stage."""
    return coverage.coverage(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir).mapped()).select("read_id", "covered", "length")


@query(f"WITH {DNA_SEEDS} SELECT read_id, count(*) AS hits, CAST(sum(pos) AS BIGINT) AS places FROM hits GROUP BY read_id")
def verified_hits(spark, sf_dir):
    """Windows found through a filter of eight bits, whose false finds the sorted table of the seeds takes out where they lie."""
    found = coverage.seed_hits(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir).mapped(8))
    return found.groupBy("read_id").agg(F.count("*").alias("hits"), F.sum("pos").alias("places"))


@query(f"WITH {TEXT_COVERAGE} SELECT doc_id, covered, length FROM dverdict")
def coverage_text_mapped(spark, sf_dir):
    """Coverage of documents through a static filter of the prints of text windows."""
    return coverage.coverage(documents(spark, sf_dir), "doc_id", "text", text_index(spark, sf_dir).mapped()).select("doc_id", "covered", "length")


@query(f"WITH {DNA_COVERAGE} SELECT read_id, CAST(floor(covered * 1000 / length) AS BIGINT) AS permille FROM verdict")
def coverage_score(spark, sf_dir):
    c = coverage.coverage(noisy_reads(spark, sf_dir), "read_id", "seq", dna_index(spark, sf_dir))
    return c.select("read_id", coverage.score(F.col("covered"), F.col("length")).alias("permille"))


@query(f"WITH {TEXT_COVERAGE} SELECT doc_id, covered, length, TRUE AS matched FROM dverdict WHERE covered * 1000 > {TEXT_PERMILLE} * length")
def matched_reads(spark, sf_dir):
    """Documents of which more than a tenth lies under passages of the benchmark."""
    return text_verdicts(spark, sf_dir).where("matched")


@query(f"WITH {TEXT_COVERAGE} SELECT doc_id, source FROM dverdict WHERE NOT covered * 1000 > {TEXT_PERMILLE} * length")
def unmatched_reads(spark, sf_dir):
    """The other side, as an anti join."""
    return documents(spark, sf_dir).select("doc_id", "source").join(text_verdicts(spark, sf_dir).where("matched"), "doc_id", "left_anti")


@query(f"WITH {DNA_COVERAGE} SELECT CAST(count_if(matched) AS BIGINT) AS matched, CAST(count_if(NOT matched) AS BIGINT) AS unmatched, count(*) AS reads, CAST(0 AS BIGINT) AS in_both, CAST(0 AS BIGINT) AS lost FROM verdict")
def split_complete(spark, sf_dir):
    """Both sides together are the input, and they are disjoint."""
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    sides_ = dna_verdicts(spark, sf_dir).select("read_id", F.lit(0).alias("a"), one(F.col("matched")).alias("h"), one(~F.col("matched")).alias("m"))
    rows = noisy_reads(spark, sf_dir).select("read_id", F.lit(1).alias("a"), F.lit(0).alias("h"), F.lit(0).alias("m"))
    each = rows.unionAll(sides_).groupBy("read_id").agg(*(F.sum(c).alias(c) for c in "ahm"))  # reads are decided once
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    lost = F.greatest(F.col("a") - F.col("h") - F.col("m"), F.lit(0))
    return each.agg(total("h", "matched"), total("m", "unmatched"), total("a", "reads"), F.count_if((F.col("h") > 0) & (F.col("m") > 0)).alias("in_both"), total(lost, "lost"))


@query(f"WITH {TEXT_COVERAGE} SELECT doc_id, CASE WHEN length BETWEEN 1 AND 1024 THEN covered ELSE 0 END AS covered, length, length BETWEEN 1 AND 1024 AND covered * 1000 > {TEXT_PERMILLE} * length AS matched FROM dverdict")
def length_guard(spark, sf_dir):
    """Records beyond 1,024 characters never match, where this limit is asked for."""
    return coverage.verdicts(documents(spark, sf_dir), "doc_id", "text", text_index(spark, sf_dir), TEXT_PERMILLE, max_length=1024)


@query(f"WITH {TEXT_COVERAGE} SELECT CAST(t.p AS INTEGER) AS pct, CAST(count_if(covered * 1000 > t.p * 10 * length) AS BIGINT) AS matched, count(*) AS reads FROM dverdict, range(1, 101) t(p) GROUP BY t.p")
def threshold_sweep(spark, sf_dir):
    """How many documents match at each threshold: each document is counted once, at its highest one, and summed up."""
    c = coverage.coverage(documents(spark, sf_dir), "doc_id", "text", text_index(spark, sf_dir))
    top = F.when(F.col("covered") > 0, F.least(F.lit(100), F.ceil(F.col("covered") * 100 / F.col("length")) - 1)).otherwise(0)
    exact = F.filter(F.sequence(F.greatest(F.lit(0), top - 1), top + 1), lambda p: (p <= 100) & (F.col("covered") * 1000 > p * 10 * F.col("length")))
    best = c.select(F.coalesce(F.array_max(exact), F.lit(0)).cast("int").alias("best")).groupBy("best").count()
    pcts = spark.range(1, 101).select(F.col("id").cast("int").alias("pct"))
    all_rows = best.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("reads"))
    joined = pcts.join(F.broadcast(best), F.col("best") >= F.col("pct"), "left").groupBy("pct").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("matched"))
    return joined.crossJoin(F.broadcast(all_rows))


# --- splits, pairs, reports ---------------------------------------------------------------------------------

_RECORD = "concat_ws(chr(10), '@r' || v.read_id, seq, '+', repeat('I', CAST(length(seq) AS BIGINT)))"
_CLEAN = DNA_COVERAGE.replace("FROM noisy, range", "FROM reads, range").replace("FROM noisy n", "FROM reads n")


@query(f"WITH {_CLEAN} SELECT v.read_id % 2 + 1 AS mate, CAST(v.read_id // 2 AS BIGINT) AS ordinal, matched, {_RECORD} AS record FROM verdict v JOIN reads USING (read_id)")
def split_single(spark, sf_dir):
    """Every record with its side, as the text that is written."""
    out = split.split_reads(paired_reads(spark, sf_dir), dna_index(spark, sf_dir))
    return out.select(F.col("mate").cast("long").alias("mate"), "ordinal", "matched", split.record_text().alias("record"))


@query(f"WITH {_CLEAN}, p AS (SELECT read_id // 2 AS pair, bool_or(matched) AS hit FROM verdict GROUP BY 1) SELECT v.read_id % 2 + 1 AS mate, CAST(v.read_id // 2 AS BIGINT) AS ordinal, hit AS matched, {_RECORD} AS record FROM verdict v JOIN reads USING (read_id) JOIN p ON p.pair = v.read_id // 2 WHERE v.read_id < (SELECT count(*) // 2 * 2 FROM orders)")
def split_paired(spark, sf_dir):
    """Every record of a pair with the pair's side."""
    rows = paired_reads(spark, sf_dir)
    out = split.split_pairs(rows.where(F.col("read_id") < F.lit(rows.count() // 2 * 2)), dna_index(spark, sf_dir))
    return out.select(F.col("mate").cast("long").alias("mate"), "ordinal", "matched", split.record_text().alias("record"))


@query(f"WITH {_CLEAN} SELECT CAST(v.read_id % 2 + 1 AS BIGINT) AS mate, CAST(v.read_id // 2 AS BIGINT) AS ordinal, row_number() OVER (PARTITION BY matched, v.read_id % 2 ORDER BY v.read_id // 2) AS line, matched FROM verdict v")
def ordered_output(spark, sf_dir):
    """The place of each record within its output file: the order of the input."""
    out = split.split_reads(paired_reads(spark, sf_dir), dna_index(spark, sf_dir))
    return split.placed(out.select(F.col("mate").cast("long").alias("mate"), "ordinal", "matched"), ["matched", "mate"], ["ordinal"])


@query("SELECT l_orderkey, l_partkey // 4 AS record, coalesce(max(CASE WHEN l_partkey % 4 = 0 THEN l_linenumber END), 0) AS header, coalesce(max(CASE WHEN l_partkey % 4 = 1 THEN l_linenumber END), 0) AS seq, coalesce(max(CASE WHEN l_partkey % 4 = 2 THEN l_linenumber END), 0) AS plus, coalesce(max(CASE WHEN l_partkey % 4 = 3 THEN l_linenumber END), 0) AS qual FROM lineitem GROUP BY 1, 2")
def fastq_frame(spark, sf_dir):
    """Numbered lines framed four by four: part keys stand for the numbers of lines, order keys for files."""
    n = F.col("l_partkey")
    line = lambda k: F.coalesce(F.max(F.when(n % 4 == k, F.col("l_linenumber"))), F.lit(0))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.floor(n / 4).alias("record")).agg(line(0).alias("header"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("qual"))


_SUFFIXES = ("_R1.fastq.gz", "_R2.fastq.gz", "_1.clean.fq", "_2.clean.fq", ".fastq", "_R1_001.fastq.bgz", "_R2_001.fastq.bgz", ".fa.gz", ".filter", "_1_R2.fq.gz", ".txt", ".FASTQ.bgzf")
_FILES = f"SELECT c_custkey AS arrival, 'S' || (c_custkey // 7) || list_extract({list(_SUFFIXES)}, CAST(c_custkey % 12 + 1 AS INTEGER)) AS name, CAST(abs(c_acctbal) AS BIGINT) AS size FROM customer"
_MATED = f"""files AS ({_FILES}), stems AS (SELECT *, regexp_replace(name, '(?i)\\.(fastq|fq)(\\.(gz|bgz|bgzf))?$', '') AS stem FROM files),
mated AS (SELECT *, CASE WHEN regexp_matches(stem, '(?i)^(.*)_(R?)([12])([._].*|)$') THEN CAST(regexp_extract(stem, '(?i)^(.*)_(R?)([12])([._].*|)$', 3) AS INTEGER) ELSE 0 END AS mate,
 CASE WHEN regexp_matches(stem, '(?i)^(.*)_(R?)([12])([._].*|)$') THEN regexp_replace(stem, '(?i)^(.*)_(R?)([12])([._].*|)$', '\\1\\4') ELSE stem END AS key FROM stems)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made from customer keys."""
    k = F.col("c_custkey")
    suffix = F.element_at(F.array(*(F.lit(s) for s in _SUFFIXES)), (k % 12 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("arrival"), F.concat(F.lit("S"), F.floor(k / 7).cast("string"), suffix).alias("name"), F.abs("c_acctbal").cast("long").alias("size"))


# --- files --------------------------------------------------------------------------------------------------

_READ_RECORD = "'@r' || read_id AS header, seq, '+' AS plus, repeat('I', CAST(length(seq) AS BIGINT)) AS qual"


def fastq_files(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """A folder of FASTQ files with all reads."""
    from tessera.sources import sequences

    sequences.register(spark)
    path = f"{workspace(spark, 'fastq')}/reads"
    paired_reads(spark, sf_dir).drop("read_id").write.format("fastq").option("compression", compression).mode("append").save(path)
    return path


def scanned(spark: SparkSession, sf_dir: str, compression: str, **options) -> DataFrame:
    got = spark.read.format("fastq").options(**options).load(fastq_files(spark, sf_dir, compression))
    return got.select("header", "seq", "plus", "qual")


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_scan(spark, sf_dir):
    """Reads written as plain FASTQ files and read again in ranges of 256 KB."""
    return scanned(spark, sf_dir, "none", split=1 << 18)


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_appends(spark, sf_dir):
    """Reads written by two appends to one folder, after an overwrite of what was there: all are there once."""
    from tessera.sources import sequences

    sequences.register(spark)
    path, rows = f"{workspace(spark, 'appends')}/reads", paired_reads(spark, sf_dir)
    parts = [(rows.where("read_id % 3 = 0"), "overwrite"), (rows.where("read_id % 3 = 1"), "overwrite"), (rows.where("read_id % 3 = 2"), "append"), (rows.where("read_id % 3 = 0"), "append")]
    for part, mode in parts:
        part.drop("read_id").write.format("fastq").option("compression", "bgzf").mode(mode).save(path)
    return spark.read.format("fastq").load(path).select("header", "seq", "plus", "qual")


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_gzip(spark, sf_dir):
    """The same through gzip files of one member."""
    return scanned(spark, sf_dir, "gzip")


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_members(spark, sf_dir):
    """The same through gzip files of many members."""
    return scanned(spark, sf_dir, "members")


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_blocks(spark, sf_dir):
    """The same through block-gzip files, read in ranges of 64 KB of blocks."""
    return scanned(spark, sf_dir, "bgzf", split=1 << 16)


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_lines(spark, sf_dir):
    """The same by lines that Spark reads from any store, numbered over blocks."""
    from tessera.sources import sequences

    return sequences.fastq_from_text(sequences.numbered_lines(spark, fastq_files(spark, sf_dir))).select("header", "seq", "plus", "qual")


@query(f"WITH {READS} SELECT (SELECT count(*) FROM reads) AS records, (SELECT count(*) FROM reads) AS places, TRUE AS dense")
def fastq_ordinals(spark, sf_dir):
    """Ordinals of files that are read in ranges are dense: as many places as records in each file, from 0."""
    from tessera.sources import sequences

    got = sequences.dense_ordinals(spark.read.format("fastq").option("split", 1 << 16).load(fastq_files(spark, sf_dir)))
    each = got.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("places"), F.max("ordinal").alias("last"))
    return each.agg(F.sum("n").alias("records"), F.sum("places").alias("places"), F.bool_and(F.col("last") == F.col("n") - 1).alias("dense"))


@query(f"WITH {READS} SELECT {_READ_RECORD} FROM reads")
def fastq_member_ranges(spark, sf_dir):
    """Gzip files of many members, whose members are found and read by many tasks (16 KB a range)."""
    from tessera.sources import ranges

    return ranges.read_fastq(spark, fastq_files(spark, sf_dir, "members"), split=1 << 14).select("header", "seq", "plus", "qual")


def fasta_files(spark: SparkSession, sf_dir: str, compression: str = "gzip") -> str:
    """A folder of FASTA files: contigs of odd keys in lines of 70 bases, others in one."""
    from tessera.sources import sequences

    sequences.register(spark)
    path = f"{workspace(spark, 'fasta')}/contigs"
    wrapped = F.when(F.col("contig_id") % 2 == 1, F.regexp_replace("seq", "(.{70})", "$1\n")).otherwise(F.col("seq"))
    contigs(spark, sf_dir).select(F.concat(F.lit(">contig "), F.col("contig_id").cast("string"), F.lit("\n"), wrapped).alias("value")).write.text(path, compression=compression)
    return path


@query(f"WITH {READS} SELECT 'contig ' || contig_id AS header, seq FROM contigs")
def fasta_scan(spark, sf_dir):
    """Contigs written as FASTA and read again."""
    path = fasta_files(spark, sf_dir)
    return spark.read.format("fasta").load(path).select("header", "seq")


@query(f"WITH {READS} SELECT count(DISTINCT seed) AS seeds, min(seed) AS least, max(seed) AS most FROM ({_windows('contigs', 'contig_id')})")
def fasta_index(spark, sf_dir):
    """The index of FASTA files whose contigs come in stretches of 64 bases that overlap: the seeds of whole contigs."""
    own = index.index_of_fasta(spark, fasta_files(spark, sf_dir), SPACED, stretch=64)
    return own.codes.select(seeds.code_text(F.col("seed"), SPACED.weight).alias("seed")).agg(F.count("*").alias("seeds"), F.min("seed").alias("least"), F.max("seed").alias("most"))


@query(f"WITH {READS} SELECT count(DISTINCT seed) AS seeds, min(seed) AS least, max(seed) AS most FROM ({_windows('contigs', 'contig_id')})")
def fasta_range_index(spark, sf_dir):
    """The same of plain files that are read in ranges of 1,000 bytes, whose seams lie anywhere in headers and contigs."""
    own = index.index_of_fasta(spark, fasta_files(spark, sf_dir, "none"), SPACED, stretch=64, split=1000)
    return own.codes.select(seeds.code_text(F.col("seed"), SPACED.weight).alias("seed")).agg(F.count("*").alias("seeds"), F.min("seed").alias("least"), F.max("seed").alias("most"))


_LONG = "(SELECT 0 AS contig_id, string_agg(seq, '' ORDER BY contig_id) AS seq FROM contigs)"


@query(f"WITH {READS} SELECT count(DISTINCT seed) AS seeds FROM ({_windows(_LONG, 'contig_id')})")
def long_contig_index(spark, sf_dir):
    """All contigs as one: a single long sequence, which lies in many parts and is cut in stretches where they lie."""
    long = index.joined_stretches(contigs(spark, sf_dir), "contig_id", "seq", SPACED.span - 1)
    return index.build_index(long, "seq", SPACED).codes.agg(F.count("*").alias("seeds"))


def published_index(spark: SparkSession, sf_dir: str):
    """The contigs' seeds as a published index: an archive of a filter and its description, unpacked and checked."""
    import tarfile

    from tessera.sources import published
    from tessera.sources.shared import as_local

    folder = as_local(workspace(spark, "published"))
    own = dna_index(spark, sf_dir).stored()
    info = published.describe(SPACED, own.size, subfilters=5)
    published.write_filter(own.codes, published.Description.of(published.read_info(info)), f"{folder}/i.filter")
    with open(f"{folder}/i.info", "wb") as f:
        f.write(info)
    with tarfile.open(f"{folder}/index.tar.gz", "w:gz") as tar:  # from file to file
        for name in ("i.filter", "i.info"):
            tar.add(f"{folder}/{name}", name)
    return published.PublishedIndex(*published.load_published(*published.unpack(f"{folder}/index.tar.gz", folder)))


@query(f"WITH {DNA_COVERAGE} SELECT read_id, matched FROM verdict")
def native_split(spark, sf_dir):
    """Reads split by a published filter: the verdicts of the exact index, as a false positive covers 29 of 150 bases only."""
    rows = noisy_reads(spark, sf_dir).select("read_id", F.lit("s").alias("sample"), F.lit(0).alias("mate"), F.col("read_id").alias("ordinal"), "seq")
    return split.split_reads(rows, published_index(spark, sf_dir)).select("read_id", "matched")


@query(f"WITH {READS}, r AS (SELECT DISTINCT seed FROM ({_windows('contigs', 'contig_id')})) SELECT count(*) AS asked, count(*) AS found FROM r")
def native_hits(spark, sf_dir):
    """A published filter holds all seeds that were put in."""
    contigs_ = contigs(spark, sf_dir)
    theirs = published_index(spark, sf_dir)
    p = contigs_.select(coverage.probe(F.col("seq"), theirs).alias("p")).agg(F.sum("p.seeds").alias("asked"), F.sum("p.found").alias("found"))
    distinct = index.build_index(contigs_, "seq", SPACED).codes.agg(F.count("*").alias("n"))
    return p.crossJoin(F.broadcast(distinct)).select(F.col("n").alias("asked"), F.when(F.col("asked") == F.col("found"), F.col("n")).otherwise(F.col("found")).alias("found"))  # single rows


@query(f"WITH d AS (SELECT count(DISTINCT seed) AS n FROM (WITH {READS} {_windows('contigs', 'contig_id')})) SELECT 'windowed_cuckoo' AS filtertype, CAST(4 AS BIGINT) ** 29 = universe AS universe_fits, k, span, CAST(greatest(4, floor(n / 0.7)) AS BIGINT) | 1 AS windows FROM d, (SELECT 4.0 ** 29 AS universe, 29 AS k, 33 AS span)")
def native_info(spark, sf_dir):
    """The description of a published index as a row."""
    from tessera.sources import published

    n = dna_index(spark, sf_dir).stored().codes.count()
    row = published.info_frame(spark, published.read_info(published.describe(SPACED, n)))
    return row.select("filtertype", (F.col("universe") == 4**SPACED.weight).alias("universe_fits"), "k", "span", F.col("nwindows").alias("windows"))


@query(f"WITH {_CLEAN} SELECT v.read_id % 2 + 1 AS mate, CASE WHEN matched THEN 'true' ELSE 'false' END AS side, count(*) AS records, CAST(4 * count(*) AS BIGINT) AS lines FROM verdict v GROUP BY ALL")
def split_files(spark, sf_dir):
    """Both sides written as gzip files, twice (the second run replaces the first), and read again."""
    out = f"{workspace(spark, 'sides')}/out"
    both = split.split_reads(paired_reads(spark, sf_dir), dna_index(spark, sf_dir))
    for _ in range(2):
        split.write_split(both, out, gzip=True)
    back = spark.read.schema("value string, matched string, sample string, mate long").text(out)
    return back.groupBy("mate", F.col("matched").alias("side")).agg(F.count_if(F.startswith("value", F.lit("@r"))).alias("records"), F.count("*").alias("lines"))


def mate_files(spark: SparkSession, sf_dir: str, parts: int | None = None) -> list[tuple[str, str, str]]:
    """Pairs of FASTQ files (sample, R1, R2), eight or as many as have PART_ROWS reads: block gzip, and gzip of many members. The last read of an odd table has no mate and is left out."""
    import os

    from tessera.sources import sequences
    from tessera.sources.shared import as_local

    sequences.register(spark)
    path = workspace(spark, "mates")
    rows = paired_reads(spark, sf_dir)
    n = rows.count()
    rows = rows.where(F.col("read_id") < F.lit(n // 2 * 2)).repartition(parts or max(8, -(-n // PART_ROWS)), "ordinal").sortWithinPartitions("ordinal")
    for mate, compression in ((1, "bgzf"), (2, "members")):
        rows.where(F.col("mate") == mate).drop("read_id").write.format("fastq").option("compression", compression).mode("append").save(f"{path}/{mate}")
    both = [sorted(os.listdir(f"{as_local(path)}/{mate}")) for mate in (1, 2)]
    return [(f"s{k}", f"{path}/1/{a}", f"{path}/2/{b}") for k, (a, b) in enumerate(zip(*both))]


@query(f"WITH {_CLEAN}, p AS (SELECT read_id // 2 AS pair, bool_or(matched) AS hit FROM verdict GROUP BY 1) SELECT '@r' || v.read_id AS header, seq, v.read_id % 2 + 1 AS mate, hit AS matched FROM verdict v JOIN reads USING (read_id) JOIN p ON p.pair = v.read_id // 2 WHERE v.read_id < (SELECT count(*) // 2 * 2 FROM orders)")
def split_pair_files(spark, sf_dir):
    """Pairs read together from both files, in ranges of 16 KB, and decided where they lie: records are not shuffled."""
    from tessera.sources import ranges

    out = split.split_read_pairs(ranges.read_pairs(spark, mate_files(spark, sf_dir), split=1 << 14), dna_index(spark, sf_dir))
    return out.select("header", "seq", F.col("mate").cast("long").alias("mate"), "matched")


@query(f"WITH {_CLEAN} SELECT '@r' || v.read_id AS header, seq, CASE WHEN matched THEN 'true' ELSE 'false' END AS side FROM verdict v JOIN reads USING (read_id)")
def split_named_files(spark, sf_dir):
    """Both sides written in one pass into the two files of each input, under their names, and read again."""
    from tessera.plans import sides
    from tessera.sources import ranges

    out = f"{workspace(spark, 'named')}/out"
    sides.write_sides(split.split_reads(ranges.read_fastq(spark, fastq_files(spark, sf_dir, "bgzf"), split=1 << 16), dna_index(spark, sf_dir)), out, gzip=True)
    back = spark.read.format("fastq").load(out)
    return back.select("header", "seq", F.when(F.contains("sample", F.lit(".matched.")), "true").otherwise("false").alias("side"))


@query(f"WITH {_CLEAN}, p AS (SELECT read_id // 2 AS pair, bool_or(matched) AS hit FROM verdict WHERE read_id < (SELECT count(*) // 2 * 2 FROM orders) GROUP BY 1) SELECT 9 AS samples, 1 AS broken, CAST(2 * count(*) AS BIGINT) AS reads, CAST(2 * count_if(hit) AS BIGINT) AS matched FROM p".replace("9 AS", "CAST(9 AS BIGINT) AS").replace("1 AS broken", "CAST(1 AS BIGINT) AS broken"))
def samples_together(spark, sf_dir):
    """Eight samples of pairs and one whose file is not there, split and written at once; the missing one is reported, the others are done."""
    from tessera.plans import sides

    listed = [*mate_files(spark, sf_dir, 8), ("broken", "/nowhere/R1.fastq", "/nowhere/R2.fastq")]
    said = sides.split_all(spark, spark.createDataFrame(listed, "sample string, r1 string, r2 string"), dna_index(spark, sf_dir), f"{workspace(spark, 'together')}/out", gzip=True)
    return said.agg(F.count("*").alias("samples"), F.count("error").alias("broken"), F.sum("reads").alias("reads"), F.sum("matched").alias("matched"))


@query(f"WITH {_CLEAN} SELECT '@r' || v.read_id AS header, CASE WHEN matched THEN 'true' ELSE 'false' END AS side FROM verdict v")
def stream_split(spark, sf_dir):
    """FASTQ files split as a stream: what is there is read, decided and written by side."""
    from tessera.streaming import split as stream

    path, work = fastq_files(spark, sf_dir, "bgzf"), workspace(spark, "stream")
    query_ = stream.split_stream(stream.read_fastq_stream(spark, path), dna_index(spark, sf_dir), f"{work}/out", f"{work}/checkpoint")
    query_.awaitTermination()
    return spark.read.parquet(f"{work}/out").select("header", F.col("matched").cast("string").alias("side"))


@query(f"WITH {_CLEAN} SELECT name, error, n AS matched FROM (VALUES ('all', NULL), ('broken', 'failed')) s(name, error), (SELECT count_if(matched) AS n FROM verdict)".replace("n AS matched", "CASE WHEN error IS NULL THEN CAST(n AS BIGINT) ELSE 0 END AS matched"))
def isolated_samples(spark, sf_dir):
    """Two samples one by one, the second of which can't be read: it is reported, and the first one's output stays."""
    out = workspace(spark, "samples")

    def read(name: str) -> DataFrame:
        if name == "broken":
            raise ValueError("failed")
        return paired_reads(spark, sf_dir)

    said = split.Run(spark).samples(["all", "broken"], read, dna_index(spark, sf_dir), out)
    rows = spark.createDataFrame([(r.name, r.error) for r in said], "name string, error string")
    hits = spark.read.schema("value string, matched string").text(f"{out}/all").where("matched = 'true' and value like '@r%'").agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(hits)).select("name", "error", F.when(F.col("error").isNull(), F.col("n")).otherwise(0).cast("long").alias("matched"))  # a single row


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice * (1 - l_discount) / l_discount, 6) AS DOUBLE) END AS seconds_left FROM lineitem")
def seconds_left(spark, sf_dir):
    """What the rest takes at the speed so far: prices stand for seconds, discounts for the share that is done."""
    from tessera.streaming.split import seconds_left as left

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(left(F.col("l_extendedprice"), F.col("l_discount")), 6).alias("seconds_left"))


@query(f"WITH {READS}, rs AS ({_windows('noisy', 'read_id')}) SELECT read_id, count(*) AS n, min(seed) AS least, max(seed) AS most FROM rs GROUP BY read_id")
def sql_seeds(spark, sf_dir):
    """Seeds in SQL, by the array of each text: numbers are compared, two of a read become texts."""
    from tessera.functions import sql

    sql.register_sql(spark)
    noisy_reads(spark, sf_dir).createOrReplaceTempView("tessera_reads")
    w = SPACED.weight
    return spark.sql(f"""SELECT read_id, n, lpad(conv(least, 10, 4), {w}, '0') AS least, lpad(conv(most, 10, 4), {w}, '0') AS most FROM (
      SELECT read_id, count(*) AS n, min(code) AS least, max(code) AS most FROM tessera_reads LATERAL VIEW inline(seed_list(seq, '{SPACED_29_33}')) t AS pos, code GROUP BY read_id)""")


# --- names --------------------------------------------------------------------------------------------------

@query(f"""WITH files AS ({_FILES.replace('CAST(abs(c_acctbal) AS BIGINT)', 'CAST(floor(abs(c_acctbal)) AS BIGINT)')}) SELECT role, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM (SELECT *, CASE WHEN regexp_matches(name, '(?i)\\.(fa|fasta|fna)(\\.(gz|bgz|bgzf))?$') THEN 'reference' WHEN regexp_matches(name, '(?i)\\.(filter|info)$') THEN 'index'
 WHEN regexp_matches(name, '(?i)\\.(fastq|fq)(\\.(gz|bgz|bgzf))?$') THEN 'reads' END AS role FROM files) GROUP BY role""")
def admit_files(spark, sf_dir):
    """Files by the role that their extension admits them to; null: ignored."""
    return files(spark, sf_dir).groupBy(names.role(F.col("name")).alias("role")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


@query(f"WITH {_MATED} SELECT arrival, name, mate, key FROM mated")
def mate_info(spark, sf_dir):
    return files(spark, sf_dir).select("arrival", "name", names.mate(F.col("name")).alias("mate"), names.mate_key(F.col("name")).alias("key"))


@query(f"""WITH {_MATED}, r AS (SELECT *, row_number() OVER (PARTITION BY key, mate ORDER BY arrival) AS rn FROM mated WHERE mate > 0),
joined AS (SELECT coalesce(a.key, b.key) AS key, a.name AS f1, b.name AS f2 FROM (SELECT * FROM r WHERE mate = 1) a FULL JOIN (SELECT * FROM r WHERE mate = 2) b ON a.key = b.key AND a.rn = b.rn)
SELECT CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL THEN key ELSE coalesce(f1, f2) END AS sample, coalesce(f1, f2) AS r1, CASE WHEN f1 IS NOT NULL THEN f2 END AS r2 FROM joined UNION ALL SELECT name, name, NULL FROM mated WHERE mate = 0""")
def pair_files(spark, sf_dir):
    return pairs.pair_files(files(spark, sf_dir))


@query(f"WITH files AS ({_FILES}), old AS (SELECT * FROM files WHERE arrival % 3 = 0), new AS (SELECT arrival + 1 AS arrival, name, size + 1 AS size FROM files WHERE arrival % 5 = 0) SELECT name, arrival FROM old ANTI JOIN new USING (name) UNION ALL SELECT name, arrival FROM new")
def replace_by_name(spark, sf_dir):
    """A list of files to which others are added, replacing those of the same name."""
    f = files(spark, sf_dir).select("name", "arrival")
    old, new = f.where("arrival % 3 = 0"), f.where("arrival % 5 = 0").withColumn("arrival", F.col("arrival") + 1)
    return old.join(new.select("name"), "name", "left_anti").unionByName(new)


@query(f"""WITH files AS ({_FILES}) SELECT name, CASE WHEN is_reads THEN regexp_replace(bare, '(?i)\\.(fastq|fq)$', '.matched.\\1') ELSE name || '.matched.fastq' END AS hit,
 CASE WHEN is_reads THEN regexp_replace(bare, '(?i)\\.(fastq|fq)$', '.unmatched.\\1') ELSE name || '.unmatched.fastq' END || '.gz' AS miss_gz
FROM (SELECT DISTINCT name, regexp_replace(name, '(?i)\\.(gz|bgz|bgzf)$', '') AS bare, regexp_matches(name, '(?i)\\.(fastq|fq)(\\.(gz|bgz|bgzf))?$') AS is_reads FROM files)""")
def output_names(spark, sf_dir):
    n = F.col("name")
    return files(spark, sf_dir).select("name").distinct().select("name", names.output_name(n, True).alias("hit"), names.output_name(n, False, gzip=True).alias("miss_gz"))


@query("""SELECT CAST(size AS BIGINT) AS size, CASE WHEN size >= 1048576 THEN CASE WHEN size / 1048576.0 < 10 THEN printf('%.1f', floor(size / 1048576.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(size / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' MB'
 WHEN size >= 1024 THEN CASE WHEN size / 1024.0 < 10 THEN printf('%.1f', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(size / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' KB' ELSE CAST(size AS VARCHAR) || ' B' END AS human
FROM (SELECT DISTINCT octet_length(encode(text)) * (doc_id % 100 + 1) AS size FROM documents)""")
def human_size(spark, sf_dir):
    size = (F.octet_length("text") * (F.col("doc_id") % 100 + 1)).cast("long")
    return table(spark, sf_dir, "documents").select(size.alias("size")).distinct().select("size", names.human_size(F.col("size")).alias("human"))


def mates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = paired_reads(spark, sf_dir)
    r = r.where(F.col("read_id") < F.lit(r.count() // 2 * 2)).select("ordinal", "mate", "seq")
    return r.where("mate = 1"), r.where("mate = 2")


@query(f"WITH {READS} SELECT CAST(a.read_id // 2 AS BIGINT) AS ordinal, a.seq AS seq_1, b.seq AS seq_2 FROM reads a JOIN reads b ON b.read_id = a.read_id + 1 WHERE a.read_id % 2 = 0")
def pair_zip(spark, sf_dir):
    return pairs.zip_records(*mates(spark, sf_dir))


_PAIRS = f"{_CLEAN}, p AS (SELECT CAST(read_id // 2 AS BIGINT) AS pair, bool_or(matched) AS matched FROM verdict WHERE read_id < (SELECT count(*) // 2 * 2 FROM orders) GROUP BY 1)"


def _pairs(spark, sf_dir) -> DataFrame:
    zipped = pairs.zip_records(*mates(spark, sf_dir)).select(F.col("ordinal").alias("pair"), F.explode(F.array("seq_1", "seq_2")).alias("seq"))
    small = zipped.select("pair", "seq", coverage.probe(F.col("seq"), dna_index(spark, sf_dir)).alias("p"))
    said = small.select("pair", coverage.matches(F.col("p.covered"), F.length("seq"), 500).alias("matched"))
    return pairs.pair_verdicts(said)


@query(f"WITH {_PAIRS} SELECT pair, matched FROM p")
def pair_verdict(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT 2 * count(*) AS reads, CAST(2 * count_if(matched) AS BIGINT) AS matched FROM p")
def pair_stats(spark, sf_dir):
    return pairs.pair_stats(_pairs(spark, sf_dir))


@query(f"WITH {TEXT_COVERAGE} SELECT count(*) AS reads, CAST(count_if(covered * 1000 > {TEXT_PERMILLE} * length) AS BIGINT) AS matched, CAST(sum(length) AS BIGINT) AS bases, (SELECT count(*) FROM ds) AS seeds_queried, (SELECT count(*) FROM dhits) AS seeds_found FROM dverdict")
def run_stats(spark, sf_dir):
    """The counters of a run over documents."""
    d = documents(spark, sf_dir).select("text", coverage.probe(F.col("text"), text_index(spark, sf_dir)).alias("p"))
    hit = coverage.matches(F.col("p.covered"), F.coalesce(F.length("text"), F.lit(0)), TEXT_PERMILLE)
    return d.agg(F.count("*").alias("reads"), F.count_if(hit).alias("matched"), F.sum(F.length("text")).alias("bases"), F.sum("p.seeds").alias("seeds_queried"), F.sum("p.found").alias("seeds_found"))


@query(f"WITH {TEXT_COVERAGE} SELECT source AS name, count(*) AS reads, CAST(count_if(covered * 1000 > {TEXT_PERMILLE} * length) AS BIGINT) AS matched, CAST(sum(length) AS BIGINT) AS bases, count_if(covered * 1000 > {TEXT_PERMILLE} * length) * 100.0 / count(*) AS pct, FALSE AS paired FROM dverdict GROUP BY source")
def sample_report(spark, sf_dir):
    """The report of a run in which each source is a sample."""
    rows = documents(spark, sf_dir).select(F.col("source").alias("sample"), F.lit(0).alias("mate"), F.col("doc_id").alias("ordinal"), F.col("text").alias("seq"))
    return split.report(split.split_reads(rows, text_index(spark, sf_dir), TEXT_PERMILLE))
