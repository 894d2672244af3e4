import gzip
import io
import os
import pickle
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.seeds import Seed
from tessera.operators import coverage, index, pairs
from tessera.plans import split
from tessera.sources import compressed, published, sequences
from tests.test_seeds import brute_seeds, random_dna


def records(n, start=0):
    return [(f"@r{k}", random_dna(40 + k % 5, k), "+", "I" * (40 + k % 5)) for k in range(start, start + n)]


def fastq(rows, newline="\n", end=True):
    text = newline.join(x for r in rows for x in r)
    return (text + newline * end).encode()


def block_gzip(data, size=500):
    out = b""
    for at in [*range(0, len(data), size), None]:
        part = b"" if at is None else data[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        whole = 18 + len(body) + 8
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, whole - 1) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.fixture
def known(spark):
    sequences.register(spark)
    return spark


def test_fastq_in_all_wrappings(known, tmp_path):
    rows = records(50)
    data = fastq(rows)
    third = len(data) // 3
    (tmp_path / "a.fastq").write_bytes(data)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.fastq.gz").write_bytes(b"".join(gzip.compress(data[i : i + third]) for i in range(0, len(data), third)))
    (tmp_path / "d.fastq.bgz").write_bytes(block_gzip(data))
    (tmp_path / "e.fq.bgzf").write_bytes(block_gzip(data, 77))
    (tmp_path / "f.fastq").write_bytes(fastq(rows, "\r\n"))
    (tmp_path / "g.fastq").write_bytes(fastq(rows, end=False))
    got = known.read.format("fastq").load(str(tmp_path)).collect()
    for f in sorted(os.listdir(tmp_path)):
        own = sorted((r for r in got if r["sample"] == f), key=lambda r: r.ordinal)
        assert [(r.header, r.seq, r.plus, r.qual) for r in own] == rows, f
        assert [r.ordinal for r in own] == list(range(50))


def test_fastq_edges(known, tmp_path):
    p = tmp_path / "x.fastq"
    p.write_bytes(fastq([("@e", "", "+", ""), ("@n", "ACGT", "+", "IIII")]))
    read = lambda **o: known.read.format("fastq").options(**o).load(str(p))
    assert [r.seq for r in read().collect()] == ["", "ACGT"]
    p.write_bytes(fastq([("@a", "ACGT", "+", "IIII"), ("@b", "ACG", "+", "III")], end=False))
    assert read().count() == 2 and read(lastrecord="false").count() == 1
    p.write_bytes(fastq([("@a", "ACGT", "+", "IIII")], "\r\n"))
    assert read(keepcr="true").first().seq == "ACGT\r" and read(sample="s", mate=2).first().mate == 2
    p.write_bytes(b"")
    assert read().count() == 0


def test_gzip_members_and_errors(tmp_path):
    inner = b"\x1f\x8b\x08 is data, not a member" * 50
    data = gzip.compress(inner) + gzip.compress(b"") + gzip.compress(b"end")
    assert b"".join(compressed.inflate(io.BytesIO(data))) == inner + b"end"
    with pytest.raises(ValueError):
        list(compressed.inflate(io.BytesIO(data + b"garbage")))
    assert b"".join(compressed.inflate(io.BytesIO(data + b"garbage"), permissive=True)) == inner + b"end"
    with pytest.raises(EOFError):
        list(compressed.inflate(io.BytesIO(data[:-9])))
    p = tmp_path / "b.bgz"
    p.write_bytes(block_gzip(b"x" * 1300))
    found = compressed.blocks(str(p))
    assert len(found) == 4 and sum(n for _, n in found) == p.stat().st_size
    assert compressed.is_gzip(p.read_bytes()[:2]) and not compressed.is_gzip(b"AC")
    assert compressed.block_size(gzip.compress(b"x")) is None


def test_fasta(known, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one x\nACGT\nAC>GT\n\nTT\n>two\r\nGGGG\r\nCC")
    (tmp_path / "b.fna.gz").write_bytes(gzip.compress(b">three\n" + b"ACGTACGTAC\n" * 7))
    got = sorted(map(tuple, known.read.format("fasta").load(str(tmp_path)).collect()))
    assert got == [("a.fa", 0, "one x", "ACGTAC>GTTT"), ("a.fa", 1, "two", "GGGGCC"), ("b.fna.gz", 0, "three", "ACGTACGTAC" * 7)]
    lines = [("a.fa", i, x) for i, x in enumerate(["", ">one x", "ACGT", "AC>GT", "", "TT", ">two\r", "GGGG\r", "CC"])]
    again = sequences.fasta_from_text(known.createDataFrame(lines, "file string, line_no long, value string"))
    assert sorted(map(tuple, again.collect())) == got[:2]
    # seeds go across the ends of lines, not of contigs
    own = index.build_index(known.read.format("fasta").load(str(tmp_path / "b.fna.gz")), "seq", Seed("#" * 25))
    assert {r.seed for r in own.codes.collect()} == {int(s, 4) for _, s in brute_seeds("ACGTACGTAC" * 7, Seed("#" * 25))}


def test_fastq_from_numbered_lines(spark):
    rows = [("f", i, x) for i, x in enumerate(["@a", "AC", "+", "II", "@b", "GT\r", "+", "II", "@c", "AA"])]
    got = sequences.fastq_from_text(spark.createDataFrame(rows, "file string, line_no long, value string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.header, r.seq) for r in got] == [(0, "@a", "AC"), (1, "@b", "GT")]


def test_names(spark):
    rows = [
        ("a_R1.fastq", 1, "a"), ("a_2.fq.gz", 2, "a"), ("V350342880_L03_UDB-193_1.clean.fastq.gz", 1, "V350342880_L03_UDB-193.clean"), ("x_1_R2.fq", 2, "x_1"),
        ("s_R1_001.fastq", 1, "s_001"), ("single.fq", 0, "single"), ("x_12.fastq", 0, "x_12"), ("a_r2.FASTQ.BGZ", 2, "a"),
    ]
    df = spark.createDataFrame(rows, "n string, m int, k string")
    assert [(r[0], r[1]) for r in df.select(names.mate(F.col("n")), names.mate_key(F.col("n"))).collect()] == [(m, k) for _, m, k in rows]
    got = df.select(names.output_name(F.col("n"), True), names.output_name(F.col("n"), False, True)).collect()
    assert got[1][0] == "a_2.matched.fq" and got[0][1] == "a_R1.unmatched.fastq.gz"
    other = spark.createDataFrame([("reads",), ("r.fa.gz",), ("i.info",), ("x.bam",)], "n string").select(names.output_name(F.col("n"), True), names.role(F.col("n"))).collect()
    assert [r[0] for r in other][0] == "reads.matched.fastq" and [r[1] for r in other] == [None, "reference", "index", None]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (10240,), (5 << 20,), (3 << 40,)], "n long").select(names.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "10 KB", "5.0 MB", "3072 GB"]


def test_files_are_paired_by_arrival(spark):
    rows = [(0, "a_R2.fastq"), (1, "a_R1.fastq"), (2, "b_1.fq"), (3, "c.fq"), (4, "a_1.fastq.gz"), (5, "d_2.fq")]
    got = {tuple(r) for r in pairs.pair_files(spark.createDataFrame(rows, "arrival int, name string")).collect()}
    assert got == {("a", "a_R1.fastq", "a_R2.fastq"), ("b_1.fq", "b_1.fq", None), ("c.fq", "c.fq", None), ("a_1.fastq.gz", "a_1.fastq.gz", None), ("d_2.fq", "d_2.fq", None)}


def test_unequal_mates_are_an_error(spark):
    r1 = spark.createDataFrame([(0, "A"), (1, "C")], "ordinal long, seq string")
    assert pairs.zip_records(r1, r1).count() == 2
    with pytest.raises(Exception, match="differ in their number"):
        pairs.zip_records(r1, r1.limit(1)).collect()


def reads_frame(spark, ref):
    rows = []
    for k in range(24):
        for mate in (1, 2):
            seq = ref[k * 7 : k * 7 + 60] if (k % 3 == 0 and mate == 1) or k % 5 == 0 else random_dna(60, 1000 + 2 * k + mate)
            rows.append(("s", mate, k, f"@r{k}/{mate}", seq, "+", "I" * 60))
    return spark.createDataFrame(rows, "sample string, mate int, ordinal long, header string, seq string, plus string, qual string")


def test_split_is_complete_and_single_and_paired_agree(spark, tmp_path):
    ref = random_dna(300, 77)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", Seed("#" * 25))
    reads = reads_frame(spark, ref)
    single = {(r.ordinal, r.mate): r.matched for r in split.split_reads(reads, own).collect()}
    assert single == {(r.ordinal, r.mate): r.matched for r in split.split_reads(reads, own, strategy="join").collect()}
    assert single == {(k, m): (k % 3 == 0 and m == 1) or k % 5 == 0 for k in range(24) for m in (1, 2)}
    paired = split.split_pairs(reads, own)
    for r in paired.collect():
        assert r.matched == (single[r.ordinal, 1] or single[r.ordinal, 2])
    out = str(tmp_path / "out")
    for compress in (False, True):  # the second replaces the first
        split.write_split(paired, out, gzip=compress)
    back = spark.read.text(out).where("sample = 's'")
    assert back.count() == reads.count() * 4
    first = [x for f in sorted((tmp_path / "out/matched=true/sample=s/mate=1").glob("*.gz")) for x in gzip.open(f, "rt").read().split("\n")[:-1]]
    want = [x for k in range(24) if single[k, 1] or single[k, 2] for x in next(r for r in reads.collect() if (r.ordinal, r.mate) == (k, 1))[3:]]
    assert first == want
    row = split.report(paired, 2.0).first()
    hits = sum(single[k, 1] or single[k, 2] for k in range(24))
    assert (row.reads, row.matched, row.paired, row.pct, row.rate) == (48, 2 * hits, True, 2 * hits * 100 / 48, 24.0)
    broken = split.split_samples(["good", "bad"], lambda n: reads if n == "good" else reads.select("nothing"), own, str(tmp_path / "many"))
    assert [b.error is None for b in broken] == [True, False]
    with pytest.raises(Exception, match="differ in their number"):
        split.split_pairs(reads.where("ordinal != 3 or mate = 1"), own).collect()


def test_fastq_writer_commits(known, tmp_path):
    rows = spark_rows(known)
    out = str(tmp_path / "w")
    rows.write.format("fastq").mode("append").save(out)
    assert known.read.format("fastq").load(out).count() == 20 and not os.path.exists(out + "/_temporary")
    rows.limit(3).coalesce(1).write.format("fastq").option("gzip", "true").mode("overwrite").save(out)
    assert known.read.format("fastq").load(out).count() == 3


def spark_rows(spark):
    return spark.createDataFrame([("s", 0, i, *r) for i, r in enumerate(records(20))], sequences.FASTQ_SCHEMA)


# --- published filters --------------------------------------------------------------------------------------


def encode_filter(codes, layout, bits, factors):
    """A small encoder of its own: every code is put in the first window that has room."""
    M = 1 << bits

    def swap(a, c):
        return a * (((c << bits // 2) ^ (c >> bits // 2)) % M) % (1 << 64) % M

    def bucket(a, c, n):
        if n == 1:
            return 0
        s = swap(a, c)
        return s >> (bits - n.bit_length() + 1) if n & (n - 1) == 0 else (s ^ s >> bits // 2) % n if n % 2 == 0 else s % n

    sub, win, fp, off = factors
    data = 0
    for c in codes:
        p = bucket(fp, c, 2**layout.fingerprint_bits - 1) + 1
        one = bucket(win, c, layout.windows)
        two = (one + bucket(off, p, layout.windows - layout.window_size + 1)) % layout.windows
        base = bucket(sub, c, layout.subfilters) * layout.subfilter_bits
        for choice, w in ((0, one), (1, two)):
            done = False
            for j in range(layout.window_size):
                at = base + (w + j) * layout.slot_bits
                value = p | j << layout.fingerprint_bits | choice << (layout.fingerprint_bits + layout.offset_bits)
                have = data >> at & ((1 << layout.slot_bits) - 1)
                if have == value or not have:
                    if not have:
                        data |= value << at
                    done = True
                    break
            if done:
                break
        else:
            raise AssertionError("full")
    return data.to_bytes(layout.subfilter_bits * layout.subfilters // 8 + 8, "little")


@pytest.mark.parametrize("windows,subfilters", [(1001, 1), (1000, 3), (1024, 2), (999, 4)])
def test_published_filter(spark, tmp_path, windows, subfilters):
    seed = Seed("#" * 12)
    info = (
        {"filtertype": "windowed_cuckoo", "universe": 4**12, "nsubfilters": subfilters, "nslots": np.int64((windows + 3) * subfilters), "nwindows_per_subfilter": windows, "windowsize": 2, "target_fpr": 12, "maxsteps": 500}
        | {f"{n}_hashfunc_str": f"linear{v}" for n, v in zip(("subfilter", "window", "fingerprint", "offset"), (62591, 9123457, 51234567, 884421))},
        {},
        {"mask": list(range(12)), "k": np.int32(12), "rcmode": "max"},
    )
    what = published.Description.of(published.read_info(pickle.dumps(info, 4)))
    ref = random_dna(120, 3)
    codes = sorted({int(s, 4) for _, s in brute_seeds(ref, seed)})
    (tmp_path / "i.filter").write_bytes(encode_filter(codes, what.layout, what.bits, what.factors))
    (tmp_path / "i.info").write_bytes(pickle.dumps(info, 2))
    with tarfile.open(tmp_path / "i.tar", "w") as t:
        t.add(tmp_path / "i.filter", "index/i.filter")
        t.add(tmp_path / "i.info", "index/i.info")
    os.mkdir(tmp_path / "u")
    path, again = published.load_published(*published.unpack(str(tmp_path / "i.tar"), str(tmp_path / "u")))
    assert again == what
    raw = np.fromfile(path, np.uint8)
    assert published.contains(raw, what, np.array(codes, np.uint64)).all()
    others = np.array([c for c in np.random.default_rng(1).integers(0, 4**12, 4000) if c not in set(codes)], np.uint64)
    assert published.contains(raw, what, others).mean() < 0.02
    df = spark.createDataFrame([(0, ref), (1, "ACGTN"), (2, None)], "k int, s string")
    got = {r.k: r.p for r in df.select("k", published.probe_published(F.col("s"), path, what).alias("p")).collect()}
    assert got[0].covered == 120 and got[0].seeds == got[0].found == 109 and got[1].covered == got[2].covered == 0
    row = published.info_frame(spark, published.read_info(pickle.dumps(info))).first()
    assert row.filtertype == "windowed_cuckoo" and row.span == 12 and row.hash.window == "linear9123457"


@pytest.mark.parametrize("subfilters,window_size,bits,load", [(1, 2, 14, 0.7), (7, 2, 13, 0.9), (4, 3, 7, 0.9), (16, 1, 16, 0.4)])
def test_filters_are_written_by_subfilter(spark, tmp_path, subfilters, window_size, bits, load):
    """Every code is found in a file that tasks filled; slots whose bits are not whole bytes too."""
    seed, n = Seed("#" * 15), 6000
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 4**15, n))
    what = published.Description.of(published.read_info(published.describe(seed, len(codes), window_size, bits, load, subfilters)))
    rows = spark.createDataFrame([(int(c),) for c in np.append(codes, codes[:50])], "seed long")
    path = str(tmp_path / "i.filter")
    assert published.write_filter(rows, what, path) == len(codes)
    raw = np.fromfile(path, np.uint8)
    assert len(raw) == what.layout.subfilter_bits * subfilters // 8 + 8
    assert published.contains(raw, what, codes.astype(np.uint64)).all()
    others = np.setdiff1d(rng.integers(0, 4**15, 50_000), codes).astype(np.uint64)
    assert published.contains(raw, what, others).mean() <= 2 * window_size / 2**bits * 2 + 1e-4
    again = str(tmp_path / "again.filter")
    published.write_filter(rows.repartition(5), what, again)
    assert (np.fromfile(again, np.uint8) == raw).all()  # a second attempt writes the same
    assert published.write_filter(rows.where("false"), what, again) == 0 and not np.fromfile(again, np.uint8).any()


def test_a_filter_that_is_too_small_is_told():
    with pytest.raises(ValueError, match="too small"):
        published.settle(np.zeros(5, np.int64), np.ones(5, np.int64), 2, 3, 200)
    assert published.settle(np.zeros(0, np.int64), np.zeros(0, np.int64), 2, 3, 200)[0].size == 0


def test_published_refusals(tmp_path):
    with pytest.raises(pickle.UnpicklingError):
        published.read_info(pickle.dumps((os.system, {}, {})))
    with pytest.raises(ValueError):
        published.read_info(pickle.dumps({"a": 1}))
    with pytest.raises(ValueError, match="not supported"):
        published.Description.of({"filtertype": "other"})
    for first, message in (("x.hash", "older kind"), ("x.txt", "begins with")):
        with tarfile.open(tmp_path / "t.tar", "w") as t:
            t.addfile(tarfile.TarInfo(first), io.BytesIO())
        with pytest.raises(ValueError, match=message):
            published.unpack(str(tmp_path / "t.tar"), str(tmp_path))
    with pytest.raises(ValueError):
        published.load_published("a.info", "a.filter")


def test_stream_splits_as_a_batch_does(spark, tmp_path):
    from tessera.streaming import split as stream

    ref = random_dna(300, 77)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", Seed("#" * 25))
    reads = reads_frame(spark, ref)
    reads.coalesce(1).write.parquet(str(tmp_path / "in"))
    progress = stream.Progress(total_rows=48)
    spark.streams.addListener(progress)
    q = stream.split_stream(stream.read_stream(spark, str(tmp_path / "in")), own, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    want = {(r.ordinal, r.mate, r.matched) for r in split.split_reads(reads, own).collect()}
    assert {(r.ordinal, r.mate, str(r.matched).lower() == "true") for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    reads.where("ordinal < 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # only what is new is read
    stream.split_stream(stream.read_stream(spark, str(tmp_path / "in"), 1), own, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 52
    got = []
    stream.pair_stream(stream.read_stream(spark, str(tmp_path / "in"), 1), own, lambda df, n: got.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(got) == 52
    spark.streams.removeListener(progress)
    assert 0 <= progress.share <= 1


def test_stream_deals_a_batch_to_enough_tasks(spark, tmp_path):
    """Forty files are not the work of the session's few partitions: what a task reads does not grow with a batch."""
    from tessera.streaming import split as stream

    (tmp_path / "in").mkdir()
    for k in range(40):
        (tmp_path / "in" / f"{k}.fastq").write_bytes(fastq([(f"@f{k}", "ACGT", "+", "IIII")]))
    rows = stream.read_fastq_stream(spark, str(tmp_path / "in")).select("header", F.spark_partition_id().alias("task"))
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.header, r.task) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    most = max(sum(t == task for _, t in got) for _, task in got)
    assert sorted(h for h, _ in got) == sorted(f"@f{k}" for k in range(40)) and most <= 5


def test_files_are_read_in_ranges(known, tmp_path):
    """Each record is read once wherever a range begins; qualities that look like marks do not mislead."""
    import random

    r = random.Random(4)
    rows = [(f"@r{k}", random_dna(r.randint(1, 60), k), "+" + "@" * (k % 3), r.choice(["@", "+", "I"]) + "I" * 20) for k in range(300)]
    (tmp_path / "a.fastq").write_bytes(fastq(rows))
    (tmp_path / "b.fastq").write_bytes(fastq(rows, "\r\n", end=False))
    (tmp_path / "c.fastq.bgz").write_bytes(block_gzip(fastq(rows), 333))
    for f in ("a.fastq", "b.fastq", "c.fastq.bgz"):
        for split_ in (0, 97, 500, 1001, 4096):
            df = known.read.format("fastq").option("split", split_).load(str(tmp_path / f))
            got = sorted(sequences.dense_ordinals(df).collect(), key=lambda x: x.ordinal)
            assert [(x.header, x.seq, x.plus, x.qual) for x in got] == rows, (f, split_)
            assert [x.ordinal for x in got] == list(range(300))
    assert known.read.format("fastq").option("split", 500).load(str(tmp_path / "a.fastq")).rdd.getNumPartitions() > 20
    (tmp_path / "d.fastq").write_bytes(b"x\n" * 2000)
    with pytest.raises(Exception, match="split=0"):
        known.read.format("fastq").option("split", 500).load(str(tmp_path / "d.fastq")).collect()


def test_writer_packs_what_readers_read(known, tmp_path):
    rows = spark_rows(known)
    want = sorted(map(tuple, rows.select("header", "seq", "plus", "qual").collect()))
    for kind in ("none", "gzip", "members", "bgzf"):
        out = str(tmp_path / kind)
        rows.coalesce(2).write.format("fastq").option("compression", kind).mode("append").save(out)
        assert sorted(map(tuple, known.read.format("fastq").load(out).select("header", "seq", "plus", "qual").collect())) == want
    assert all(compressed.blocks(str(p)) for p in (tmp_path / "bgzf").glob("*.bgz"))


def test_lines_are_numbered_in_any_store(spark, tmp_path):
    rows = records(400)
    (tmp_path / "a.fastq").write_bytes(fastq(rows))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(fastq(rows[:7])))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sequences.fastq_from_text(sequences.numbered_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a.fastq", 400), ("b.fastq.gz", 7)):
        own = sorted((r for r in got if r.file.endswith(name)), key=lambda r: r.ordinal)
        assert [(r.header, r.seq, r.plus, r.qual) for r in own] == rows[:n]


def test_index_of_long_contigs(known, tmp_path):
    """Stretches of a contig give the seeds of the whole one, in a long row too."""
    contig, seed = random_dna(5000, 9), Seed("######_#######_###_#######_######")
    lines = "\n".join(contig[i : i + 70] for i in range(0, 5000, 70))
    (tmp_path / "g.fa").write_text(f">one\n{lines}\n>two\n{contig[::-1]}\n>three\nACGT\n")
    whole = known.read.format("fasta").load(str(tmp_path / "g.fa"))
    want = {r.seed for r in index.build_index(whole, "seq", seed).codes.collect()}
    assert want == {int(s, 4) for c in (contig, contig[::-1]) for _, s in brute_seeds(c, seed)}
    for stretch in (40, 1000, 4999, 5000, 9000):
        assert {r.seed for r in index.index_of_fasta(known, str(tmp_path / "g.fa"), seed, stretch=stretch).codes.collect()} == want
    parts = known.read.format("fasta").option("stretch", 1000).option("overlap", 32).load(str(tmp_path / "g.fa")).where("contig_ordinal = 1").orderBy("start").collect()
    assert all(contig[::-1][p.start : p.start + len(p.seq)] == p.seq for p in parts) and all(a.start + len(a.seq) - b.start == 32 for a, b in zip(parts, parts[1:]))
    long = "ACGTTGCAAC" * 150_000 + random_dna(100, 1)  # more than one piece
    own = index.build_index(known.createDataFrame([(long,), (None,), ("",)], "s string"), "s", Seed("#" * 25))
    assert own.codes.count() == len({x for _, x in brute_seeds("ACGTTGCAAC" * 8 + long[-100:], Seed("#" * 25))})


def test_published_index_splits(spark, tmp_path):
    """A published filter takes the place of an index in splits of reads, of pairs and of streams, with the same verdicts."""
    from tessera.streaming import split as stream

    ref, seed = random_dna(300, 77), Seed("#" * 25)
    reads = reads_frame(spark, ref)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    info = published.describe(seed, own.size, subfilters=3)
    assert published.write_filter(own.codes, published.Description.of(published.read_info(info)), str(tmp_path / "i.filter")) == own.size
    (tmp_path / "i.info").write_bytes(info)
    theirs = published.PublishedIndex(*published.load_published(str(tmp_path / "i.filter"), str(tmp_path / "i.info")))
    said = lambda df: {(r.ordinal, r.mate, r.matched) for r in df.collect()}
    assert said(split.split_reads(reads, theirs)) == said(split.split_reads(reads, own))
    assert said(split.split_pairs(reads, theirs)) == said(split.split_pairs(reads, own))
    reads.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.split_stream(stream.read_stream(spark, str(tmp_path / "in")), theirs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.ordinal, r.mate, str(r.matched) == "true") for r in spark.read.parquet(str(tmp_path / "out")).collect()} == said(split.split_reads(reads, own))
    assert split.split_samples(["a"], lambda n: reads, theirs, str(tmp_path / "many"))[0].error is None


def test_stream_of_fastq_files(known, tmp_path):
    from tessera.streaming import split as stream

    ref = random_dna(300, 77)
    own = index.build_index(known.createDataFrame([(ref,)], "s string"), "s", Seed("#" * 25))
    os.mkdir(tmp_path / "in")
    rows = [(f"@r{k}", ref[k : k + 60] if k % 2 else random_dna(60, k), "+", "I" * 60) for k in range(40)]

    def run():
        stream.split_stream(stream.read_fastq_stream(known, str(tmp_path / "in"), split=700), own, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r.header, str(r.matched).lower()) for r in known.read.parquet(str(tmp_path / "out")).collect()}, known.read.parquet(str(tmp_path / "out")).count()

    want = {(r[0], "true" if k % 2 else "false") for k, r in enumerate(rows)}
    (tmp_path / "in/a.fastq").write_bytes(fastq(rows[:25]))
    assert run() == ({x for x in want if int(x[0][2:]) < 25}, 25)
    (tmp_path / "in/b.fastq.gz").write_bytes(gzip.compress(fastq(rows[25:33])))
    os.utime(tmp_path / "in/b.fastq.gz", (10**9, 10**9))  # moved in later with a much older time
    assert run() == ({x for x in want if int(x[0][2:]) < 33}, 33)
    (tmp_path / "in/c.fastq.bgz").write_bytes(block_gzip(fastq(rows[33:]), 300))
    os.utime(tmp_path / "in/c.fastq.bgz", (10**9, 10**9))  # and another of the same time
    assert run() == (want, 40)
    assert run() == (want, 40)


def test_stream_takes_a_backlog_in_batches_and_tells_its_share(known, tmp_path):
    from tessera.streaming import split as stream

    own = index.build_index(known.createDataFrame([(random_dna(300, 77),)], "s string"), "s", Seed("#" * 25))
    os.mkdir(tmp_path / "in")
    total = 0
    for k in range(10):
        data = fastq(records(5, 5 * k))
        data = (data, gzip.compress(data), block_gzip(data, 100))[k % 3]
        (tmp_path / f"in/{k}.fastq{('', '.gz', '.bgz')[k % 3]}").write_bytes(data)
        total += len(data)
    progress = stream.Progress(total_bytes=total)
    known.streams.addListener(progress)
    q = stream.split_stream(stream.read_fastq_stream(known, str(tmp_path / "in"), files_per_batch=4, split=150), own, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    files = [p.observedMetrics["input"]["files"] for p in q.recentProgress]
    assert sum(files) == 10 and max(files) == 4 and len([f for f in files if f]) == 3
    for _ in range(100):
        if progress.ended:
            break
        __import__("time").sleep(0.1)
    known.streams.removeListener(progress)
    assert progress.bytes == total and progress.share == 1.0 and progress.shares == sorted(progress.shares) and 0 < progress.shares[0] < 1
    assert known.read.parquet(str(tmp_path / "out")).count() == 50


def written(spark, path):
    return sorted(r.header for r in spark.read.format("fastq").load(str(path)).collect())


def test_appends_add_and_overwrites_replace(known, tmp_path):
    frame = lambda a, b: known.createDataFrame([("s", 0, k, *r) for k, r in enumerate(records(b - a, a))], sequences.FASTQ_SCHEMA)
    names_ = lambda a, b: sorted(r[0] for r in records(b - a, a))
    out = str(tmp_path / "out")
    frame(0, 10).write.format("fastq").mode("append").save(out)
    frame(10, 17).write.format("fastq").mode("append").option("compression", "bgzf").save(out)
    assert written(known, out) == names_(0, 17)
    bad = frame(20, 25).withColumn("seq", F.when(F.col("ordinal") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("seq")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            bad.write.format("fastq").mode(mode).save(out)
        assert written(known, out) == names_(0, 17)  # nothing lost, nothing partial
    os.makedirs(f"{out}/_temporary-other")  # another writer at work
    frame(30, 34).write.format("fastq").mode("overwrite").save(out)
    assert written(known, out) == names_(30, 34) and os.listdir(f"{out}/_temporary-other") == []
    assert [x for x in os.listdir(out) if x.startswith("_temporary")] == ["_temporary-other"]


@pytest.mark.parametrize("permissive", [False, True])
def test_members_end_anywhere_in_a_piece(monkeypatch, permissive):
    data = gzip.compress(b"a" * 50) + gzip.compress(b"b" * 60) + gzip.compress(b"") + gzip.compress(b"c" * 40)
    for piece in range(1, len(data) + 1):
        monkeypatch.setattr(compressed, "PIECE", piece)
        assert b"".join(compressed.inflate(io.BytesIO(data), permissive)) == b"a" * 50 + b"b" * 60 + b"c" * 40
        assert len(b"".join(compressed.inflate(io.BytesIO(data + bytes(5)), permissive))) == 150
        for rest in (b"x", b"xyz"):
            if permissive:
                assert len(b"".join(compressed.inflate(io.BytesIO(data + rest), True))) == 150
            else:
                with pytest.raises(ValueError):
                    b"".join(compressed.inflate(io.BytesIO(data + rest)))


def test_a_run_is_cancelled_and_leaves_no_output(known, tmp_path):
    import threading
    import time

    slow = F.udf(lambda s: time.sleep(0.2) or s, "string")
    own = index.build_index(known.createDataFrame([(random_dna(300, 77),)], "s string"), "s", Seed("#" * 25))
    reads = reads_frame(known, random_dna(300, 77))
    run, got = split.Run(known), []
    read = lambda n: reads.withColumn("seq", slow("seq")) if n == "slow" else reads
    t = threading.Thread(target=lambda: got.extend(run.samples(["first", "slow", "last"], read, own, str(tmp_path / "out"))))
    t.start()
    while not (tmp_path / "out/first/_SUCCESS").exists():
        time.sleep(0.1)
    time.sleep(1.5)
    run.cancel()
    t.join(60)
    assert not t.is_alive() and [(r.name, r.error) for r in got] == [("first", None), ("slow", split.CANCELLED), ("last", split.CANCELLED)]
    assert not [p for p in (tmp_path / "out").rglob("*.txt") if "/slow/" in str(p) or "/last/" in str(p)]


def test_places_within_groups(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as g", "cast(null as int) as h")
    got = split.placed(rows, ["g", "h"], ["id"]).collect()
    assert len(got) == 1000 and all(r.line == r.id // 3 + 1 for r in got)


def test_seconds_left():
    from tessera.operators.index import NativeLayout
    from tessera.streaming.split import Progress

    p = Progress(total_rows=1000)
    assert p.seconds_left() is None
    p.began = 0.0
    for i in range(1, 101):
        p.rows = i * 10
        assert abs(p.seconds_left(now=i * 6.0) - i * 6.0 * (100 - i) / i) < 1e-9
    x = NativeLayout(12, 3, 0, 1000, 7)
    assert (x.slot_bits, x.window_bits, x.slots_each, x.subfilter_bits) == (15, 45, 143, 2560)
