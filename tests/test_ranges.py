"""Files read in ranges by maps: the same records, pairs and stretches as read whole, wherever the seams are."""

import gzip
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.seeds import SPACED_29_33, Seed
from tessera.operators import index
from tessera.plans import sides, split
from tessera.sources import compressed, ranges, sequences
from tests.test_files import block_gzip, fastq, records
from tests.test_seeds import brute_seeds, random_dna


def members(data, sizes):
    """Gzip members of these many bytes each."""
    out, at, k = b"", 0, 0
    while at < len(data):
        n = sizes[k % len(sizes)]
        out += gzip.compress(data[at : at + n], mtime=0)
        at, k = at + n, k + 1
    return out


def stored(data):
    """A member that holds its data as they are."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=0, mtime=0) as f:
        f.write(data)
    return out.getvalue()


ROWS = records(60)
FILES = {
    "a.fastq": fastq(ROWS), "b.fastq": fastq(ROWS, "\r\n"), "c.fastq": fastq(ROWS, end=False), "d.fastq.gz": gzip.compress(fastq(ROWS)),
    "e.fastq.gz": members(fastq(ROWS), [1, 700, 33, 500]), "f.fq.bgz": block_gzip(fastq(ROWS), 300), "g.fastq.gz": members(fastq(ROWS), [257]) + bytes(40), "h.fastq": b"",
}


@pytest.mark.parametrize("split", [64, 501, 4096, 0])
def test_fastq_ranges_of_all_kinds(spark, tmp_path, split):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = ranges.read_fastq(spark, str(tmp_path), split=split).collect()
    for name in FILES:
        own = sorted((r for r in got if r["sample"] == name), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(0 if name[0] == "h" else 60)), name
        assert [tuple(r)[3:] for r in own] == ([] if name[0] == "h" else ROWS), name


def test_marks_that_are_no_members(spark, tmp_path):
    """Members within stored data, and single marks, are not taken for the file's own, wherever the parts' seams are."""
    inner = gzip.compress(b"@x\nACGT\n+\nIIII\n" * 3, mtime=0)
    lines = [("@in" + str(k), "A", "+", inner.replace(b"\n", b"?").decode("latin-1")) for k in range(4)]
    text = b"".join(b"\n".join(x.encode("latin-1") for x in r) + b"\n" for r in lines)
    own = stored(text) + gzip.compress(fastq(ROWS[:20]), mtime=0) + stored(b"@m\nAC\n+\n\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\n") + stored(b"") + gzip.compress(fastq(ROWS[20:]), mtime=0)
    (tmp_path / "m.fastq.gz").write_bytes(own)
    found = [at for at in ranges.member_starts(str(tmp_path / "m.fastq.gz"), 0, len(own)) if ranges.inflated_member(str(tmp_path / "m.fastq.gz"), at)]
    assert len(found) > 5  # of which five are the file's
    want = [*lines, *ROWS[:20], ("@m", "AC", "+", "\x1f\x8b\x08\0\0\0\0\0\0\x03"), *ROWS[20:]]
    for part in (37, 400, 1 << 20):
        got = ranges.read_fastq(spark, str(tmp_path), split=part).orderBy("ordinal").collect()
        assert [tuple(r)[3:] for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))


def test_members_are_dealt_to_tasks(spark, tmp_path):
    data = fastq(records(400))
    (tmp_path / "m.fastq.gz").write_bytes(members(data, [200]))
    got = ranges.read_fastq(spark, str(tmp_path), split=2000)
    assert got.count() == 400 and got.select(F.spark_partition_id()).distinct().count() > 4


def test_broken_files_are_errors(spark, tmp_path):
    sequences.register(spark)
    for name, data in (("a.fastq.gz", gzip.compress(b"x" * 999)[:-3]), ("b.fastq.gz", b"no gzip"), ("c.fastq.gz", gzip.compress(fastq(ROWS)) + b"rest")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="no gzip member"):
            ranges.read_fastq(spark, str(tmp_path / name)).collect()
    assert ranges.read_fastq(spark, str(tmp_path / "c.fastq.gz"), permissive=True).count() == 60
    (tmp_path / "d.fastq").write_bytes(b"@a\nAC\n+\nII\n@b\nAC\n+\n")
    (tmp_path / "e.fastq").write_bytes(b"@a\nAC\n+\nII\n@b\nAC\n+")
    (tmp_path / "f.fastq").write_bytes(b"@a\nAC\n+\nII")
    for name in "def":
        for last in ("true", "false"):
            whole = spark.read.format("fastq").option("lastrecord", last).load(str(tmp_path / f"{name}.fastq"))
            assert ranges.read_fastq(spark, str(tmp_path / f"{name}.fastq"), lastrecord=last, split=5).select("header", "qual").orderBy("header").collect() == whole.select("header", "qual").orderBy("header").collect(), (name, last)


@pytest.mark.parametrize("kinds,part", [(("a.fastq", "b.fastq"), 90), (("a.fastq.gz", "b.fastq"), 1000), (("a.fastq.gz", "b.fastq.bgz"), 90), (("a.fastq.bgz", "b.fastq.gz"), 90)])
def test_pairs_are_read_together(spark, tmp_path, kinds, part):
    rng = random.Random(3)
    one = [(f"@a{k}", random_dna(rng.randrange(1, 90), k), "+", "") for k in range(70)]
    two = [(f"@b{k}", random_dna(rng.randrange(1, 300), 100 + k), "+x", "I") for k in range(70)]
    for name, rows in zip(kinds, (one, two)):
        data = fastq(rows)
        (tmp_path / name).write_bytes(block_gzip(data, 200) if name.endswith("bgz") else members(data, [333, 20]) if name.endswith("gz") else data)
    got = ranges.read_pairs(spark, [("s", *(str(tmp_path / x) for x in kinds))], split=part)
    assert sorted(tuple(r) for r in got.collect()) == [("s", k, *kinds, *one[k], *two[k]) for k in range(70)]


def test_pairs_of_many_samples_and_unequal_files(spark, tmp_path):
    sequences.register(spark)
    rows = {}
    for s, n in (("x", 30), ("y", 0), ("z", 7)):
        for m in (1, 2):
            (tmp_path / f"{s}_{m}.fastq").write_bytes(fastq(records(n, 100 * m)) if n else b"")
        rows[s] = n
    listed = spark.createDataFrame([(s, f"file:{tmp_path}/{s}_1.fastq", f"{tmp_path}/{s}_2.fastq") for s in rows], "sample string, r1 string, r2 string")
    got = ranges.read_pairs(spark, listed, split=300)
    assert {r["sample"]: r["count"] for r in got.groupBy("sample").count().collect()} == {"x": 30, "z": 7}
    (tmp_path / "z_2.fastq").write_bytes(fastq(records(8, 1)))
    with pytest.raises(Exception, match="differ in their number of records"):
        ranges.read_pairs(spark, listed).collect()


def test_pairs_are_judged_where_they_lie(spark, tmp_path):
    sequences.register(spark)
    ref, seed = random_dna(400, 8), Seed("#" * 25)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    mates = {m: [(f"@r{k}", ref[k : k + 80] if k % (2 + m) == 0 else random_dna(80, 1000 * m + k), "+", "I" * 80) for k in range(50)] for m in (1, 2)}
    for m, rows in mates.items():
        (tmp_path / f"s_{m}.fastq").write_bytes(fastq(rows))
    both = ranges.read_pairs(spark, [("s", str(tmp_path / "s_1.fastq"), str(tmp_path / "s_2.fastq"))], split=700)
    said = split.split_read_pairs(both, own)
    want = {(k, m): k % 3 == 0 or k % 4 == 0 for k in range(50) for m in (1, 2)}
    assert {(r.ordinal, r.mate): r.matched for r in said.collect()} == want
    by_join = spark.read.format("fastq").option("sample", "s").option("mate", 1).load(str(tmp_path / "s_1.fastq")).unionByName(spark.read.format("fastq").option("sample", "s").option("mate", 2).load(str(tmp_path / "s_2.fastq")))
    columns = ["sample", "mate", "ordinal", "header", "seq", "plus", "qual", "matched"]
    assert sorted(map(tuple, said.select(columns).collect())) == sorted(map(tuple, split.split_pairs(by_join, own).select(columns).collect()))
    plan = said._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("MapInArrow")]  # above the reader nothing is shuffled
    assert "Exchange" not in last and "Join" not in last


FASTA = {
    "plain": b">one two\nACGT\nAC\n>empty\n>three\n" + b"\n".join([b"ACGTACGTTT"] * 20) + b"\n>last no end\nGGG",
    "cr": b">a\r\nACGT\r\n\r\nAC>GT\r\n>b\r\nTT\r\n",
    "bare": b"ACGT\nACG\n\n>x\nAAAA\n>y\n",
    "long": b">" + b"h" * 50 + b"\n" + b"ACGTT" * 60 + b"\n>" + b"k" * 70 + b"\nA\n",
    "none": b"", "header": b">only", "blank": b"\n\n\n>q\n\nAC\n\n", "marks": b">>a\n>\n>\nA>C\n>z\n>>>\nT", "one": b"ACGTACGTACGT",
}


def whole_contigs(path):
    return [(k, h, s) for k, (h, s) in enumerate(sequences.fasta_contigs(path))]


def put_together(rows):
    """Contigs from stretches, which must agree where they overlap."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.contig_ordinal, r.start, len(r.seq))):
        h, s = out.get(r.contig_ordinal, (r.header, ""))
        assert h == r.header and r.start <= len(s), (r, h, s)
        n = min(len(s) - r.start, len(r.seq))
        assert s[r.start : r.start + n] == r.seq[:n]
        out[r.contig_ordinal] = (h, s[: r.start] + r.seq if r.start + len(r.seq) > len(s) else s)
    return [(k, *v) for k, v in sorted(out.items())]


@pytest.mark.parametrize("wrap", ["fa", "fa.bgz", "fa.gz"])
def test_fasta_ranges_are_the_contigs(spark, tmp_path, wrap):
    for name, data in FASTA.items():
        (tmp_path / f"{name}.{wrap}").write_bytes(block_gzip(data, 17) if wrap.endswith("bgz") else members(data, [13, 40]) or gzip.compress(b"") if wrap.endswith("gz") else data)
    for part, stretch, overlap in ((1, 7, 3), (7, 10, 4), (40, 5, 0), (90, 64, 6), (0, 16, 2)):
        if part in (1, 90) and wrap != "fa":
            continue
        got = ranges.read_fasta_stretches(spark, str(tmp_path), stretch, overlap, split=part).collect()
        for name in FASTA:
            own = [r for r in got if r.file == f"{name}.{wrap}"]
            assert put_together(own) == whole_contigs(str(tmp_path / f"{name}.{wrap}")), (name, part)
            for k, _, s in whole_contigs(str(tmp_path / f"{name}.{wrap}")):  # each window lies whole in a stretch
                for at in range(len(s) - overlap):
                    assert any(r.contig_ordinal == k and r.start <= at and at + overlap + 1 <= r.start + len(r.seq) for r in own), (name, part, k, at)


@pytest.mark.parametrize("part", [64, 999])
def test_index_of_fasta_ranges(spark, tmp_path, part):
    seed, contigs = Seed(SPACED_29_33), [random_dna(n, n, "ACGTN" if n % 2 else "ACGT") for n in (20, 33, 700, 1301)]
    data = "".join(f">c{k}\n" + "\n".join(s[i : i + 70] for i in range(0, len(s), 70)) + "\n" for k, s in enumerate(contigs)).encode()
    want = {s for c in contigs for _, s in brute_seeds(c, seed)}
    for name, body in (("r.fa", data), ("r.fa.gz", members(data, [300])), ("r.fa.bgz", block_gzip(data, 100))):
        (tmp_path / name).write_bytes(body)
        own = index.index_of_fasta(spark, str(tmp_path / name), seed, stretch=50, split=part)
        assert own.codes.count() == len(want), name
    assert zlib.crc32(b"") == 0 and compressed.kind(str(tmp_path / "r.fa")) == "plain"


# --- both sides under their names ---------------------------------------------------------------------------


def inflate(path):
    return b"".join(compressed.stream(str(path)))


@pytest.mark.parametrize("packed", [False, True])
def test_sides_are_the_input(spark, tmp_path, packed):
    """Both files of an input together are its records, each side in their order, under the names that follow from the input's."""
    ref, seed = random_dna(400, 8), Seed("#" * 25)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    rows = [(f"@r{k}", ref[k : k + 80] if k % 3 == 0 else random_dna(80, 500 + k), "+", "I" * 80) for k in range(90)]
    inputs = {"a.fastq": fastq(rows), "b_R1.fq.gz": members(fastq(rows[::-1]), [999]), "c.fastq.bgz": block_gzip(fastq(rows[:50]), 300), "none.fastq": fastq([r for k, r in enumerate(rows) if k % 3])}
    os.mkdir(tmp_path / "in")
    for name, data in inputs.items():
        (tmp_path / "in" / name).write_bytes(data)
    hit = {r[0] for k, r in enumerate(rows) if k % 3 == 0}
    for part in (700, 5000):  # the second run replaces the first
        got = sides.write_sides(split.split_reads(ranges.read_fastq(spark, str(tmp_path / "in"), split=part), own), str(tmp_path / "out"), packed).collect()
        assert len(got) == 8 and not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]
        for r in got:
            text = inflate(tmp_path / "out" / r.output)
            all_ = inflate(tmp_path / "in" / r.file).decode().split("\n")[:-1]
            want = [tuple(all_[i : i + 4]) for i in range(0, len(all_), 4) if (all_[i] in hit) == r.matched]
            assert text == (fastq(want) if want else b"") and r.records == len(want)
    tail = ".gz" if packed else ""
    assert {r.output for r in got if r.matched} == {f"a.matched.fastq{tail}", f"b_R1.matched.fq{tail}", f"c.matched.fastq{tail}", f"none.matched.fastq{tail}"}


def test_many_samples_at_once_some_broken(spark, tmp_path):
    ref, seed = random_dna(300, 8), Seed("#" * 25)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    listed = []
    for k in range(40):
        for m in (1, 2):
            n = 5 + (k == 7 and m == 2)
            rows = [(f"@r{i}", ref[i : i + 60] if (i + k) % 4 == m else random_dna(60, 100 * k + 10 * i + m), "+", "I" * 60) for i in range(n)]
            data = gzip.compress(fastq(rows))
            (tmp_path / f"s{k}_R{m}.fastq.gz").write_bytes(data[:-9] if (k, m) == (11, 1) else data)
        listed.append((f"s{k}", f"{tmp_path}/s{k}_R1.fastq.gz", None if k % 10 == 3 else f"{tmp_path}/s{k}_R2.fastq.gz"))
    listed.append(("gone", f"{tmp_path}/gone.fastq", None))
    listed.append(("half", f"{tmp_path}/s0_R1.fastq.gz.bak", f"{tmp_path}/s0_R2.fastq.gz"))
    got = {r["sample"]: r for r in sides.split_all(spark, spark.createDataFrame(listed, "sample string, r1 string, r2 string"), own, str(tmp_path / "out"), gzip=True).collect()}
    assert len(got) == 42 and {s for s, r in got.items() if r.error} == {"s7", "s11", "gone", "half"}
    assert "differ in their number" in got["s7"].error and "no gzip member" in got["s11"].error and "no file" in got["gone"].error
    for k in range(40):
        r = got[f"s{k}"]
        if r.error:
            assert r.reads == 0 and not [x for x in os.listdir(tmp_path / "out") if x.startswith(f"s{k}_")]
            continue
        hits = [sum((i + k) % 4 == m for i in range(5)) for m in (1, 2)]
        assert r.paired == (k % 10 != 3)
        assert (r.reads, r.matched) == ((10, 2 * sum(hits)) if r.paired else (5, hits[0]))
        assert len(inflate(tmp_path / "out" / f"s{k}_R1.matched.fastq.gz").splitlines()) == 4 * (sum(hits) if r.paired else hits[0])


def test_mates_that_come_in_turn_are_one_part_each(spark, tmp_path):
    """A task's records of a file are one part of each side (a gzip member), though those of its mate lie between them."""
    ref, seed = random_dna(300, 8), Seed("#" * 25)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    for m in (1, 2):
        rows = [(f"@r{i}", ref[i : i + 60] if i % 3 == m else random_dna(60, 10 * i + m), "+", "I" * 60) for i in range(60)]
        (tmp_path / f"s_R{m}.fastq").write_bytes(fastq(rows))
    pairs = ranges.read_pairs(spark, [("s", *(str(tmp_path / f"s_R{m}.fastq") for m in (1, 2)))])
    sides.write_sides(split.split_read_pairs(pairs, own), str(tmp_path / "out"), True, name="file")
    for m in (1, 2):
        for side, n in (("matched", 40), ("unmatched", 20)):
            data, found, lines = (tmp_path / "out" / f"s_R{m}.{side}.fastq.gz").read_bytes(), 0, 0
            while data:
                out = zlib.decompressobj(31)
                lines += out.decompress(data).count(b"\n")
                data, found = out.unused_data, found + 1
            assert (found, lines) == (1, 4 * n)


def test_many_small_ranges_are_few_tasks(tmp_path, monkeypatch):
    """Tasks follow the bytes, not the ranges; all ranges are there once, in their order."""
    parts = [sequences.FileRange("f", a, a + 65536, k) for k, a in enumerate(range(0, 65536 * 40_000, 65536))]
    got = sequences.grouped(parts)
    assert len(got) <= 90 and [p.number for g in got for p in g.parts] == list(range(40_000))
    assert len(sequences.grouped(parts[:50])) == 50
    monkeypatch.setattr(ranges.os.path, "getsize", lambda f: 65536 * 40_000)
    assert ranges.tasks_for(["f"], 1 << 14) <= 90 and ranges.tasks_for(["f"], 1 << 30) == 3
