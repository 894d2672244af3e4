"""Mates that arrive apart, with restarts between them."""

import os
import time

from tessera.functions.seeds import Seed
from tessera.operators import index
from tessera.streaming import pairs
from tests.test_files import fastq
from tests.test_ranges import inflate
from tests.test_seeds import random_dna


def test_mates_that_arrive_apart(spark, tmp_path):
    ref, seed = random_dna(300, 8), Seed("#" * 25)
    own = index.build_index(spark.createDataFrame([(ref,)], "s string"), "s", seed)
    os.mkdir(tmp_path / "in")

    def land(name, hit):
        rows = [(f"@{name}{i}", ref[i : i + 60] if hit and i == 0 else random_dna(60, 1000 + i), "+", "I" * 60) for i in range(3)]
        (tmp_path / "in" / name).write_bytes(fastq(rows))

    got = []

    def run(after=3600.0):
        got.clear()
        q = pairs.split_arriving(spark, str(tmp_path / "in"), own, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: got.extend(df.collect()), single_after=after)
        q.awaitTermination()
        return sorted((r["sample"], r.paired, r.reads, r.matched, r.error) for r in got)

    land("a_R1.fastq", True)
    land("b_R2.fastq", False)
    land("c.fastq", True)
    land("notes.txt", False)
    assert run() == [("c.fastq", False, 3, 1, None)]
    assert sorted(os.listdir(tmp_path / "out")) == ["c.matched.fastq", "c.unmatched.fastq"]
    land("a_R2.fastq", False)  # after a restart
    os.utime(tmp_path / "in/a_R2.fastq", (10**9, 10**9))
    assert run() == [("a", True, 6, 2, None)]
    assert inflate(tmp_path / "out/a_R2.matched.fastq").startswith(b"@a_R2.fastq0\n")
    assert run() == []  # nothing new, b still waits
    land("d_R1.fastq", False)
    land("d_R2.fastq", True)
    assert run(after=1.0) == [("d", True, 6, 2, None)]
    land("b_R1.fastq", True)
    assert run() == [("b", True, 6, 2, None)]
    land("e_R1.fastq", True)
    assert run(after=0.5) == []
    time.sleep(1)
    land("f.fastq", False)  # a batch in which the time is looked at
    assert run(after=0.5) == [("e_R1.fastq", False, 3, 1, None), ("f.fastq", False, 3, 0, None)]
