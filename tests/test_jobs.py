"""The jobs on small inputs: both sides, nulls and odd names, reruns, and a stream over growing input."""

import json
import logging
import os
import subprocess
import sys

import pytest

from jobs import arrivals, screen
from jobs.common import Settings
from jobs.queries import record_rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PASSAGE = "The quick brown fox jumps over the lazy dog while nine zebras vex a jolly king."
OTHER = "Pack my box with five dozen liquor jugs, said the sphinx of black quartz to me."
DOCS = [(1, f"intro {PASSAGE} end", "web"), (2, "nothing of it at all, " * 5, "web"), (3, None, "books"), (4, "", "books"), (5, PASSAGE[:40] + "x" * 900, "a/b=c"), (6, f"{OTHER} {PASSAGE}", None), (6, f"{OTHER} {PASSAGE}", None), (None, "null id, " + OTHER, "web")]
ITEMS = [(10, PASSAGE), (11, "a reference text that no record holds, of some length"), (12, "short"), (13, None), (14, OTHER)]
S = Settings(permille=300)


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    return tmp_path


def covered(text):
    marks = [False] * len(text or "")
    windows = {t[i : i + 25] for _, t in ITEMS if t for i in range(len(t) - 24)}
    for i in range(len(marks) - 24):
        if text[i : i + 25] in windows:
            marks[i : i + 25] = [True] * 25
    return sum(marks)


def want(docs):
    return sorted((str(i), t, c := covered(t), c * 1000 > 300 * len(t or ""), s or "") for i, t, s in docs)


def rows(sides):
    return sorted((str(r.id), r.text, r.covered, r.matched, r["sample"] or "") for r in sides.collect())


def test_screen_writes_sides_report_and_items(spark, tables, caplog):
    caplog.set_level(logging.INFO, "jobs")
    out = f"{tables}/out"
    got = []
    for _ in range(2):  # a rerun gives the same
        counts = screen.screen(spark, f"{tables}/documents", f"{tables}/benchmark", out, S)
        sides = spark.read.schema(screen.SIDES.format(id="bigint")).parquet(f"{out}/sides")
        report = {r["sample"]: (r.records, r.matched, r.characters, r.covered) for r in spark.read.parquet(f"{out}/report").collect()}
        items = {r.item: (r.windows, r.found, r.most_records, r.leaked == "true") for r in spark.read.parquet(f"{out}/items").collect()}
        got.append((counts, rows(sides), report, items))
    assert got[0] == got[1]
    counts, sides, report, items = got[0]
    assert sides == want(DOCS) and {s: len([x for x in DOCS if (x[2] or "") == s]) for s in report} == {s: v[0] for s, v in report.items()}
    assert report["books"] == (2, 0, 0, 0) and report["web"][1] == 2 and report[""][1] == 2 and report["a/b=c"][1] == 0
    assert counts == {"records": 8, "matched": 4, "characters": sum(len(t or "") for _, t, _ in DOCS), "items": 5, "leaked": 2}
    assert items[11] == (29, 0, 0, False) and items[12] == items[13] == (0, 0, 0, False)
    n = len(PASSAGE) - 24
    assert items[10] == (n, n, 3, True) and items[14] == (len(OTHER) - 24,) * 2 + (2, True)
    assert any("read 8 records" in r.getMessage() for r in caplog.records) and any("2 of 5 reference texts" in r.getMessage() for r in caplog.records)
    assert sorted(x for x in os.listdir(f"{out}/sides") if "=" in x) == ["matched=false", "matched=true"]


def test_screen_of_empty_tables(spark, tables):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tables}/none")
    assert screen.screen(spark, f"{tables}/none", f"{tables}/benchmark", f"{tables}/o1", S) == {"records": 0, "matched": 0, "characters": 0, "items": 5, "leaked": 0}
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tables}/nothing")
    assert screen.screen(spark, f"{tables}/documents", f"{tables}/nothing", f"{tables}/o2", S)["matched"] == 0


def land(spark, folder, docs, name):
    """A file moved in whole, with an old time."""
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}-{name}")
    (part,) = [x for x in os.listdir(f"{folder}-{name}") if x.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    os.utime(f"{folder}-{name}/{part}", (1_700_000_000 - int(name) * 10**7,) * 2)
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def test_arrivals_take_only_what_is_new(spark, tables, caplog):
    caplog.set_level(logging.INFO, "jobs")
    landing, out, mark = f"{tables}/landing", f"{tables}/arrived", f"{tables}/checkpoint"
    run = lambda s=S: arrivals.arrivals(spark, landing, f"{tables}/benchmark", out, mark, s)
    sides = lambda: rows(arrivals.sides_of(spark, out, "bigint"))
    land(spark, landing, DOCS[:3], "1")
    assert run() == {"batches": 1, "records": 3, "matched": 1}
    assert sides() == want(DOCS[:3])
    land(spark, landing, DOCS[3:5], "2")  # older than the first
    land(spark, landing, DOCS[5:], "3")
    assert run(Settings(permille=300, files_per_batch=1)) == {"batches": 2, "records": 5, "matched": 3}
    assert sides() == want(DOCS)
    report = lambda: sorted(map(tuple, spark.read.parquet(f"{out}/report").collect()))
    before = report()
    assert {r[0]: r[1] for r in before} == {"web": 3, "books": 2, "a/b=c": 1, "": 2}
    assert run() == {"batches": 0, "records": 0, "matched": 0} and sides() == want(DOCS) and report() == before
    assert sum(r.getMessage().startswith("batch ") for r in caplog.records) == 3


def test_a_batch_that_comes_again_replaces_itself(spark, tables):
    landing, out, mark = f"{tables}/landing", f"{tables}/arrived", f"{tables}/checkpoint"
    land(spark, landing, DOCS, "1")
    arrivals.arrivals(spark, landing, f"{tables}/benchmark", out, mark, S)
    (commit,) = [x for x in os.listdir(f"{mark}/commits") if not x.startswith(".")]
    os.remove(f"{mark}/commits/{commit}")  # as if the run had died after it wrote
    for crc in [x for x in os.listdir(f"{mark}/commits") if x.endswith(".crc")]:
        os.remove(f"{mark}/commits/{crc}")
    # with another threshold the batch's folders differ: none of the first attempt is left
    assert arrivals.arrivals(spark, landing, f"{tables}/benchmark", out, mark, Settings(permille=999))["records"] == len(DOCS)
    got = arrivals.sides_of(spark, out, "bigint")
    assert got.count() == len(DOCS) and got.where("matched").count() == 0
    assert record_rows(got).columns[0] == "part"


def test_arrivals_before_any_file(spark, tables):
    os.makedirs(f"{tables}/landing")
    schema = spark.read.parquet(f"{tables}/documents").schema
    assert arrivals.arrivals(spark, f"{tables}/landing", f"{tables}/benchmark", f"{tables}/o", f"{tables}/c", S, schema)["records"] == 0


def test_settings_and_command_line(tables):
    for name in ("screen", "arrivals"):
        assert Settings.load(f"{ROOT}/jobs/{name}.json") == Settings()
    bad = tables / "bad.json"
    bad.write_text(json.dumps({"permile": 1}))
    with pytest.raises(ValueError, match="permile"):
        Settings.load(str(bad))
    config = tables / "own.json"
    config.write_text(json.dumps({"permille": 300}))
    run = [sys.executable, "-m", "jobs.screen", "--documents", f"{tables}/documents", "--reference", f"{tables}/benchmark", "--out", f"{tables}/cli", "--config", str(config)]
    done = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "4 matched, 4 not" in done.stderr and os.path.exists(f"{tables}/cli/report/_SUCCESS")
