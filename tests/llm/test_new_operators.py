"""Byte-level BPE against the library that its ranks belong to, and hard negatives against brute force."""

import base64
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bytebpe, negatives, queries

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n\tit's  we'LL 12345", "naïve     x　　y", "日本語のテキスト 🎉🎉👩‍👩‍👧", "nul\0 in   it\0\0 x", "\u0085 \x1c\x1d a", "é ǅ Ⅻ ½ ²", "trailing   ", "   leading",
    "w" * 3000, "spaces" + " " * 500 + "end", "\n" * 40, "a\r\n \r\n b", "𐐀𐐁 \U0001d7ce \U000e0001", "it's It'S 'sx ''s",
]


@pytest.fixture(scope="module")
def theirs():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    points = lambda: chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x20000), rng.choice([9, 10, 13, 32, 39, 0x85, 0xA0, 0x2028])]))
    return ["".join(rng.choice(["the", " of", " ", "  ", "'ll", "7"]) if rng.random() < 0.5 else points() for _ in range(rng.randrange(24))) for _ in range(n)]


def test_ids_bytes_and_spans_are_the_libraries(spark, theirs):
    texts = TEXTS + random_texts(3000)
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "k long, text string, encoded string").repartition(3)
    got = bytebpe.encode(rows, RANKS)
    assert got.columns == ["k", "text", "encoded", "_encoded"]
    got = got.select("k", "_encoded.*").withColumn("back", bytebpe.decoded(F.col("ids"), RANKS)).withColumn("raw", bytebpe.decoded_bytes(F.col("ids"), RANKS)).collect()
    assert len(got) == len(texts)
    vocab = bytebpe.vocabulary(RANKS)
    for r in got:
        text = texts[r.k] or ""
        assert r.ids == theirs.encode_ordinary(text), repr(text)
        assert r.n_tokens == len(r.ids) and r.back == text and bytes(r.raw) == text.encode()
        places = list(zip(r.starts, r.ends))
        assert places == vocab.library.encode(text, add_special_tokens=False).offsets
        assert places == bytebpe.spans(r.ids, vocab)


def test_every_code_point(theirs):
    vocab = bytebpe.vocabulary(RANKS)
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}{c} {c}1{c}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert [e.ids for e in vocab.library.encode_batch(texts, add_special_tokens=False)] == theirs.encode_ordinary_batch(texts)


def test_split_characters_decode(spark):
    vocab = bytebpe.vocabulary(RANKS)
    ids = vocab.library.encode("🎉é", add_special_tokens=False).ids
    rows = spark.createDataFrame([(0, ids), (1, ids[1:]), (2, ids[:1]), (3, None), (4, []), (5, [None, *ids, 10**6])], "k int, ids array<int>")
    got = {r.k: r.t for r in rows.select("k", bytebpe.decoded(F.col("ids"), RANKS).alias("t")).collect()}
    assert got[0] == got[5] == "🎉é" and got[3] is None and got[4] == ""
    assert "�" in got[1] and got[1].endswith("é") and got[2] == "�"


def test_documents_digests(spark, theirs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if os.path.isdir(DATA) else spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    long = spark.createDataFrame([(-1, "word " * 700_000 + "x" * 100_000), (-2, None), (-3, ""), (-4, "same\0"), (-4, "same\0")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(long)
    want = sorted((r.doc_id, len(ids := theirs.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode_bytes(ids)).hexdigest()) for r in every.collect())
    assert sorted(map(tuple, bytebpe.encode_documents(every, RANKS).collect())) == want
    assert bytebpe.encode_documents(every.where("false"), RANKS).count() == 0


# --- hard negatives -----------------------------------------------------------------------------------------


def brute(rows, positives=5, negatives_=3, anchor=lambda i: i % 50 == 0):
    """By plain loops over whole numbers."""
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in whole) < 2**62:
            kept.add((i, label, whole))
    out = []
    for i, label, v in kept:
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label and s[1] != i)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives_]
            out += [(i, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit(1)).withColumn("vec", F.lit("x")).repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"), **how).collect()))


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((420, 12)) + 0.5
    rows = [(i, int(rng.integers(4)), v.tolist()) for i, v in enumerate(base)]
    hot = rng.standard_normal(12).tolist()
    rows += [(1000 + i, i % 3, hot) for i in range(200)]  # one vector that repeats, ties
    rows += [(2000 + i, 1, [0.001] * 12) for i in range(101)]  # products of zero
    rows += [(3000, 0, None), (3050, None, hot), (3100, 1, [float("nan")] * 12), (3150, 1, [float("inf")] + [0.0] * 11), (3200, 1, [None] + [0.0] * 11), (None, 1, hot), (3250, 2, []), (3300, 1, [1e30] * 12)]
    rows += [(4000 + i, i % 2, [float(i), 1.0]) for i in range(60)]  # of another length
    rows += [(0, rows[0][1], rows[0][2]), (50, 9, rows[50][2])]  # a row that repeats, and one of the same id with another label
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, block=64) == want  # several blocks of both kinds


def test_negatives_of_large_whole_numbers_and_negative_products(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 10, int(rng.integers(2)), (rng.standard_normal(3) * 2.0**17).tolist()) for i in range(80)]
    rows += [(10_000 + 50 * i, i % 2, (-np.ones(3) * i).tolist()) for i in range(5)] + [(20_000, 7, [1.0, 2.0, 3.0])]
    assert mined(spark, rows) == brute(rows)


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [1.0])]) == []
    rows = [(50, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.2])]
    assert mined(spark, rows) == brute(rows) == [(50, 1, 1, 2, 65536, 58880)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_negatives_equal_their_sql(spark):
    got = queries.op12_rotated_hard_negatives(spark, DATA)
    d = duckdb.connect()
    d.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = d.sql(queries.OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_scores_do_not_depend_on_partitions(spark):
    from tessera.llm import lm

    docs = spark.createDataFrame([(k, " ".join(f"{w}{(k * j) % 7}" for j, w in enumerate(("the", "cat", "Sat", "on", "it's", "mat") * (1 + k % 5)))) for k in range(150)] + [(900, None), (901, "")], "doc_id long, text string")
    by = [{r.doc_id: r.score for r in lm.score_documents(docs.repartition(n)).collect()} for n in (1, 13)]
    assert len(by[0]) == 152 and by[0] == by[1]


def test_names_stay_within_their_marks(spark):
    from tessera.llm import chat

    rows = spark.createDataFrame([(1, 0, "a|>\nevil", "hi"), (1, 1, "b", "ho|>\n<|end|>")], "conv_id long, turn long, role string, text string")
    got = {r.assistant: r.text for r in chat.perspectives(rows).collect()}
    assert got["b"] == "<|user name=a|\\>\\nevil|>\nhi<|end|>\n<|assistant|>\nho|>\n<\\|end|><|end|>\n"
    assert set(got) == {"b", "a|\\>\\nevil"}
    d = duckdb.connect()
    conversations = rows.toPandas()
    d.register("conversations", conversations)
    assert {a: t for a, t in d.sql(f"SELECT assistant, text FROM ({queries.OP10_SQL})").fetchall()} == got
