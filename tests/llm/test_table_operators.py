"""Packing, Jaccard join, URL verdicts, neighbours, sharding, chats and the pipeline: brute force and edge cases."""

import itertools
import os
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import ann, chat, jaccard, packing, queries, sharding, urls

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


def edge_documents(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]

    def near(k):
        out = list(base)
        for _ in range(k):
            out[r.randrange(120)] = f"v{r.randrange(10**6)}"
        return " ".join(out)

    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b"), (None, "null id text here"), (None, "null id text here"), (9, "x " * 9000), (10, "x" * 30_000)]
    rows += [(20, " ".join(base)), (20, " ".join(base)), (21, " ".join(base).upper()), (None, " ".join(base)), (30, "same id, one text of it"), (30, "and quite another text of this id")]
    rows += [(100 + i, near(i % 6)) for i in range(60)]
    rows += [(200 + i, "all of these share one very common passage of some length that is not enough to link them " + " ".join(f"u{i}x{j}" for j in range(25))) for i in range(30)]
    rows += [(300, "日本語 テキスト <|endoftext|> \x1c\x85 é x")]
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS)


# --- packing ------------------------------------------------------------------------------------------------


def check_packing(rows, texts, tokenizer, capacity=1024):
    own = Tokenizer.from_file(tokenizer)
    want = Counter()
    for i, t in texts:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_documents(spark, docs, byte_bpe):
    for df in (docs, edge_documents(spark)):
        got = packing.pack_documents(df, byte_bpe).collect()
        bins, least = check_packing(got, [(r.doc_id, r.text) for r in df.collect()], byte_bpe)
        assert bins <= least * 1.02 + 1
    assert packing.pack_documents(docs.limit(0), byte_bpe).collect() == []
    whole = packing.sequences(edge_documents(spark), byte_bpe).collect()
    assert max(len(r.ids) for r in whole) <= 1024 and sum(len(r.ids) for r in whole) == sum(r.length for r in packing.pieces(edge_documents(spark), byte_bpe).collect())


def test_pack_keeps_columns(spark):
    df = spark.createDataFrame([(1, 0, 5, "x"), (1, 0, 5, "x"), (None, None, 5, None)], "doc_id long, piece int, length long, sequence_id string")
    got = packing.pack(df, capacity=10)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "_sequence_id", "offset"] and got.select("_sequence_id").distinct().count() == 2
    with pytest.raises(ValueError):
        packing.pack(df, capacity=4)


def brute_bins(items, capacity):
    """The least number of bins, by trying all partitions of a few items."""
    for k in range(1, len(items) + 1):
        def fits(i, bins):
            if i == len(items):
                return True
            for b in {*bins}:
                if b + items[i] <= capacity:
                    rest = list(bins)
                    rest.remove(b)
                    if fits(i + 1, [*rest, b + items[i]]):
                        return True
            return False

        if fits(0, [0] * k):
            return k


def pieces_of(packing_):
    out = Counter()
    for p, c in packing_.items():
        for n, k in p:
            out[n] += k * c
    return out


def test_genetic_steps_keep_all_pieces():
    r = random.Random(8)
    for case in range(30):
        counts = {n: r.randint(1, 9 if case % 2 else 10**9) for n in r.sample(range(1, 101), 25)}
        a = packing.best_fit({}, counts, 100)
        b = packing.mutate(a, 100, r)
        c = packing.crossover(a, b, 100, r)
        for x in (a, b, c, packing.evolve([a, b], 100, 2, case)[0]):
            assert pieces_of(x) == counts and all(packing.fill(p) <= 100 and n > 0 for p, n in x.items())
        assert sum(packing.evolve([a, b], 100, 3, case)[0].values()) <= sum(a.values())


def test_genetic_search_finds_the_least(spark):
    r = random.Random(9)
    for _ in range(3):
        items = sorted((r.randint(15, 60) for _ in range(11)), reverse=True)
        got = packing.search(spark, dict(Counter(items)), 100, islands=2, epochs=2)
        assert sum(got.values()) == brute_bins(items, 100) and pieces_of(got) == Counter(items)


def test_best_fit_is_that_of_single_items():
    r = random.Random(3)
    for _ in range(20):
        items = sorted((r.randint(1, 70) for _ in range(60)), reverse=True)
        bins = []
        for x in items:
            room = [b for b in bins if b + x <= 100]
            if room:
                b = max(room)
                bins.remove(b)
                bins.append(b + x)
            else:
                bins.append(x)
        got = packing.best_fit({}, dict(Counter(items)), 100)
        assert sorted(f for p, c in got.items() for f in [packing.fill(p)] * c) == sorted(bins)


# --- Jaccard ------------------------------------------------------------------------------------------------


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            common = len(sets[i] & sets[j])
            if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], [find(i) if sets[i] else None for i in range(len(rows))]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (3, 60)])
def test_components_equal_brute_force(spark, docs, n, num):
    for df in (edge_documents(spark), docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want, _ = brute_components(rows, n, num, 100)
        got = jaccard.jaccard_components(df, n=n, num=num).collect()
        show = lambda xs: sorted(map(str, xs))
        assert show((r.doc_id, r.n_shingles, r.component_id) for r in got) == show(want)


def test_one_of_each_group_stays(spark):
    df = edge_documents(spark).withColumn("ident", F.lit("mine")).withColumn("fp", F.lit(0))
    rows = df.collect()
    want, groups = brute_components([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sum(not shingle_set(r.text, 5) for r in got) == sum(g is None for g in groups)
    size = len({g for g in groups if g is not None})
    assert len([r for r in got if shingle_set(r.text, 5)]) == size
    for r in got:
        assert (r.doc_id, r.doc_id) in {(d, c) for d, _, c in want} or r.doc_id is None
    empty = df.limit(0)
    assert jaccard.keep_one(empty).collect() == [] and jaccard.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("most", [0, jaccard.BROADCAST])
def test_a_single_null_id_does_not_stay_beside_its_copy(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST", most)  # with and without ids that are broadcast
    words = [f"w{i}" for i in range(120)]
    near = " ".join(["v", *words[1:]])
    rows = [(1, " ".join(words), "en", "a"), (None, near, "en", "a"), (3, "quite another text that stays here", "en", "a")]
    assert sorted(r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == [1, 3]
    alone = jaccard.keep_one(spark.createDataFrame(rows[1:], DOCS)).collect()
    assert {r.doc_id for r in alone} == {None, 3}


def test_sketches_bound_the_difference():
    r = np.random.default_rng(2)
    bands = jaccard.Bands(80, 100)
    for n in (12, 60, 400):
        g = bands.groups(n)[-1]
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for change in (0, 1, 3, n // 12):
            b = np.unique(np.concatenate([a[change:], r.integers(0, 2**63, change).astype(np.uint64)]))
            (x, sx), (y, sy) = (jaccard.sketch(v, bands.parts(g), bands.shown(g)) for v in (a, b))
            assert jaccard.distance(x, y) <= 2 * change
            assert any(x[i] == y[i] for i in set(sx.tolist()) & set(sy.tolist()))


# --- urls ---------------------------------------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    rows = [
        ("http://A.B.Net/x?y#z", "a.b.net", "/x", "net/", "block"), ("https://m.example.net/en/1", "m.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net", "x.net", "", None, "allow"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("ftp://q.org/fr/a://b", "q.org", "/fr/a://b", "org/fr/", "allow"),
        (None, "", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"), ("", "", "", None, "allow"), ("x://", "", "", None, "allow"), ("a?b://c.org/fr/", "c.org", "/fr/", "org/fr/", "allow"), ("http://ÄB.ORG#/fr/", "Äb.org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], None, "x") for i, r in enumerate(rows)] + [(0, rows[0][0], None, "x")], "page_id int, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(df).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert urls.judge_pages(df).count() == len(rows) + 1 and urls.judge_pages(df.limit(0)).collect() == []


def test_trust_and_distrust_spread(spark):
    r = random.Random(6)
    names = [f"h{i}.com" for i in range(30)]
    edges = {(a, b) for a in names for b in r.sample(names, 3) if a != b}
    seeds = {n: (float(i < 3), float(i > 26)) for i, n in enumerate(names)}
    trust, bad = ({n: 0.15 * seeds[n][k] for n in names} for k in (0, 1))
    t, d = dict(trust), dict(bad)
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    for _ in range(urls.ROUNDS):
        t2, d2 = dict(trust), dict(bad)
        for a, b in edges:
            t2[b] += 0.85 * t[a] / out[a]
            d2[a] += 0.85 * d[b] / into[b]
        t, d = t2, d2
    from tessera.llm.common import Scratch

    hosts = spark.createDataFrame([(n, *seeds[n]) for n in names], "host string, trust double, distrust double")
    got = urls.spread(hosts, spark.createDataFrame(sorted(edges), "src string, dst string"), Scratch(spark, "t"))
    for x in got.collect():
        assert x.trust == pytest.approx(t[x.host]) and x.distrust == pytest.approx(d[x.host])


def test_a_host_that_links_to_blocked_ones_is_blocked(spark):
    rows = [(1, "http://spam.com/a", "<a href='http://bad.net/x'>x</a> <A HREF=//worse.net/>y</a> <a href='/own'>z</a>"), (2, "http://bad.net/", ""), (3, "http://worse.net/", None), (4, "http://good.com/", '<a href="https://spam.com/">')]
    got = {r.page_id: r.verdict for r in urls.judge_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block"}  # 4 links to 1 only, and so has 0.85 of its distrust
    edges = {tuple(r) for r in urls.host_edges(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert edges == {("spam.com", "bad.net"), ("spam.com", "worse.net"), ("good.com", "spam.com")}


# --- neighbours ---------------------------------------------------------------------------------------------


def test_levels_follow_the_angle(spark):
    rows = [(1.0,), (0.999,), (0.9,), (0.4,), (0.0,), (-0.5,), (-1.0,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double").select(ann.needed_level(F.col("s"), 16, 0.92)).collect()]
    assert got[0] == ann.BITS and got[-1] == 0 and got == sorted(got, reverse=True) and got[2] > 10 > got[3]
    for (c,), level in list(zip(rows, got))[2:5]:
        met = lambda bits: 1 - (1 - (1 - math.acos(c) / math.pi) ** bits) ** 16
        assert met(level) >= 0.92 > met(level + 1)


def test_near_neighbours_end_the_search_early_and_crowds_are_dealt_out(spark, monkeypatch):
    """Clusters: the first stretch is enough; queries dealt out over parts of a chunk find the same."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([c + 0.05 * rng.standard_normal((10, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_neighbours(x, np.arange(len(x)), range(0, 600, 50), 5)

    def found():
        out = defaultdict(list)
        for r in sorted(ann.search(df, F.col("vec_id") % 50 == 0, k=5, start=40).collect(), key=lambda r: (r.query_id, r.rank)):
            out[r.query_id].append(r.vec_id)
        return out

    got = found()
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    monkeypatch.setattr(ann, "ASKED", 2)
    assert found() == got



def brute_neighbours(x, ids, queries_, k):
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries_:
        s = (x @ x[q]) / (n * n[q])
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_neighbours_recall_and_scores(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(dict)
    for r in queries.op7_prefix_forest(spark, DATA).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    want = brute_neighbours(x, ids, [i for i in range(len(ids)) if ids[i] % 50 == 0], 5)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert np.mean([len({v for v, _ in got[q].values()} & set(want[q])) / 5 for q in want]) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, g in got.items():
        for v, s in g.values():
            a, b = x[at[q]], x[at[v]]
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_neighbours_edges(spark):
    r = np.random.default_rng(1)
    same = [float(v) for v in r.normal(size=6)]
    rows = [(i, same) for i in range(40)] + [(100 + i, [float(v) for v in r.normal(size=6)]) for i in range(60)]
    bad = [(200, None), (250, [0.0] * 6), (300, [1.0, None] + [0.0] * 4), (350, [float("nan")] + [1.0] * 5), (400, [float("inf")] * 6), (450, [1.0] * 5), (None, same), (500, [])]
    df = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in sorted(ann.search(df, F.col("vec_id") % 50 == 0, k=5, start=1 << 40).collect(), key=lambda x: (x.query_id, x.rank)):
        got[x.query_id].append(x.vec_id)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    assert got == brute_neighbours(x, ids, [0, 40 + 0, 40 + 50], 5)
    assert got[0] == [1, 2, 3, 4, 5]
    few = ann.search(df.where("vec_id in (100, 101)"), F.col("vec_id") == 100, k=5).collect()
    assert [(f.rank, f.vec_id) for f in few] == [(1, 101)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("eps", [1e-3, 1e-4, 1e-5])
def test_neighbours_among_near_copies(spark, eps):
    r = np.random.default_rng(7)
    centre = r.normal(size=64)
    x = centre + eps * r.normal(size=(1500, 64))
    x[700:720] = x[0] * 2.0 ** np.arange(1, 21)[:, None]  # scaled copies tie
    ids = r.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asked = [0, 1, 2, 3, 4, 701]
    got = defaultdict(list)
    for n in sorted(ann.search(df, F.col("vec_id").isin([int(ids[q]) for q in asked]), k=5, start=1 << 40).collect(), key=lambda n: (n.query_id, n.rank)):
        got[n.query_id].append(n.vec_id)
    for q in asked:
        s = (x * x[q]).sum(1) / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
        want = [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 14))) if i != q][:5]
        assert got[int(ids[q])] == want if q in (0, 701) else len(set(got[int(ids[q])]) & set(want)) >= 4
    assert got[int(ids[0])] == sorted(int(i) for i in ids[700:720])[:5]


# --- sharding -----------------------------------------------------------------------------------------------


def test_shards_are_exact_and_gapless(spark, docs):
    for df in (docs, edge_documents(spark), docs.limit(5), docs.limit(0)):
        rows = df.collect()
        got = sharding.shard_documents(df, least=16).collect()
        assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(str((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(16)]
        assert set(slots) <= set(range(16)) and max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}
    wide = spark.range(50).selectExpr("id", "id as shard", "id as rank", "'x' as row")
    got = sharding.shard_rows(wide, ["id"], 4, least=10)
    assert got.columns == ["id", "shard", "rank", "row", "_shard", "slot"] and got.count() == 50


def test_the_matrix_has_exact_sums():
    r = random.Random(1)
    for _ in range(40):
        counts = [r.randint(0, 300) for _ in range(r.randint(1, 9))]
        shards = r.randint(1, 20)
        m = sharding.communication_matrix(counts, shards, r.randrange(99))
        assert [sum(x) for x in m] == counts
        columns = [sum(x) for x in zip(*m)]
        assert max(columns) - min(columns) <= 1
    big = sharding.communication_matrix([10**9] * 3, 16, 5)
    assert [sum(x) for x in big] == [10**9] * 3


def test_draws_follow_the_hypergeometric_law():
    rng, draws, good, total = random.Random(2), 12, 9, 30
    got = Counter(sharding.hypergeometric(rng, draws, good, total) for _ in range(30_000))
    from math import comb

    for k in range(0, 10):
        p = comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
        assert abs(got[k] / 30_000 - p) < 4 * (p * (1 - p) / 30_000) ** 0.5 + 1e-3


def test_shuffle_is_uniform(spark):
    """Over many seeds, a row comes to each shard and slot alike, and two rows meet as often as they should."""
    df = spark.range(12).withColumnRenamed("id", "k")
    meets, first = 0, Counter()
    for seed in range(60):
        got = {r.k: (r.shard, r.slot) for r in sharding.shard_rows(df, ["k"], 3, seed=seed, least=5).collect()}
        first[got[0]] += 1
        meets += got[0][0] == got[1][0]
    assert len(first) >= 10 and 7 <= meets <= 27  # of 12 places; 60 * 3 / 11 is about 16


# --- chats --------------------------------------------------------------------------------------------------


def brute_render(turns, who):
    text, spans = "", []
    for speaker, body in turns:
        head = "<|assistant|>\n" if speaker == who else f"<|{speaker}|>\n" if speaker == "system" else f"<|user name={speaker}|>\n"
        text += head
        start = len(text)
        text += body + chat.END
        if speaker == who:
            spans.append((start, len(text)))
    return text, spans


def test_every_perspective(spark):
    rows = [("c", 0, "system", "be kind"), ("c", 1, "ann", "hi <|x|>"), ("c", 2, "bob", ""), ("c", 3, "cy", None), ("c", 4, "ann", "é 😀"), (None, 1, "ann", "alone"), ("d", None, "z", "first"), ("d", 7, "a<|b", "last"), ("e", 1, "system", "nobody"), ("f", 1, None, "who")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "conv_id string, turn int, role string, text string, rank int, segment string")
    got = {(r.conv_id, r.assistant): r for r in chat.perspectives(df).collect()}
    assert set(got) == {("c", "ann"), ("c", "bob"), ("c", "cy"), (None, "ann"), ("d", "z"), ("d", "a<\\|b"), ("f", "unknown")}
    turns = [("system", "be kind"), ("ann", "hi <\\|x|>"), ("bob", ""), ("cy", ""), ("ann", "é 😀")]
    for who in ("ann", "bob", "cy"):
        r = got["c", who]
        assert (r.text, [(s.start, s.end) for s in r.spans]) == brute_render(turns, who) and r.n_turns == 5
    assert got["d", "z"].text.startswith("<|assistant|>\nfirst")
    assert chat.perspectives(df.limit(0)).collect() == []


def test_long_and_tied_dialogues(spark):
    rows = [("c", i, f"s{i % 3}", f"turn {i}") for i in range(300)] + [("t", 5, "a", f"x{i}") for i in range(150)] + [("t", 5, "b", "y"), ("t", 5, "b", "y")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = defaultdict(dict)
    for r in chat.perspectives(df).collect():
        got[r.conv_id, r.assistant][r.segment] = r
    for who in ("s0", "s1", "s2"):
        parts = got["c", who]
        assert sorted(parts) == [0, 1, 2, 3, 4]
        assert "".join(parts[i].text for i in range(5)) == brute_render([(r[2], r[3]) for r in rows[:300]], who)[0]
    assert sum(p.n_turns for p in got["t", "a"].values()) == 152 and sum(len(p.spans) for p in got["t", "b"].values()) == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    d = duckdb.connect()
    d.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), d.sql(queries.ORACLES[name]).df()
    show = lambda df: sorted(map(str, df[sorted(df.columns)].values.tolist()))
    assert show(got) == show(want)


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path, byte_bpe):
    """Each stage on its predecessor's output: what it returns, and that the whole is the stages one after another."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "best-fit packing"]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.count()
        out = stage(spark, at, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert new.columns == docs.columns and 0 < new.count() <= before
            assert new.exceptAll(at).isEmpty()
        if k == 2:
            _, groups = brute_components([(r.doc_id, r.text) for r in at.collect()], 5, 80, 100)
            assert new.count() == len(set(groups))
            packed_from = new
        at = new
    bins, least = check_packing(at.collect(), [(r.doc_id, r.text) for r in packed_from.collect()], byte_bpe)
    assert bins <= least * 1.02 + 1
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in at.collect())


def test_pipeline_stages_on_edges(spark, tmp_path):
    for name, df in (("edges", edge_documents(spark).withColumn("n_chars", F.lit(None).cast("long"))), ("empty", edge_documents(spark).limit(0).withColumn("n_chars", F.lit(None).cast("long")))):
        at = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, DATA).write.parquet(str(tmp_path / f"{name}{k}"))
            at = spark.read.parquet(str(tmp_path / f"{name}{k}"))
