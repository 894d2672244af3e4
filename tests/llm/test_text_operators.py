"""Quality rules, language ID, BPE, LM scoring: against brute force, held-out accuracy and edge cases."""

import hashlib
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, langid, lm, quality, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
EDGES = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "a"), (None, "no id here", "en", "a"), (6, "12 34 !!", "en", "a"),
    (7, "same text " * 40, "en", "a"), (7, "same text " * 40, "en", "a"), (8, "line\n" * 30, "fr", "a"), (9, "x" * 200_000, "de", "a"), (10, "ein Wort " * 30_000, "de", "a"),
    (11, "日本語 テキスト Ωμέγα \x1c\x85 ΑΣ İ<|endoftext|>x", None, "a"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def key(t):
    return hashlib.md5((t or "").encode()).hexdigest()


def brute_base(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_quality_counts(docs, edges):
    for df in (docs, edges):
        rows = quality.quality(df.withColumn("quality", F.lit(1))).select("text", "_quality.*").collect()
        assert len(rows) == df.count()
        for r in rows:
            base = brute_base(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
            assert not (r.base_failed and r.kept)


def test_quality_bands(spark):
    r = random.Random(1)
    syllables = [a + b + c for a in "tlmdvrp" for b in "aeiou" for c in ("", "n", "s")]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(400))
    noise = " ".join("".join(chr(r.randrange(33, 127)) for _ in range(r.randint(3, 9))) for _ in range(900))
    half = prose + " " + " ".join(f"w{i % 7} and so on it goes" for i in range(900))
    df = spark.createDataFrame([(0, prose), (1, "buy now and win big " * 300), (2, noise), (3, half)], "k int, text string")
    got = {x.k: x.q for x in df.select("k", quality.compression_bands("text", max_repeat=100).alias("q")).collect()}
    assert got[0].kept and not got[1].kept and not got[2].kept and not got[3].kept
    assert got[1].reason == "repetitive" and got[2].reason.startswith("incompressible") and got[3].reason.startswith("repetitive")


def test_quality_verdicts_by_brute_force(spark, docs, edges):
    """Ratios, counts of chunks and verdicts from zstandard itself."""
    import zstandard

    squeezed = lambda b: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b))
    for df in (docs, edges):
        for r in df.select("text", quality.compression_bands("text").alias("q")).collect():
            data, q = (r.text or "").encode(), r.q
            parts = [data[i : i + 2048] for i in range(0, len(data) - 2047, 2048)]
            low, high = sum(2048 / squeezed(p) < 1.45 for p in parts), sum(2048 / squeezed(p) > 2.45 for p in parts)
            band = [b for b in quality.BANDS if len(data) >= b.least][-1]
            ratio = len(data) / squeezed(data) if data else None
            good = not data or band.low <= ratio <= band.high and 4 * low <= len(parts) and 4 * high <= len(parts)
            assert (q.ratio, q.n_chunks) == (ratio, len(parts)) and q.kept == (good and not q.base_failed)
            if q.n_chunks:
                assert (q.n_low, q.n_high) == (low, high)


def test_pipeline_keeps_short_good_documents(spark, docs):
    import corpus_pipeline

    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert kept.join(good, "doc_id").count() >= 0.99 * docs.join(good, "doc_id").where("text is not null").count() > 20


def test_quality_keeps_what_people_call_good(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    said = docs.join(labels, "doc_id").select("quality", quality.compression_bands("text").alias("q")).where("not q.base_failed")
    rows = said.select("quality", "q.kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert len(good) > 20 and sum(good) >= 0.99 * len(good)


def test_language_on_held_out_rows(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.select("doc_id", "lang").join(queries.op2_viterbi_language(spark, "/root/testdata/sf0.01"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best = scores[0].astype(float)
    paths = [[j] for j in range(k)]
    for t in range(1, n):
        now, new = [], []
        for j in range(k):
            i = max(range(k), key=lambda i: best[i] - penalty * (i != j))
            now.append(best[i] - penalty * (i != j) + scores[t, j])
            new.append(paths[i] + [j])
        best, paths = np.array(now), new
    return best.max()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    lengths = np.array([40, 17, 17, 5, 1, 1])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    label = langid.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        own, path = scores[at : at + n], label[at : at + n]
        value = own[np.arange(n), path].sum() - 1.5 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(brute_viterbi(own, 1.5), abs=1e-4)
        at += n


def test_mixed_text_has_spans(spark, docs):
    model = langid.train(docs)
    parts = {r.lang: r.text for r in docs.where("n_chars between 300 and 900").orderBy("doc_id").collect()}
    text = parts["en"].strip() + "\n" + parts["de"].strip()
    cut = len(parts["en"].strip())
    df = spark.createDataFrame([(text,), ("Привет, как дела у вас",), ("",), (None,)], "text string")
    got = [r.language for r in langid.identify(df, model).collect()]
    assert [s.lang for s in got[0].spans] == ["en", "de"] and abs(got[0].spans[0].end - cut) < 60
    assert got[0].score == pytest.approx(max(cut, len(text) - cut) / len(text), abs=0.1)
    assert (got[2].lang, got[2].score, got[3].lang) == ("und", 0.0, "und")
    assert got[1].lang in model.langs  # a script that no language was seen in leaves all


def test_scripts_narrow(spark):
    rows = [(i, w * 9, lang) for i, (w, lang) in enumerate([("и в не на что ", "ru"), ("and the for was ", "en"), ("και το να για ", "el")] * 4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([("ζζζ ψψψ",), ("щщщ",), ("zzz qqq",)], "text string")
    assert [r.language.lang for r in langid.identify(df, model).collect()] == ["el", "ru", "en"]


def test_language_edges(spark, edges):
    got = langid.identify_documents(edges).collect()
    by = {(r.doc_id): r for r in got}
    assert len(got) == len(EDGES) and all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 6))
    assert langid.identify_documents(edges.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify_documents(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(edges.withColumn("language", F.lit(1)))
    assert kept.columns == [*edges.columns, "language"] and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 6})


@pytest.fixture(scope="module")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe_is_the_librarys(spark, docs, edges, word_bpe):
    own = Tokenizer.from_file(word_bpe)
    for df in (edges, docs):
        texts = df.withColumn("encoded", F.lit(0))
        got = bpe.encode(texts, word_bpe).select("text", "_encoded.*").withColumn("back", bpe.decoded(F.col("ids"), word_bpe)).collect()
        for r in got:
            ids = own.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids) and r.back == own.decode(ids, skip_special_tokens=False)
    digest = {(r.doc_id, r.ids_sha256) for r in bpe.encode_documents(edges, word_bpe).collect()}
    assert (1, hashlib.sha256(b"").hexdigest()) in digest and len(digest) == len(EDGES) - 1
    assert bpe.encode_documents(edges.limit(0), word_bpe).collect() == []


def test_bpe_merges_random_words(word_bpe):
    own, vocab, r = Tokenizer.from_file(word_bpe), bpe.Vocabulary(word_bpe), random.Random(2)
    for n in [*range(1, 60), 99, 100, 101, 102, 500, 3000]:
        for letters in ("ab", "etaoinshr", "aäöüßéèñ", "x"):
            w = "".join(r.choice(letters) for _ in range(n))
            assert vocab.merged(w) == own.encode(w, add_special_tokens=False).ids


def test_bpe_of_every_code_point(spark, word_bpe):
    """Between letters and signs, all code points have the library's ids: its tables of characters are not those of the pattern's module."""
    own, vocab = Tokenizer.from_file(word_bpe), bpe.vocabulary(word_bpe)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}?! {c}b{c} " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert sum(map(vocab.plain, texts)) > 3
    encoder = bpe.Encoder(vocab, bpe.compile_words([]) | {"ends": np.zeros(1, np.int64), "ids": np.zeros(0, np.int32)}, tuple)
    for at in range(0, len(texts), 2000):
        forms, which, begin, order = encoder.encode(pa.array(texts[at : at + 2000]))
        got = [[t for w in which[a:b] for t in forms[w]] for a, b in zip(begin, begin[1:])]
        want = own.encode_batch([texts[at + i] for i in order], add_special_tokens=False)
        assert got == [w.ids for w in want]


def test_automaton_is_minimal_and_exact():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode() for _ in range(600)})
    a = bpe.compile_words(words)
    assert bpe.look_up(a, words).tolist() == list(range(len(words)))
    others = [w for w in {"".join(r.choice("abcd") for _ in range(r.randint(0, 9))).encode() for _ in range(500)} if w not in set(words)]
    assert (bpe.look_up(a, others) == -1).all()
    # as many states as there are different sets of endings
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(a["final"]) == len(futures)
    assert bpe.look_up(bpe.compile_words([]), [b"x"]).tolist() == [-1]


def test_lm_base_and_probability(spark, docs, edges):
    for df in (docs, edges):
        rows = df.select("doc_id", "text").collect()
        out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        end, train = object(), Counter()
        words = [(r.doc_id, [*(r.text or "").encode().lower().split(), end]) for r in rows]
        for i, ws in words:
            if not out(i):
                train.update(ws)
        n, v = sum(train.values()), len(train)
        want = sorted((i is None, i or 0, out(i), len(ws), sum(train[w] > 0 for w in ws), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)
        got = lm.score_documents(df).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    held = [r for r in lm.score_documents(docs).collect() if r.held_out]
    size = dict(docs.select("doc_id", F.octet_length("text")).collect())
    assert -sum(r.score for r in held) / math.log10(2) / sum(size[r.doc_id] for r in held) < 3.2  # bits a byte
    assert lm.score_documents(edges.limit(0)).collect() == []


def plain_units(text):
    """The units of a text, one byte after another."""
    out, unit = [], b""
    for k in range(len(text)):
        unit += text[k : k + 1]
        if text[k] in b" \t\n\v\f\r":
            out.append(unit)
            unit = b""
    return [u[:-1] if u[-1:] == b" " else u for u in [*out, unit + lm.END]]


def test_units_spell_the_text():
    texts = [b"", b" ", b"a", b"a b\n\nc  d ", b"x\ty\r\nz", "\u00e9 \u00fc\n".encode(), b"\n", None, b"a \tb\v\f ", b"x" * 100_000 + b" " * 5000]
    for some in (texts, texts[:4], texts[:1], []):  # with and without white space that is rare
        units, begin = lm.cut(pa.array(some, pa.binary()))
        assert [units.to_pylist()[a:b] for a, b in zip(begin, begin[1:])] == [plain_units(t or b"") for t in some]
        for t, a, b in zip(some, begin, begin[1:]):
            assert b"".join(lm.spelled(units.slice(a, b - a)).to_pylist()) == (t or b"") + lm.END
    ends = lm.endings(pa.array([b"", b"a", b"\x00", b"ba", b"cba", b"ab", b"\x00\x00"], pa.binary())).tolist()
    assert ends[3] == ends[4] and len(set(ends)) == 6 and 0 not in ends


def small_model(rows, tmp_path, spark):
    train = spark.createDataFrame([(r,) for r in rows], "data binary").repartition(3)
    scratch = lm.Scratch(spark, "test")
    return lm.build(train, scratch.write(lm.count_units(train)), scratch), train


PROSE = [" ".join(random.Random(k).choices(["the", "of", "house", "Haus", "von", "der", "x1", "tree\n"], k=80) + [f"w{k % 7}{k}", "rare"]).encode() for k in range(120)]


def test_lm_learns_weights_on_every_text(spark, tmp_path):
    """Whichever text is the only one, weights are learned on it: none is left out by its hash."""
    for text in PROSE[:3]:
        model, train = small_model([text], tmp_path, spark)
        assert lm.learn_weights(train, spark.sparkContext.broadcast(model), model.alphabet.total) is not None


def test_lm_fetches_each_row_once_and_learns_as_dense_steps_do(spark, tmp_path):
    """A table is asked once for a row of nodes, not again for each of its bits; steps that move only what is reached give the numbers of steps over all of the refinement."""
    model, _ = small_model(PROSE, tmp_path, spark)
    layer, read, fetched = model.of_units, lm.Read(model.alphabet, pa.array(PROSE[:40], pa.binary())), []

    class Counted(np.ndarray):
        def take(self, at, *more, **options):
            fetched.append(len(at))
            return np.asarray(self).take(at, *more, **options)

    of = layer.bits(read.symbol)
    layer.table.rows = np.asarray(layer.table.rows).view(Counted)
    logits, gate = layer.inputs(read.contexts, of, True)
    assert sum(fetched) == len(read.contexts) * len(of.head) < len(read.contexts) * len(of.bit)
    got, want = lm.Mixer(len(logits)), lm.Mixer(len(logits))
    got.learn(logits, gate, of.row, of.bit, 0.003)
    for at in range(0, len(gate), lm.STEP):
        k = slice(at, at + lm.STEP)
        z = want.mix([x[k] for x in logits], gate[k])
        error = (of.bit[k] - lm.squash(z)) * np.float32(0.003)
        for x, w in zip(logits, want.weights):
            w += np.bincount(gate[k], error * np.clip(x[k], -8, 8), lm.LEVELS**3).astype(np.float32)
        low, part = lm._bins(z)
        bins = of.row[k] * lm.BINS + low + (part > 0.5)
        count = np.bincount(bins, minlength=want.refine.size)
        mean = np.bincount(bins, of.bit[k], want.refine.size) / np.maximum(count, 1)
        flat = want.refine.reshape(-1)
        flat += (count / (count + 60) * (mean - flat)).astype(np.float32)
    assert len(gate) > 2 * lm.STEP and (got.weights == want.weights).all() and (got.refine == want.refine).all()


def test_lm_is_a_probability(spark, tmp_path):
    """The chances of all symbols after a context add up to one, with what was learned."""
    model, _ = small_model(PROSE, tmp_path, spark)
    read = lm.Read(model.alphabet, pa.array(PROSE[:3], pa.binary()))
    for layer, contexts, n in ((model.of_units, read.contexts, len(model.alphabet.values)), (model.of_letters, lm.letter_contexts(lm.spelled(read.others), model.alphabet)[1], 256)):
        for at in (0, 3, 11):
            p = 10 ** layer.score(np.arange(n), [np.repeat(c[at], n) for c in contexts])
            assert p.sum() == pytest.approx(1, abs=1e-3) and (p > 0).all()


def test_lm_score_is_a_plain_loops(spark, tmp_path, monkeypatch):
    """Bit by bit: contexts from the units before, counts by brute force over the training texts, mixing and refinement."""
    monkeypatch.setattr(lm, "EVENTS", 1e-4)  # so many rows that no two meet
    model, _ = small_model(PROSE, tmp_path, spark)
    al = model.alphabet
    number = {u: k for k, u in enumerate(al.values.to_pylist()) if u is not None}
    code = lambda c, s: [int(c.aligned[s]) >> (63 - j) & 1 for j in range(c.length[s])]

    def events(text):
        """(layer, contexts, symbol) of a text."""
        marker = before = ending = None
        for u in plain_units(text):
            s = number.get(u, al.escape)
            yield model.of_units, (("marker", marker), ("ending", ending), ("before", before)), s
            if s == al.escape:
                yield u
            if u in number and s < lm.MARKERS:
                marker = s
            before, ending = s, u[-2:]

    def letters(u):
        w = u if u and u[-1] in lm.ENDS else u + b" "
        for i, c in enumerate(w):
            yield model.of_letters, tuple((k, w[:i] if k is None else w[max(0, i - k) : i]) for k in lm.OF_LETTERS), int(al.letter_rank[c])

    counts, others = Counter(), Counter()
    def put(layer, contexts, s, n):
        b = code(layer.code, s)
        for c in contexts:
            for j, bit in enumerate(b):
                counts[layer is model.of_units, c, tuple(b[:j]), bit] += n
    for t in PROSE:
        for e in events(t):
            if isinstance(e, bytes):
                others[e] += 1
            else:
                put(*e, 1)
    for u, n in others.items():
        for e in letters(u):
            put(*e, n)

    def alone(c, s, j):
        b, total = code(c, s)[:j], [0, 0]
        for k, w in enumerate(c.weights):
            own = code(c, k)
            if own[:j] == b and len(own) > j:
                total[own[j]] += int(w)
        return math.log((total[1] + 0.2) / (total[0] + 0.2))

    def score(layer, contexts, s):
        out, b = 0.0, code(layer.code, s)
        gone = [False] * len(contexts)
        for j, bit in enumerate(b):
            inputs, gate = [], 0
            for k, c in enumerate(contexts):
                n0, n1 = (counts[layer is model.of_units, c, tuple(b[:j]), v] for v in (0, 1))
                if j % 3 == 0 and j:  # nothing is kept below a row that one event alone reached
                    head = tuple(b[: j - 3])
                    up = sum(counts[layer is model.of_units, c, head, v] for v in (0, 1))
                    gone[k] = gone[k] or up == 1
                if gone[k]:
                    n0 = n1 = 0
                p0, p1 = (int(x) for x in lm.packed(np.array([n0, n1])))
                n0, n1 = float(lm._COUNT[p0]), float(lm._COUNT[p1])
                inputs.append(math.log((n1 + 0.2) / (n0 + 0.2)))
                if k >= len(contexts) - 3:
                    gate = gate * lm.LEVELS + sum(n0 + n1 > x for x in (0.5, 1.5, 4.5, 30))
            if layer.alone:
                inputs.append(alone(layer.code, s, j))
            z = max(-14, min(14, sum(x * float(w[gate]) for x, w in zip(inputs, layer.mixer.weights))))
            place = max(-7.99, min(7.99, z)) * 2 + 16
            low = int(place)
            row = int("1" + "".join(map(str, b[:j])), 2) if j < 8 else 0
            fine = layer.mixer.refine[row][low] * (1 - place + low) + layer.mixer.refine[row][low + 1] * (place - low)
            p = min(1 - 1e-6, max(1e-6, (1 / (1 + math.exp(-z)) + float(fine)) / 2))
            out += math.log10(p if bit else 1 - p)
        return out

    texts = [*PROSE[::9], b"", b"unseen words and house\tof", b"rare rare w00 tree\n\n", "\u00fcber der Haus".encode()]
    got = lm.score_texts(model, np.zeros(len(al.values), np.int64), pa.array(texts, pa.binary()))[1]
    for t, g in zip(texts, got):
        want = 0.0
        for e in events(t):
            want += sum(score(*x) for x in letters(e)) if isinstance(e, bytes) else score(*e)
        assert g == pytest.approx(want, abs=1e-3, rel=1e-3)


def test_lm_sees_across_white_space(spark, tmp_path):
    """The same words in another order have another score."""
    model, _ = small_model([b"one two three four five six"] * 40 + [b"six two five one four three %d" % k for k in range(5)], tmp_path, spark)
    got = lm.score_texts(model, np.zeros(len(model.alphabet.values), np.int64), pa.array([b"one two three four five six", b"four two six one five three"], pa.binary()))[1]
    assert got[0] > got[1] + 1


def test_lm_table_grows_and_keeps_the_frequent():
    assert lm.Table(10).row_bits + lm.Table(10).part_bits < lm.Table(10_000_000).row_bits + lm.Table(10_000_000).part_bits < lm.Table(10**9).row_bits + lm.Table(10**9).part_bits
    key, n = lm.summed(np.array([5, 5, 9, 1 << 40], np.uint64), np.array([1, 2, 3, 4]))
    assert key.tolist() == [5, 9, 1 << 40] and n.tolist() == [3, 3, 4]
    back = lm.unpressed(lm.pressed(key, n))
    assert back[0].tolist() == key.tolist() and back[1].tolist() == n.tolist()


@pytest.mark.parametrize("of", ["units", "letters"])
def test_lm_counts_contexts_in_bounded_memory(of):
    """A task sums (context, symbol) numbers as they come: it holds few of them, and their counts are whole."""

    class Task:
        def mapInArrow(self, run, schema):
            return run

    r = random.Random(5)
    words = [f"{r.randrange(10**9):x}{k % 991}".encode() for k in range(250_000)]
    units = pa.array([*words[:2000], None], pa.binary())
    alphabet = lm.Alphabet(units.drop_null(), np.ones(2000, np.int64), 10, np.arange(256))
    if of == "units":
        batch = pa.RecordBatch.from_arrays([pa.array([b" ".join(words[k : k + 500]) for k in range(0, 250_000, 500)] * 8, pa.binary())], names=["data"])
        run = lm.count_unit_contexts(Task(), SimpleNamespace(value=alphabet), 3)
        want, bound = 3 * 8 * 250_000, 110
    else:
        n = np.arange(len(words)) % 5 + 1
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["unit", "n"])
        run = lm.count_letter_contexts(Task(), SimpleNamespace(value=alphabet), 3)
        want, bound = 4 * sum(int(c) * (len(w) + 1) for w, c in zip(words, n)), 160
    tracemalloc.start()
    try:
        total, parts = 0, set()
        for b in run(iter([batch])):
            for part, counts in zip(b.column(0).to_pylist(), b.column(1)):
                key, n = lm.unpressed(counts.as_py())
                assert (key[1:] > key[:-1]).all() and (key >> np.uint64(61) == part).all()
                total += int(n.sum())
                parts.add(part)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert total == want and parts == set(range(8)) and peak < bound


def test_lm_dictionary_comes_from_full_counts(spark):
    r = random.Random(3)
    rows = [(" ".join([f"common{i % 200}" for i in range(k, k + 190)] + [f"x{r.random()}" for _ in range(50)]).encode(),) for k in range(0, 4000, 7)]
    want = Counter(u for (t,) in rows for u in plain_units(t))
    train = spark.createDataFrame(rows, "data binary").repartition(8)
    counted = lm.count_units(train).cache()
    assert {bytes(u): n for u, n in counted.collect()} == want
    units = lm.make_alphabet(counted).values.to_pylist()
    assert {u for u in units if u is not None} == {u for u, n in want.items() if n > 1}
    weights = [len(want) if u is None else want[u] for u in units]
    assert weights == sorted(weights, reverse=True) or sum(1 for u in units if u is None) == 1
