"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed text.

Model: for each language the frequencies of hashed byte n-grams (with word bounds) and of scripts, counted by
Spark over a bounded sample of the labelled rows (:data:`SAMPLE` documents a language are expected, whole texts, drawn by a hash
threshold). Its size is bounded: 4 x 65,536 numbers and one for each script, for each language. It is
broadcast to the tasks.

Labelling: each distinct word of a batch is scored once. A word's script leaves those languages that use it;
its n-grams score them. The best path through all words of the text, with a penalty for each switch, gives
spans; the document's language is the one with most characters, its score that share. Texts are walked together, in the order of
their length, so each step of the recurrence serves many of them.

Edge cases: a null text, or one without a letter, gets ``und``, score 0 and no spans; words without letters
take no side; a script that no language was seen in leaves all; ties go to the first language by name;
rows without a label teach nothing; with no labelled row at all every text is ``und``; repeated rows are
labelled alike; an empty table gives an empty result; a very long text is worked on alone, in a step for each word that keeps some bytes for it (about 500 bytes a word);
columns of the input are kept, the result being one struct column.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, unused

#: Where ranges of scripts begin (fixed values of the Unicode standard); a range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
    (0x323B0, "Other"),
)
_STARTS = [s for s, _ in SCRIPTS]
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = [_NAMES.index(n) for _, n in SCRIPTS]

ORDERS = (2, 3, 4, 5)
SLOTS = 1 << 16
WIDTH = len(ORDERS) * SLOTS + len(_NAMES)
SAMPLE = 4000
PENALTY = 10.0
#: A language uses a script if at least this share of its words is written in it.
SCRIPT_SHARE = 0.001
OUT_OF_SCRIPT = -60.0
#: Distinct words whose scores a task keeps.
CACHE = 120_000
#: Words that are walked through at a time.
BLOCK = 150_000
#: Texts that are taken out of a batch at a time.
SLICE = 1000

FIELDS = "lang string, score double, spans array<struct<start:int,end:int,lang:string>>"


def script_of(word: str) -> int:
    """The number of the script of a word's first letter, -1 without a letter."""
    for c in word:
        if c.isalpha():
            return _SCRIPT_OF[bisect_right(_STARTS, ord(c)) - 1]
    return -1


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, number of the word) of each n-gram of each word, word bounds as spaces."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8"), np.uint8)
    space = data == 32
    upto = np.cumsum(space)
    wide = data.astype(np.uint64)
    slots, owners, code = [], [], wide
    for o in range(2, ORDERS[-1] + 1):
        n = len(data) - o + 1
        if n <= 0:
            break
        code = code[:n] | (wide[o - 1 :] << np.uint64(8 * (o - 1)))
        inner = upto[o - 2 : o - 2 + n] - upto[:n]  # spaces inside, the ends left out
        ok = np.flatnonzero(inner == 0)
        h = (code[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        slots.append(h.astype(np.int64) + (o - 2) * SLOTS)
        owners.append(upto[ok] - 1)
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot, owner = np.concatenate(slots), np.concatenate(owners)
    ok = owner < len(words)  # not what the last space begins
    return slot[ok], owner[ok]


def text_words(text: str) -> list[str]:
    return text.lower().split()


def counted(texts) -> np.ndarray:
    """How often each n-gram slot and each script occurs in the texts."""
    out, number, often = np.zeros(WIDTH), {}, []

    def flush():
        words = list(number)
        if words:
            slot, owner = word_grams(words)
            weight = np.array(often, float)
            np.add(out, np.bincount(slot, weight[owner], WIDTH), out=out)
            for w, c in zip(words, often):
                if (s := script_of(w)) >= 0:
                    out[len(ORDERS) * SLOTS + s] += c
        number.clear()
        often.clear()

    for text in texts:
        for w in text_words(text):
            k = number.setdefault(w, len(number))
            if k == len(often):
                often.append(0)
            often[k] += 1
        if len(number) > CACHE:
            flush()
    flush()
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: languages x WIDTH."""
        self.langs = langs
        if not langs:
            return
        grams = counts[:, : len(ORDERS) * SLOTS].reshape(len(langs), len(ORDERS), SLOTS)
        p = np.log((grams + 0.5) / (grams.sum(2, keepdims=True) + 0.5 * SLOTS))
        p -= p.mean(0, keepdims=True)
        p[:, grams.sum(0) == 0] = 0
        self.weights = np.ascontiguousarray(p.reshape(len(langs), -1).T, np.float32) / len(ORDERS)
        scripts = counts[:, len(ORDERS) * SLOTS :]
        uses = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))
        self.bar = np.where(uses | ~uses.any(0), 0, OUT_OF_SCRIPT).T.astype(np.float32)  # script x language

    def score(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        slot, owner = word_grams(words)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.weights[slot, k], len(words))
        scripts = np.array([script_of(w) for w in words])
        out[scripts < 0] = 0
        return out + np.where((scripts >= 0)[:, None], self.bar[scripts], 0)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. ``scores``: the words of one text after another; ``lengths``: descending."""
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n_texts, n_langs = len(lengths), scores.shape[1]
    steps = int(lengths[0])
    active = n_texts - np.searchsorted(lengths[::-1], np.arange(steps), "right")  # texts longer than t
    value = scores[begin].copy()
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(1, steps):
        v = value[: active[t]]
        top = v.argmax(1)
        jump = v[np.arange(len(v)), top] - penalty
        stay = v >= jump[:, None]
        back.append((stay, top))
        value[: active[t]] = np.where(stay, v, jump[:, None]) + scores[begin[: active[t]] + t]
    label = np.empty(len(scores), np.int32)
    now = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        label[begin[:a] + t] = now[:a]
        if t:
            stay, top = back[t - 1]
            rows = np.arange(a)
            now[:a] = np.where(stay[rows, now[:a]], now[:a], top)
    return label


class Labeller:
    """Labels texts; keeps the scores of up to CACHE distinct words."""

    def __init__(self, model: Model, penalty: float, with_spans: bool):
        self.model, self.penalty, self.with_spans = model, penalty, with_spans
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)

    def ids(self, texts: list[list[str]]) -> np.ndarray:
        total = sum(map(len, texts))
        known = len(self.scores)
        if known > CACHE:
            self.row, self.scores, known = {}, self.scores[:0], 0
        row = self.row
        out = np.fromiter((row.setdefault(w, len(row)) for ws in texts for w in ws), np.int64, total)
        if len(row) > known:
            fresh = list(row)[known:]
            self.scores = np.concatenate([self.scores, self.model.score(fresh)])
        return out

    def block(self, texts: list[str]) -> list[tuple]:
        """``texts``: with a letter each, by descending number of words."""
        words = [text_words(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
        words = [words[i] for i in order]
        lengths = np.array([len(w) for w in words])
        ids = self.ids(words)
        label = viterbi(self.scores[ids], lengths, self.penalty)
        out: list[tuple] = [()] * len(texts)
        at = 0
        for i, ws in zip(order, words):
            own = label[at : at + len(ws)]
            at += len(ws)
            share = np.bincount(own, [len(w) for w in ws], len(self.model.langs))
            best = int(share.argmax())
            out[i] = (self.model.langs[best], float(share[best] / share.sum()), self.spans(texts[i], own) if self.with_spans else [])
        return out

    def spans(self, text: str, own: np.ndarray) -> list[dict]:
        places = [m.span() for m in re.finditer(r"\S+", text)]
        if len(places) != len(own):  # lower case has changed where words end
            places = [(k, k + 1) for k in range(len(own))]
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        return [{"start": places[a][0], "end": places[b - 1][1], "lang": self.model.langs[own[a]]} for a, b in zip(cuts, cuts[1:])]

    def label(self, texts: list[str | None]) -> list[tuple]:
        out: list[tuple] = [("und", 0.0, [])] * len(texts)
        if not self.model.langs:
            return out
        todo = [i for i, t in enumerate(texts) if t and any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", t))]
        todo.sort(key=lambda i: -len(texts[i]))
        at = 0
        while at < len(todo):
            part, size = [], 0
            while at < len(todo) and (not part or size + len(texts[todo[at]]) // 6 <= BLOCK):
                size += len(texts[todo[at]]) // 6
                part.append(todo[at])
                at += 1
            for i, got in zip(part, self.block([texts[i] for i in part])):
                out[i] = got
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the rows of ``docs`` that have a text and a language.

    ``sample`` rows a language are expected (a bound on what is read for the fit, not on what is labelled).
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, WIDTH)))
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col(lang) == name, min(1.0, sample / sizes[name])).otherwise(share)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), key, text), 11) * F.lit(2.0**-53)
    chosen = rows.where(drawn < share).select(lang, text).repartition(max(2, 2 * len(langs)))

    def count(batches):
        held_texts: dict[str, list[str]] = {}
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held_texts.setdefault(name, []).append(t)
            for name, texts in held_texts.items():
                sums[name] = sums.get(name, 0) + counted(texts)
            held_texts = {}
        for name, c in sums.items():
            slot = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot, pa.int32()), pa.array(c[slot])], names=["lang", "slot", "n"])

    got = chosen.mapInArrow(count, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # WIDTH rows a language at most
    counts = np.zeros((len(langs), WIDTH))
    counts[np.searchsorted(langs, got["lang"].to_numpy(str)), got["slot"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts)


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "language", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """``df`` with the struct column ``out`` (``_out`` if that name is taken): lang, score and, with ``spans``, the labelled stretches."""
    return df.withColumn(unused(df, out)[0], labels(df, model, F.col(f"`{text}`"), penalty, spans))


def labels(df: DataFrame, model: Model, text: Column, penalty: float = PENALTY, spans: bool = True) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    @F.arrow_udf(FIELDS)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Labeller(sent.value, penalty, spans)
        for texts in batches:
            got = [x for at in range(0, len(texts), SLICE) for x in own.label(texts.slice(at, SLICE).to_pylist())]
            lang, score, found = zip(*got) if got else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, kind)], names=["lang", "score", "spans"])

    return label(text)


def identify_documents(docs: DataFrame, **args) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from rows that are not held out (crc32 of the id mod 4 is 2)."""
    out_of = held(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out_of), **args)
    got = docs.select("doc_id", out_of.alias("held_out"), labels(docs, model, F.col("text"), spans=False).alias("language"))
    return got.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def keep_identified(docs: DataFrame, text: str = "text", least: float = 0.5, **args) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least the share ``least`` of its characters.

    The model is learned from the rows' own labels.
    """
    (out,) = unused(docs, "language")
    got = identify(docs, train(docs, text=text, **args), text, out, spans=False)
    return got.where((F.col(f"{out}.lang") != "und") & (F.col(f"{out}.score") >= least)).drop(out)
