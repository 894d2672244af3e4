"""BPE encoding and decoding by a minimal acyclic transducer lexicon.

The corpus' frequent words are compiled into a minimal acyclic automaton (states with equal futures are one,
so suffixes are shared). Arcs carry weights whose sum along a word is the word's number; the numbers index the words'
token ids. The arrays lie in one file in the shared folder, which Spark hands to each machine and tasks map into memory.
A batch's new words walk through the arcs together; words that are not in the lexicon are merged exactly.

Words: the vocabulary's rules never join text across white space, so texts are cut there first. Texts whose
characters all rules treat alike (:data:`PLAIN`) are cut and lower-cased by Arrow's kernels; words that are not known are then cut by the vocabulary's pattern.
Others, and texts that hold special tokens, are cut by the tokenizer file's own normaliser and splitter; these pieces (marked :data:`PIECE`) are not cut again,
as the library's tables of characters are older than those of the pattern's module here.

Edge cases: null and empty texts have no tokens; repeated rows are encoded alike; words of any length are merged
(with a heap, in n log n), those of more than 64 characters are left out of the lexicon and always merged; words of equal counts at the edge of the lexicon are all left out;
an empty table gives an empty lexicon and result; a very long text is worked on alone; columns of the input are kept, the result being
one struct column; null ids decode to null.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, slices, unused
from tessera.sources.shared import shared_dir

#: Frequent words that are compiled.
LEXICON = 65_536
#: Words whose tokens a task keeps.
CACHE = 200_000
#: Characters that the library's and Python's rules (white space, letters, lower case, composition) treat alike.
PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ]*")
#: Marks of pieces that are cut already, and of ids of special tokens.
PIECE, SPECIAL = "\0", "\1"
#: Bytes of texts that a task works on together, and words that it counts at a time.
SLICE = 1 << 22
COUNTED = 600_000
NONE = 1 << 62


# --- the automaton -----------------------------------------------------------------------------------------


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of sorted distinct words; a word's number is its place in the list."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, state), ...)) of finished states

    def finish(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # unfinished states of the last word: [final, arcs]
    last = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        while len(path) > same + 1:
            done = finish(*path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = finish(*path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = finish(*path.pop())

    below = [0] * len(states)  # words from here on; targets are finished before their sources
    key, target, weight = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for label, t in arcs:
            key.append(s << 8 | label)
            target.append(t)
            weight.append(n)
            n += below[t]
        below[s] = n
    return {"key": np.array(key, np.int64), "target": np.array(target, np.int32), "weight": np.array(weight, np.int32), "final": np.array([f for f, _ in states], np.uint8), "root": np.array([root], np.int64)}


def look_up(automaton, words: list[bytes]) -> np.ndarray:
    """The numbers of the words, -1 for such as are not in it; all words walk together, byte by byte."""
    out = np.full(len(words), -1, np.int64)
    if not len(automaton["key"]) or not words:
        return out
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8)
    alive = np.arange(len(words))
    state = np.full(len(words), automaton["root"][0], np.int64)
    number = np.zeros(len(words), np.int64)
    step = 0
    while len(alive):
        ended = length[alive] == step
        done = alive[ended]
        good = automaton["final"][state[ended]] == 1
        out[done[good]] = number[ended][good]
        alive, state, number = alive[~ended], state[~ended], number[~ended]
        want = state << 8 | data[begin[alive] + step]
        arc = np.searchsorted(automaton["key"], want)
        arc[arc == len(automaton["key"])] = 0
        on = automaton["key"][arc] == want
        alive, state, number = alive[on], automaton["target"][arc[on]].astype(np.int64), number[on] + automaton["weight"][arc[on]]
        step += 1
    return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One block: a line of JSON that says where each array lies, then the arrays."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        head[name] = [str(a.dtype), len(a), at]
        at += len(raw)
        parts.append(raw)
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + b"".join(parts)


@functools.lru_cache(maxsize=2)
def mapped(file: str) -> dict[str, np.ndarray]:
    """The arrays of such a block, mapped from the file."""
    with open(file, "rb") as f:
        line = f.readline()
    raw = np.memmap(file, np.uint8, "r", offset=len(line)) if len(line) < _size(file) else np.zeros(0, np.uint8)
    return {name: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in json.loads(line).items()}


def _size(file: str) -> int:
    with open(file, "rb") as f:
        return f.seek(0, 2)


# --- the vocabulary ----------------------------------------------------------------------------------------


class Vocabulary:
    """Merges, tokens and rules of a tokenizer file with byte-level BPE and word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = [ids[sign[b]] for b in range(256)]
        self.last = [ids[sign[b] + self.end] for b in range(256)]
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        own = Tokenizer.from_file(path)
        self.normal, self.split, self.back = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str, {c: b for b, c in sign.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece: the pair of least rank, the leftmost of equal ones, is merged until none is left."""
        s = [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]
        if len(s) > 100:
            return self._merge_long(s)
        get = self.merges.get
        pairs = [get(a << 20 | b, NONE) for a, b in zip(s, s[1:])]
        while pairs:
            m = min(pairs)
            if m == NONE:
                break
            i = pairs.index(m)
            s[i : i + 2] = [m & 0xFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = get(s[i - 1] << 20 | s[i], NONE)
            if i < len(pairs):
                pairs[i] = get(s[i] << 20 | s[i + 1], NONE)
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        get, n = self.merges.get, len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(s[i] << 20 | s[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j >= n or get(s[i] << 20 | s[j], NONE) != m:
                continue
            s[i], s[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := get(s[i] << 20 | s[after[j]], NONE)) != NONE:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := get(s[before[i]] << 20 | s[i], NONE)) != NONE:
                heapq.heappush(heap, (m, before[i]))
        return [t for t in s if t >= 0]

    def merged(self, word: str) -> list[int]:
        """The tokens of a lower-case word without white space, cut into pieces first."""
        return [t for piece in self.find(word) for t in self.merge(piece.encode("utf-8"))]

    def tokens_of(self, word: str) -> list[int]:
        """The tokens of a word or of what is marked."""
        if word[:1] == PIECE:
            return self.merge(word[1:].encode("utf-8"))
        return [int(word[1:])] if word[:1] == SPECIAL else self.merged(word)

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not (self.special_split and "<|" in text)

    def pieces(self, text: str) -> list[str]:
        """A text's pieces by the library's splitter, and its special tokens, marked."""
        out: list[str] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(f"{SPECIAL}{self.special[part]}")
            elif part:
                out += [PIECE + bytes(map(self.back.__getitem__, piece)).decode("utf-8") for piece, _ in self.split(self.normal(part))]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(texts: pa.Array, vocab: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words and marked pieces of texts, where each text's begin (and all end), and the places of these texts: plain ones come first."""
    listed = texts.to_pylist()
    plain = np.array([t is None or vocab.plain(t) for t in listed], bool)
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    low = pc.utf8_lower(pc.fill_null(texts.filter(pa.array(plain)), ""))
    for white in "\n\t\r":
        low = pc.replace_substring(low, white, " ")
    lists = pc.split_pattern(low, " ")
    every = lists.flatten()
    there = pc.not_equal(pc.binary_length(every), 0)
    begin = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
    rest = [vocab.pieces(listed[i]) for i in np.flatnonzero(~plain)]
    flat = pa.concat_arrays([every.filter(there), pa.array([w for r in rest for w in r], pa.string())])
    return flat, np.concatenate([begin, begin[-1] + np.cumsum([len(r) for r in rest], dtype=np.int64)]), order


class Encoder:
    """Words to tokens, by the lexicon or else by merging; keeps what ``form`` makes of the tokens of the last CACHE words."""

    def __init__(self, vocab: Vocabulary, lexicon: dict[str, np.ndarray], form: Callable[[list[int]], tuple]):
        self.vocab, self.lexicon, self.form = vocab, lexicon, form
        self.known: dict[str, tuple] = {}

    def of(self, distinct: list[str]) -> list[tuple]:
        """The forms of distinct words."""
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = [w for w in distinct if w not in self.known]
        numbers = look_up(self.lexicon, [w.encode("utf-8") for w in fresh]).tolist()
        ends, ids = self.lexicon["ends"], self.lexicon["ids"]
        for w, k in zip(fresh, numbers):
            self.known[w] = self.form(ids[ends[k] : ends[k + 1]].tolist() if k >= 0 else self.vocab.tokens_of(w))
        return [self.known[w] for w in distinct]

    def encode(self, texts: pa.Array) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """The forms of the distinct words of texts, which of them the texts' words are, where each text's begin (and all end), and the texts' places."""
        flat, begin, order = words(texts, self.vocab)
        encoded = flat.dictionary_encode()
        return self.of(encoded.dictionary.to_pylist()), encoded.indices.to_numpy(), begin, order


def joined(values: list[bytes], which: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """The values of each text, joined by spaces."""
    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, pa.binary()).take(pa.array(which)))
    return pc.binary_join(lists, pa.scalar(b" ", pa.binary())).to_pylist()


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """As the tokenizer file says: it has no decoder, so tokens are joined by spaces."""
    return " ".join([vocab.tokens[i] for i in ids])


# --- in Spark ----------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON) -> pa.Array:
    """The most frequent words (and marked pieces) of all texts, ``size`` of them at most: all above the least count that leaves so many."""

    def run(batches):
        vocab, kept, n = vocabulary(tokenizer), [], 0

        def out():
            rows = pa.concat_tables(kept).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            kept.clear()
            return rows.to_batches(max_chunksize=50_000)

        for batch in batches:
            for b in slices(batch, size=SLICE):
                encoded = words(b.column(0), vocab)[0].dictionary_encode()
                kept.append(pa.table({"word": encoded.dictionary, "n": np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary))}))
                n += len(encoded.dictionary)
                if n > COUNTED:
                    yield from out()
                    n = 0
        if kept:
            yield from out()

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    stored = Scratch(docs.sparkSession, "words")
    counts = stored.write(counts.where("n > 1 and length(word) <= 64"))
    total, cut = 0, 1
    for n, words_ in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):  # as many rows as different counts
        total += words_
        if total > size:
            cut = n
            break
    found = counts.where(F.col("n") > cut).select("word").toArrow()["word"]  # ``size`` words at most
    stored.drop(counts)
    return pa.concat_arrays(found.chunks).cast(pa.string()) if found.num_chunks else pa.array([], pa.string())


def build_lexicon(spark: SparkSession, of: pa.Array, tokenizer: str) -> str:
    """Compile the words and hand the file to all machines; returns the file's name there."""
    vocab = vocabulary(tokenizer)
    words_ = sorted(of.to_pylist(), key=lambda w: w.encode("utf-8"))
    arrays = compile_words([w.encode("utf-8") for w in words_])
    ids = [vocab.tokens_of(w) for w in words_]
    arrays["ends"] = np.cumsum([0, *map(len, ids)]).astype(np.int64)
    arrays["ids"] = np.array([t for x in ids for t in x], np.int32)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path, sc = f"{shared_dir(spark)}/tessera/{name}", spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(to_bytes(arrays)))
    stream.close()
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    sc.addFile(path)
    return name


FIELDS = "n_tokens long, ids array<int>"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(text: Column, tokenizer: str, lexicon: str) -> Column:
    """A struct of :data:`FIELDS` of each text."""

    @F.arrow_udf(FIELDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(vocabulary(tokenizer), mapped(SparkFiles.get(lexicon)), tuple)
        for batch in batches:
            out = []
            for b in slices(pa.record_batch([batch], ["text"]), size=SLICE):
                forms, which, begin, order = own.encode(b.column(0))
                rows = [None] * len(order)
                for place, a, e in zip(order.tolist(), begin, begin[1:]):
                    rows[place] = [t for w in which[a:e].tolist() for t in forms[w]]
                out += rows
            yield pa.StructArray.from_arrays([pa.array(map(len, out), pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["n_tokens", "ids"])

    return run(text)


def decoded(ids: Column, tokenizer: str) -> Column:
    """The text that each list of ids decodes to."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(tokenizer)
        for lists in batches:
            yield pa.array([None if x is None else decode_ids(vocab, x) for x in lists.to_pylist()], pa.string())

    return run(ids)


def digests(text: Column, tokenizer: str, lexicon: str) -> Column:
    """A struct of :data:`DIGESTS`: checksums of each text's ids and of what these decode to, as neither is returned."""

    @F.arrow_udf(DIGESTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(tokenizer)
        number, shown = [str(i).encode() for i in range(len(vocab.tokens))], [t.encode("utf-8") for t in vocab.tokens]

        def form(ids: list[int]) -> tuple[int, bytes, bytes]:
            return len(ids), b" ".join([number[i] for i in ids]), b" ".join([shown[i] for i in ids])

        own = Encoder(vocab, mapped(SparkFiles.get(lexicon)), form)
        for batch in batches:
            rows: list[tuple] = []
            for b in slices(pa.record_batch([batch], ["text"]), size=SLICE):
                forms, which, begin, order = own.encode(b.column(0))
                n = np.array([f[0] for f in forms], np.int64)
                if len(forms) and not n.all():  # words without tokens leave no space behind
                    on = n[which] > 0
                    begin, which = np.concatenate([[0], np.cumsum(on)])[begin], which[on]
                counts = np.diff(np.concatenate([[0], np.cumsum(n[which])])[begin]) if len(forms) else np.zeros(len(order), np.int64)
                digests_ = ([hashlib.sha256(x).hexdigest() for x in joined([f[k] for f in forms], which, begin)] for k in (1, 2))
                made = list(zip(counts.tolist(), *digests_))
                some = [None] * len(order)
                for place, row in zip(order.tolist(), made):
                    some[place] = row
                rows += some
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "encoded", lexicon: str | None = None) -> DataFrame:
    """``df`` with the struct column ``out`` (``_out`` if that name is taken); without a ``lexicon`` one is compiled from its own words."""
    lexicon = lexicon or build_lexicon(df.sparkSession, frequent_words(df, tokenizer, text), tokenizer)
    return df.withColumn(unused(df, out)[0], encoded(F.col(f"`{text}`"), tokenizer, lexicon))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    lexicon = build_lexicon(docs.sparkSession, frequent_words(docs, tokenizer), tokenizer)
    return docs.select("doc_id", digests(F.col("text"), tokenizer, lexicon).alias("e")).select("doc_id", "e.*")
