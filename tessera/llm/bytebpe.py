"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches, from a file of ranks.

The library works on text, ranks are of bytes: each byte stands as a character of its own (the usual map, in which printable bytes are themselves and
the others follow from U+0100 on). A rank file names no merges; a token's merge is the pair of parts in which merging its bytes by lower ranks ends, and with
these pairs the library's merges are those of a lookup by rank: whatever tokens a stretch of text has gone through, they are those of the stretch alone.
The pattern's classes (letters, numbers, white space) are written out as the ranges that the ranks' own library has, so the tables of the two libraries' pattern
engines can't part.

No match of the pattern goes on from a character that is no white space to one that is. Texts are cut there, by an Arrow kernel; a slice's different chunks are
encoded once, and those of the last CACHE chunks are kept. A text's tokens are its chunks' tokens in a row.

Decoding reverses the byte map. A character that is split over tokens is whole again in the bytes; :func:`spans` gives each of its tokens the place of the
character, :func:`decoded` puts U+FFFD only for bytes that make no character in the whole list.

Edge cases: null and empty texts have no tokens; repeated rows are encoded alike; a very long text is worked on alone, in chunks, and one without white space as
a single chunk; an empty table gives an empty result; the input's columns are kept and new ones get free names; null lists of ids decode to null, null or unknown ids in a list to no bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, unused

#: Chunks whose tokens a task keeps, and the longest of them in characters.
CACHE, KEPT = 400_000, 64
#: Bytes of texts that a task works on together.
SLICE = 1 << 22
#: Bytes that are shown as themselves (fixed values).
SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_characters() -> list[str]:
    """The character that each byte is shown as."""
    others = iter(range(256, 512))
    shown = set(SHOWN)
    return [chr(b if b in shown else next(others)) for b in range(256)]


def parts_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging a token's bytes comes to when only ranks below its own count."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while True:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@functools.lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Letters, numbers and white space as ranges for a pattern, as the ranks' library knows them."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        only = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        points = np.array(list(map(ord, bytes(only.encode_ordinary(every)).decode("utf-8"))))  # what does not match is left out
        cuts = np.flatnonzero(np.diff(points) > 1)
        first, last = points[np.append(0, cuts + 1)], points[np.append(cuts, len(points) - 1)]
        out[name] = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first.tolist(), last.tolist()))
    return out


def spelled_out(pattern: str) -> str:
    """A pattern with its classes as ranges, within and outside brackets."""
    ranges, out, inside = classes(), [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.DOTALL):
        own = ranges.get(part, ranges["\\s"] if part == "\\S" else None)
        if own is None:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
        elif part == "\\S":
            if inside:
                raise ValueError("\\S within brackets is not supported")
            out.append(f"[^{own}]")
        else:
            out.append(own if inside else f"[{own}]")
    return "".join(out)


class Vocabulary:
    """The library's tokenizer of a rank file, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        show = byte_characters()
        text = {t: "".join(map(show.__getitem__, t)) for t in ranks}
        pairs = []
        for token in sorted(ranks, key=ranks.get):
            if len(token) > 1:
                parts = parts_below(token, ranks)
                if len(parts) != 2:
                    raise ValueError(f"{path}: the token {token!r} is not merged from two")
                pairs.append((text[parts[0]], text[parts[1]]))
        self.library = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=pairs))
        matches = pre_tokenizers.Split(Regex(spelled_out(pattern)), "isolated")
        self.library.pre_tokenizer = pre_tokenizers.Sequence([matches, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the way back, by what the library calls its ids
        byte = {c: b for b, c in enumerate(show)}
        self.bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in self.library.get_vocab().items()}
        white = classes()["\\s"]
        self.edge = f"([^{white}])([ \n\t\r])"
        self.edges = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), f"(?<=[^{white}])(?=[ \n\t\r])"))

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts (null: empty) that no match goes beyond, and where each text's begin (and all end)."""
        texts = pc.fill_null(texts, "")
        holds = pc.match_substring(texts, "\0")
        if pc.any(holds).as_py():  # the mark itself stands in a text
            lists = pa.array([self.edges.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pc.replace_substring_regex(texts, self.edge, "\\1\0\\2"), "\0")
        every = lists.flatten()
        there = pc.not_equal(pc.binary_length(every), 0)
        begin = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
        return every.filter(there), begin[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path, pattern or public_tokenizers.PATTERN)


class Encoder:
    """Chunks to what ``form`` makes of the library's result (without its offsets, unless ``offsets``); keeps those of the last CACHE chunks."""

    def __init__(self, vocab: Vocabulary, form: Callable[..., tuple], offsets: bool = False):
        self.vocab, self.form, self.known = vocab, form, {}
        self.batch = vocab.library.encode_batch if offsets else vocab.library.encode_batch_fast

    def encode(self, texts: pa.Array) -> tuple[list[tuple], np.ndarray, np.ndarray, pa.Array]:
        """The forms of the distinct chunks, which of them the texts' chunks are, where each text's begin (and all end), and the distinct chunks."""
        flat, begin = self.vocab.chunks(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = [c for c in distinct if c not in self.known]
        made: dict[str, tuple] = {}
        for at in range(0, len(fresh), 16_384):
            some = fresh[at : at + 16_384]
            made.update(zip(some, map(self.form, self.batch(some, add_special_tokens=False))))
        forms = [made[c] if c in made else self.known[c] for c in distinct]
        self.known.update((c, f) for c, f in made.items() if len(c) <= KEPT)
        return forms, coded.indices.to_numpy(), begin, coded.dictionary


def joined(values: list[bytes], which: np.ndarray, begin: np.ndarray, between: bytes) -> list[bytes]:
    """Each text's values in a row."""
    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, pa.binary()).take(pa.array(which)))
    return pc.binary_join(lists, pa.scalar(between, pa.binary())).to_pylist()


FIELDS = "n_tokens long, ids array<int>, starts array<int>, ends array<int>"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(text: Column, ranks: str) -> Column:
    """A struct of :data:`FIELDS` of each text: ids, and the characters of the text from start to end that each token stands for, or a part of."""

    @F.arrow_udf(FIELDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(vocabulary(ranks), lambda e: (e.ids, e.offsets), offsets=True)
        for batch in batches:
            rows = []
            for b in slices(pa.record_batch([batch], ["text"]), size=SLICE):
                forms, which, begin, distinct = own.encode(b.column(0))
                size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
                for a, e in zip(begin.tolist(), begin[1:].tolist()):
                    chunks = which[a:e]
                    at = np.cumsum(size[chunks]) - size[chunks]
                    ids = [i for c in chunks.tolist() for i in forms[c][0]]
                    places = [(s + x, s + y) for c, s in zip(chunks.tolist(), at.tolist()) for x, y in forms[c][1]]
                    rows.append((len(ids), ids, [x for x, _ in places], [y for _, y in places]))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), *[pa.list_(pa.int32())] * 3]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["n_tokens", "ids", "starts", "ends"])

    return run(text)


def bytes_of(ids: list[int | None], vocab: Vocabulary) -> bytes:
    return b"".join([vocab.bytes.get(i, b"") for i in ids])


def spans(ids: list[int], vocab: Vocabulary) -> list[tuple[int, int]]:
    """The characters (from, to) that each id stands for, or a part of, told from the bytes alone; these must be those of a text."""
    tokens = [vocab.bytes.get(i, b"") for i in ids]
    begins = (np.frombuffer(b"".join(tokens), np.uint8) & 0xC0) != 0x80  # of a character
    before = np.concatenate([[0], np.cumsum(begins)])
    end = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    start = end - np.array([len(t) for t in tokens], np.int64)
    inside = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in tokens], bool)
    return list(zip((before[start] - inside).tolist(), before[end].tolist())) if tokens else []


def decoded_bytes(ids: Column, ranks: str) -> Column:
    """The bytes that each list of ids stands for."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(ranks)
        for lists in batches:
            yield pa.array([None if x is None else bytes_of(x, vocab) for x in lists.to_pylist()], pa.binary())

    return run(ids)


def decoded(ids: Column, ranks: str) -> Column:
    """The text that each list of ids stands for; U+FFFD for bytes that make no character."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(ranks)
        for lists in batches:
            yield pa.array([None if x is None else bytes_of(x, vocab).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return run(ids)


def digests(text: Column, ranks: str) -> Column:
    """A struct of :data:`DIGESTS`: checksums of each text's ids and of the bytes that they decode to, as neither is returned."""

    @F.arrow_udf(DIGESTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(ranks)
        number = [str(i).encode() for i in range(max(vocab.bytes) + 1)]
        shown = [vocab.bytes.get(i, b"") for i in range(len(number))]

        def form(e) -> tuple[int, bytes, bytes]:
            ids = e.ids
            return len(ids), b" ".join([number[i] for i in ids]), b"".join([shown[i] for i in ids])

        own = Encoder(vocab, form)
        for batch in batches:
            rows: list[tuple] = []
            for b in slices(pa.record_batch([batch], ["text"]), size=SLICE):
                forms, which, begin, _ = own.encode(b.column(0))
                n = np.array([f[0] for f in forms], np.int64)
                counts = np.diff(np.concatenate([[0], np.cumsum(n[which])])[begin])
                sums = ([hashlib.sha256(x).hexdigest() for x in joined([f[k] for f in forms], which, begin, between)] for k, between in ((1, b" "), (2, b"")))
                rows += zip(counts.tolist(), *sums)
            cols = list(zip(*rows)) or [()] * 3
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode(df: DataFrame, ranks: str, text: str = "text", out: str = "encoded") -> DataFrame:
    """``df`` with the struct column ``out`` (``_out`` if that name is taken)."""
    return df.withColumn(unused(df, out)[0], encoded(F.col(f"`{text}`"), ranks))


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return docs.select("doc_id", digests(F.col("text"), ranks).alias("e")).select("doc_id", "e.*")
