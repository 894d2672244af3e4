"""Quality rules: zstandard ratios of whole documents and of fixed chunks, held in bands by length.

Repetitive text compresses far better than prose of its length, encoded or random text far worse. How well
prose compresses grows with its length, so the limits are a table by byte length. Each row is judged alone:
no shuffle, nothing kept between rows, and whole texts are read.

Edge cases: a null text counts as empty; texts shorter than the first band (and empty ones) have no limits on the ratio;
repeated rows are judged alike and all stay; an empty table gives an empty result; a very long text is compressed whole where it lies; columns of the input, also such with the names used here, are
kept, the verdict being one struct column under a name that the caller gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, unused


class Band(NamedTuple):
    """Texts of ``least`` bytes and more (up to the next band) keep a whole-text ratio of ``low`` to ``high``."""

    least: int
    low: float
    high: float


#: Ratios that prose of four languages keeps to, with some room on both sides.
BANDS = (
    Band(0, 0.0, float("inf")),
    Band(64, 0.70, 2.0),
    Band(128, 0.85, 2.15),
    Band(256, 1.10, 2.10),
    Band(512, 1.25, 2.15),
    Band(1024, 1.40, 2.22),
    Band(2048, 1.50, 2.32),
    Band(4096, 1.60, 2.42),
    Band(8192, 1.70, 2.52),
    Band(16384, 1.80, 2.58),
    Band(32768, 1.85, 2.65),
    Band(65536, 1.90, 2.80),
    Band(131072, 1.90, 3.20),
)
CHUNK = 2048
CHUNK_LOW, CHUNK_HIGH = 1.45, 2.45
#: Of all full chunks, the share that may lie outside the chunk limits.
CHUNK_SHARE = 0.25
LEVEL = 3

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_low long, n_high long, reason string, kept boolean"
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    a = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = len(seen)
    if m < 1 << 20:
        key = (a[:-2] * m + a[1:-1]) * m + a[2:]
    else:
        _, pair = np.unique(a[:-1] * m + a[1:], return_inverse=True)
        key = pair[:-1] * m + a[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())


def base_counts(data: bytes, code_points: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), code_points - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words)


def judge(data: bytes, bands: Sequence[Band], squeeze, chunk: int = CHUNK, chunk_low: float = CHUNK_LOW, chunk_high: float = CHUNK_HIGH, share: float = CHUNK_SHARE):
    """ratio, n_chunks, n_low, n_high and the reason to reject (None: keep). Only full chunks are judged."""
    n = len(data)
    if not n:
        return None, 0, 0, 0, None
    ratio = n / len(squeeze(data))
    low, high = next((b.low, b.high) for b in reversed(bands) if n >= b.least)
    chunks = n // chunk
    n_low = n_high = 0
    for k in range(chunks):
        r = chunk / len(squeeze(data[k * chunk : (k + 1) * chunk]))
        n_low += r < chunk_low
        n_high += r > chunk_high
    reason = "repetitive" if ratio > high else "incompressible" if ratio < low else None
    if reason is None and chunks:
        reason = "repetitive chunks" if n_high > share * chunks else "incompressible chunks" if n_low > share * chunks else None
    return ratio, chunks, n_low, n_high, reason


def compression_bands(text: Column, bands: Sequence[Band] = BANDS, chunk: int = CHUNK, chunk_low: float = CHUNK_LOW, chunk_high: float = CHUNK_HIGH, chunk_share: float = CHUNK_SHARE, min_words: int = 50, max_repeat: int = 50, level: int = LEVEL) -> Column:
    """A struct of :data:`FIELDS` for each text.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat`` per cent of the words in repeated
    3-word windows. ``kept``: not base_failed, and the ratios are within their bands.
    """
    bands = tuple(sorted(bands))

    @F.arrow_udf(FIELDS)
    def judged(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=level).compress
        rows = []
        for text in texts:
            s = text.as_py() or ""
            data = s.encode("utf-8")
            base = base_counts(data, len(s))
            failed = base[0] < min_words or 100 * base[4] > max_repeat * base[0]
            found = judge(data, bands, squeeze, chunk, chunk_low, chunk_high, chunk_share)
            rows.append((*base, failed, *found, not failed and found[-1] is None))
        cols = list(zip(*rows)) or [()] * 12
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()] + [pa.int64()] * 3 + [pa.string(), pa.bool_()]
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return judged(text)


def quality(df: DataFrame, text: str = "text", out: str = "quality", **limits) -> DataFrame:
    """``df`` with the struct column ``out`` (``_out`` if that name is taken; see :func:`compression_bands`)."""
    return df.withColumn(unused(df, out)[0], compression_bands(F.col(f"`{text}`"), **limits))
