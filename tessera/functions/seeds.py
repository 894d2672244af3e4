"""Seeds: contiguous or spaced masks, windows of a sequence, and strand-independent codes, as column expressions and in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.hashing import mix64

#: Published masks (fixed values): weight 29 span 33, weight 25, weight 31.
SPACED_29_33 = "######_#######_###_#######_######"
CONTIGUOUS_25 = "#" * 25
CONTIGUOUS_31 = "#" * 31

#: Letters whose code, by (byte >> 1) & 7, is a base: the lenient alphabet maps them, the strict one takes ACGTU.
_LENIENT = "".join(c for c in map(chr, range(65, 91)) if (ord(c) >> 1) & 7 <= 3)
_LENIENT_CODES = "".join(str((ord(c) >> 1) & 7) for c in _LENIENT)


@dataclass(frozen=True)
class Seed:
    """A mask of significant (``#``) and ignored (``_``) places."""

    mask: str

    def __post_init__(self):
        if not self.mask or set(self.mask) - {"#", "_"} or self.mask[0] != "#" or self.mask[-1] != "#":
            raise ValueError("a mask consists of # and _ and begins and ends with #")
        if self.mask != self.mask[::-1]:
            raise ValueError("the mask must be symmetric, else a seed and its reverse complement take other places")
        if self.weight > 32 or self.span > 64:
            raise ValueError("a seed has at most 32 significant places within 64")

    @property
    def weight(self) -> int:
        return self.mask.count("#")

    @property
    def span(self) -> int:
        return len(self.mask)

    @property
    def positions(self) -> list[int]:
        return [i for i, c in enumerate(self.mask) if c == "#"]

    @property
    def runs(self) -> list[tuple[int, int]]:
        """(start, length) of the stretches of significant places."""
        out: list[tuple[int, int]] = []
        for p in self.positions:
            if out and sum(out[-1]) == p:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((p, 1))
        return out


def base_codes(seq: Column, alphabet: str = "strict") -> Column:
    """The sequence with each base as its 2-bit code in text (A 0, C 1, T 2, G 3), other characters as ``.``."""
    up = F.upper(seq)
    if alphabet == "reference":
        coded = F.translate(up, _LENIENT + " @", _LENIENT_CODES + "00")
    elif alphabet == "strict":
        coded = F.translate(up, "ACTGU", "01232")
    else:
        raise ValueError("alphabet is 'strict' or 'reference'")
    # digits of the input itself are no bases
    return F.regexp_replace(F.when(seq.rlike("[0-9]"), coded_without_digits(up, alphabet)).otherwise(coded), "[^0-3]", ".")


def coded_without_digits(up: Column, alphabet: str) -> Column:
    clean = F.regexp_replace(up, "[0-9]", ".")
    if alphabet == "reference":
        return F.translate(clean, _LENIENT + " @", _LENIENT_CODES + "00")
    return F.translate(clean, "ACTGU", "01232")


def revcomp(seq: Column) -> Column:
    """The reverse complement of a sequence of bases; other characters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def revcomp_codes(codes: Column) -> Column:
    """The reverse complement in codes: complementing is XOR 2."""
    return F.reverse(F.translate(codes, "0123", "2301"))


def windows(text: Column, span: int) -> Column:
    """All windows of ``span`` characters, in order; an empty array for shorter texts.

    One pass with a lookahead, a code point at a time: ``substring`` at each place would walk the text from its start each time.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{span}}}))."), F.lit(1))


def gather(window: Column, seed: Seed) -> Column:
    """The significant characters of a window, first place first."""
    if seed.weight == seed.span:
        return window
    return F.concat(*(F.substring(window, a + 1, n) for a, n in seed.runs))


def canonical(codes: Column) -> Column:
    """The greater of a code text and its reverse complement: the same for both strands."""
    return F.greatest(codes, revcomp_codes(codes))


def code_number(codes: Column) -> Column:
    """A code text as a number, two bits a base (weights of up to 31; longer ones stay text)."""
    return F.conv(codes, 4, 10).cast("bigint")


def valid_window(window: Column) -> Column:
    """Whether all characters of a window of codes are bases."""
    return ~F.contains(window, F.lit("."))


def code_text(code: Column, weight: int) -> Column:
    """A number of two bits a base as its code text."""
    return F.lpad(F.conv(code.cast("string"), 10, 4), weight, "0")


# --- in Arrow batches ---------------------------------------------------------------------------------------

_U = np.uint64
#: Characters that are worked through together; longer records are gone through in pieces of this size.
PIECE = 1 << 20
#: Characters of short records that are laid end to end: their arrays stay in a processor's cache.
TOGETHER = 1 << 16


def base_table(alphabet: str) -> np.ndarray:
    """The code of each byte, 4 for what is no base."""
    lut = np.full(256, 4, np.uint8)
    for b in range(256):
        c = chr(b)
        if alphabet == "reference":
            lut[b] = (b >> 1) & 7 if (b >> 1) & 7 <= 3 and (c.isascii() and c.isalpha() or c in " @") else 4
        elif c in "ACGTUacgtu":
            lut[b] = (b >> 1) & 7
    return lut


def _stretch(known: dict[int, np.ndarray], size: int, backward: bool) -> np.ndarray:
    """Codes of the stretches of ``size`` bases, put together from halves; ``known``: those of other sizes. No closure, which would refer to itself and keep its arrays until such cycles are looked for."""
    if size not in known:
        a = 1 << ((size - 1).bit_length() - 1)
        first, rest = _stretch(known, a, backward), _stretch(known, size - a, backward)
        m = max(0, len(known[1]) - size + 1)
        high, low, width = (rest[a : a + m], first[:m], a) if backward else (first[:m], rest[a : a + m], size - a)
        known[size] = (high << _U(2 * width)) | low
    return known[size]


def _packed(wide: np.ndarray, seed: Seed, n: int, backward: bool) -> np.ndarray:
    """Codes of the ``n`` windows of bases, two bits each, the last place first if ``backward``: runs are put together from stretches."""
    known = {1: wide}
    out = np.zeros(n, _U)
    for p, size in reversed(seed.runs) if backward else seed.runs:
        if size < 32:
            out <<= _U(2 * size)
        out |= _stretch(known, size, backward)[p : p + n]
    return out


def codes_of(text: np.ndarray, seed: Seed, lut: np.ndarray, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of bytes (two bits a base), and which are valid."""
    code = lut[text]
    n = max(0, len(code) - seed.span + 1)
    wide = code.astype(_U)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    good = bad[seed.span :][:n] - bad[:n] == 0
    forward = _packed(wide, seed, n, False)
    if canonical:
        forward = np.maximum(forward, _packed(wide ^ _U(2), seed, n, True))
    return forward, good


def coded_windows(records: list[bytes], seed: Seed, lut: np.ndarray, canonical: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(record, place, code) of all valid windows, about PIECE at a time: short records are laid end to end, long ones cut."""
    at = 0
    while at < len(records):
        if len(records[at]) > PIECE:
            for p in range(0, len(records[at]) - seed.span + 1, PIECE):
                code, good = codes_of(np.frombuffer(records[at][p : p + PIECE + seed.span - 1], np.uint8), seed, lut, canonical)
                place = np.flatnonzero(good)
                yield np.full(len(place), at), p + place, code[place]
            at += 1
            continue
        end, size = at, 0
        while end < len(records) and (end == at or size + len(records[end]) <= TOGETHER):
            size += len(records[end])
            end += 1
        length = np.array([len(r) for r in records[at:end]], np.int64)
        begin = np.cumsum(length) - length
        code, good = codes_of(np.frombuffer(b"".join(records[at:end]), np.uint8), seed, lut, canonical)
        place = np.flatnonzero(good)
        row = np.searchsorted(begin + length, place, "right")  # empty records hold no place
        inside = place + seed.span <= (begin + length)[row]
        row, place = row[inside], place[inside]
        yield at + row, place - begin[row], code[place]
        at = end


#: Factors and offsets of the two prints of a text window.
_PRINTS = ((_U(0x100000001B3), _U(1)), (_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)))


def text_prints(points: np.ndarray, seed: Seed, which: int = 0, places: np.ndarray | None = None) -> np.ndarray:
    """Prints of 64 bits of the windows of code points at ``places`` (None: all): each mixed point times a power of a factor, summed up.

    Two windows are taken as equal if both of their prints are.
    """
    factor, offset = _PRINTS[which]
    wide = mix64(points.astype(_U) + offset)
    n = max(0, len(points) - seed.span + 1)
    out = np.zeros(n if places is None else len(places), _U)
    for p in seed.positions:
        out *= factor
        out += wide[p : p + n] if places is None else wide[places + p]
    return out
