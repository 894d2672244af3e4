"""LM scoring by online logistic context mixing.

A text is a row of *units*: the bytes up to and with a white-space byte, the last one ended by a mark. The most frequent units
make a dictionary; each unit is coded as the bits of a prefix code over the dictionary and one escape, and a unit that is
escaped is then spelled: its bytes are coded as the bits of a prefix code over bytes. Every bit is
predicted from several hashed contexts (:data:`OF_UNITS`, :data:`OF_LETTERS`). Those of units reach across
white space: the unit before, its last two bytes, and the last of the most frequent units, however far back. Those of letters are the bytes
before in the unit: one, two, four of them, or all. A context's counts of zeros and ones give the logit
of its prediction; the logits are summed with weights that a gate chooses (how often three of the contexts were seen); weights are learned
online, bit by bit in small steps, each event being taken out of the counts while it is predicted. A refinement
table (by node and prediction) is adapted on the same stream and averaged in. A text's score is the sum of its bits' log10-probabilities: a
proper probability, as a text can be read back from its bits.

Counts cover all training rows: tasks count (context, symbol) pairs, others sum them up and turn them into counts of
nodes. A table has a row of 16 bytes for each four training units (letters of spelled units) at least, so it grows
with the corpus; in a row the nodes that were reached most often stay, and check bits tell strangers apart.
Tasks map the table into memory from the shared folder, which must be a path that they can open. Weights are learned on
all training texts and averaged over groups of them that a hash of the text makes, then they are fixed, so all documents are scored alike and rows stay independent.

``base_score`` is the unigram score of lower-cased words. Words of units out of the dictionary are looked up by a join; none of
them is common enough to crowd a task.

Edge cases: null and empty texts are one end mark and one end token; a very long text is worked on alone, as arrays of some bytes for each of its own; with no training rows (an empty table too) nothing is known and bits are even or follow the code; repeated rows count each time;
units of equal counts are ordered by their bytes, those at the edge of the dictionary are all out; null ids hash as the empty text; other columns are
not read; words, and symbols with all their contexts, are told apart by hashes of 64 bits, contexts by 46.
"""

from __future__ import annotations

import functools
import math
import os
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, held, slices

END = b"\xff"  # no byte of UTF-8
ENDS = list(b"\t\n\v\f\r" + END)
#: Units of the dictionary at most, with the escape; their numbers have SYMBOL_BITS bits.
SYMBOL_BITS = 18
DICTIONARY = (1 << SYMBOL_BITS) - 1
#: The contexts of units (each also has the one without a memory), and of letters (bytes before; None: all of the unit).
OF_UNITS = ("marker", "ending", "before")
OF_LETTERS = (1, 2, 4, None)
#: Units that count as markers: the most frequent ones.
MARKERS = 64
#: Weights are learned in groups of training texts with about so many units.
LEARNED = 500_000
STEP = 2048
#: Symbols whose bits are worked through together: their arrays fit in a processor's cache.
CHUNK = 6_000
#: Bytes of texts that a task works on together (a text at least), and units that it counts at a time.
SLICE = 1 << 22
CACHE = 600_000
#: Units that a task spells together: their letters share the beginnings of units.
SPELLED = 50_000
#: (context, symbol) numbers that wait in a task before they are summed.
COUNTED = 4_000_000
#: Bytes of units whose letters a task counts together (a unit at least).
LETTERS = 400_000
#: Bits whose nodes lie together in a row of a table: 2 ** ROW numbers, a head and the nodes.
ROW = 3
#: Counted symbols for each row of a table.
EVENTS = 4
#: A table's parts have 2 ** PART rows at most.
PART = 16

_U = np.uint64
_LOW = _U((1 << SYMBOL_BITS) - 1)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of texts (bytes), one text after another, and where each text begins (and all end); a space at the end of a unit is left out (see :func:`spelled`)."""
    marked = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.binary()), b""), pa.scalar(END), pa.scalar(b""))
    for white in ("\n", "\t", "\v", "\f", "\r"):
        if white == "\n" or pc.any(pc.match_substring(marked, white)).as_py():
            marked = pc.replace_substring(marked, white, white + " ")
    lists = pc.split_pattern(marked, " ")
    return lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)


def raw(of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, one after another, and where each begins (and all end)."""
    if not len(of):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begin = np.frombuffer(of.buffers()[1], np.int32)[of.offset : of.offset + len(of) + 1].astype(np.int64)
    data = np.frombuffer(of.buffers()[2], np.uint8)[begin[0] : begin[-1]] if of.buffers()[2] else np.zeros(0, np.uint8)
    return data, begin - begin[0]


def spelled(of: pa.Array) -> pa.Array:
    """Units with their last byte."""
    return pc.binary_join_element_wise(of, pc.if_else(pa.array(ended(of), pa.bool_()), pa.scalar(b""), pa.scalar(b" ")), pa.scalar(b""))


def ended(of: pa.Array) -> np.ndarray:
    """Which units have their last byte."""
    data, begin = raw(of)
    last = np.concatenate([data, [0]]).take(begin[1:] - 1)
    return (begin[1:] > begin[:-1]) & np.isin(last, ENDS)


def word_hashes(of: pa.Array) -> np.ndarray:
    """The hash of each unit's lower-cased word; 0 without a word."""
    words = of.to_pylist()
    for i in np.flatnonzero(ended(of)).tolist():
        words[i] = words[i][:-1]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.lower, words)), _U, len(words)).view(np.int64)
    h[h == 0] = 1
    h[np.fromiter(map(len, words), np.int64, len(words)) == 0] = 0
    return h


def endings(of: pa.Array) -> np.ndarray:
    """A number of each unit's last two bytes; 0 is for the start of a text."""
    data, begin = raw(of)
    size, padded = np.diff(begin), np.concatenate([np.zeros(2, np.uint8), data]).astype(np.int64)
    last, before = padded.take(begin[1:] + 1), padded.take(begin[1:])
    return 1 + np.where(size > 0, last + 1, 0) + 257 * np.where(size > 1, before + 1, 0)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _context(kind: int, value: np.ndarray) -> np.ndarray:
    """Numbers of contexts: 46 bits, then zeros for a symbol."""
    h = _spread(_spread(value + _U((kind + 1) * 0xA24BAED4963EE407 % (1 << 64))) * _U(0xD6E8FEB86659FD93))
    return h & ~_LOW


# --- the prefix code ---------------------------------------------------------------------------------------


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Huffman's lengths for weights in descending order, by two queues: leaves and sums come up in order."""
    n = len(weights)
    if n < 2:
        return np.zeros(n, np.int64)
    leaf, total = [int(w) for w in weights[::-1]], []
    up = [0] * (2 * n - 1)
    i = j = 0
    for k in range(n - 1):
        both = 0
        for _ in range(2):
            if i < n and (j >= len(total) or leaf[i] <= total[j]):
                both += leaf[i]
                up[i] = n + k
                i += 1
            else:
                both += total[j]
                up[n + j] = n + k
                j += 1
        total.append(both)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[up[k]] + 1
    return np.sort(np.array(depth[:n], np.int64))


class Code:
    """A canonical prefix code of symbols that are numbered from the most frequent one on, so codewords are in order.

    ``bits`` has, symbol by symbol (a symbol's begin at ``start``), what is known of each bit in one number: the bit, its place in its group of
    nodes, the row of the refinement, the group, and the logit without a context; and the hashed first node of each group (from ``first_group`` on).
    """

    def __init__(self, weights: np.ndarray):
        self.weights = np.asarray(weights, np.int64)
        self.length = code_lengths(self.weights)
        self.aligned = np.zeros(len(weights), _U)  # each codeword from the highest bit on
        if len(weights) > 1:
            np.cumsum((_U(1) << (_U(64) - self.length.astype(_U)))[:-1], out=self.aligned[1:])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.groups = -(-self.length // ROW)
        self.first_group = np.concatenate([[0], np.cumsum(self.groups)[:-1]])

    def save(self, path: str) -> Code:
        """Write what is known of the bits to two files that tasks map."""
        bits = self.laid_out()
        bits.facts.tofile(f"{path}.facts")
        bits.head.tofile(f"{path}.head")
        self.path = path
        return self

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "bits"}

    @functools.cached_property
    def bits(self) -> SimpleNamespace:
        if hasattr(self, "path") and os.path.getsize(f"{self.path}.facts"):
            return SimpleNamespace(facts=np.asarray(np.memmap(f"{self.path}.facts", np.int64, "r")), head=np.asarray(np.memmap(f"{self.path}.head", _U, "r")))
        return self.laid_out()

    def laid_out(self) -> SimpleNamespace:
        facts, head = np.zeros(int(self.length.sum()), np.int64), np.zeros(int(self.groups.sum()), _U)
        upto = np.concatenate([[0], np.cumsum(self.weights)]).astype(float)  # weights of symbols before
        for a in range(0, len(self.weights), 10_000):
            k = slice(a, a + 10_000)
            length = self.length[k]
            depth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            word, d = np.repeat(self.aligned[k], length), depth.astype(_U)
            bit = ((word >> (_U(63) - d)) & _U(1)).astype(np.int64)
            node = node_numbers(word, depth)
            low = np.where(depth == 0, _U(0), word & ~((_U(1) << ((_U(64) - d) & _U(63))) - _U(1)))  # of the node's codewords
            middle = low | _U(1) << (_U(63) - d)
            beyond = middle + ((_U(1) << (_U(63) - d)) - _U(1))  # the last one
            zeros, ones = (upto[np.searchsorted(self.aligned, x, side)] - upto[np.searchsorted(self.aligned, y)] for x, side, y in ((middle, "left", low), (beyond, "right", middle)))
            alone = np.log((ones + 0.2) / (zeros + 0.2)).astype(np.float32)
            deep = depth % ROW
            local = node_numbers(word << (depth - deep).astype(_U), deep).astype(np.int64)
            known = bit | local << 1 | np.where(depth < 8, node.astype(np.int64), 0) << 4 | (depth // ROW) << 12
            at, g = int(self.start[a]), int(self.first_group[a])
            facts[at : at + len(known)] = np.stack([known.astype(np.int32), alone.view(np.int32)], 1).ravel().view(np.int64)
            first = hashed_nodes(node[deep == 0])
            head[g : g + len(first)] = first
        return SimpleNamespace(facts=facts, head=head)


def node_numbers(word: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The inner node that a codeword passes at a depth: its bits so far behind a one."""
    d = np.asarray(depth).astype(_U)
    return (_U(1) << d) | np.where(d == 0, _U(0), word >> ((_U(64) - d) & _U(63)))


def hashed_nodes(number: np.ndarray) -> np.ndarray:
    return _spread(number * _U(0xD6E8FEB86659FD93))


# --- counts, packed ----------------------------------------------------------------------------------------

LEVELS = 5  # of how often a context was seen


def packed(n: np.ndarray) -> np.ndarray:
    """Counts in eight bits: up to 15 as they are, then in steps of an eighth of a power of two."""
    large = 16 + np.floor(8 * np.log2(np.maximum(n, 16) / 16))
    return np.where(n < 16, n, np.minimum(large, 255)).astype(np.uint32)


_BYTE = np.arange(256.0)
_COUNT = np.where(_BYTE < 16, _BYTE, 16 * 2 ** ((_BYTE - 15.5) / 8))
_N0, _N1 = np.repeat(_COUNT, 256), np.tile(_COUNT, 256)


def _logit(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.2) / (n0 + 0.2)).astype(np.float32)


def _level(n: np.ndarray) -> np.ndarray:
    return ((n > 0.5).astype(np.uint8) + (n > 1.5) + (n > 4.5) + (n > 30)).astype(np.uint8)


#: By packed counts: the logit and the level; the same without one event that was a zero, or a one.
LOGIT, LEVEL = _logit(_N0, _N1), _level(_N0 + _N1)
_A0, _A1 = np.concatenate([np.maximum(_N0 - 1, 0), _N0]), np.concatenate([_N1, np.maximum(_N1 - 1, 0)])
LEFT_OUT = _logit(_A0, _A1), _level(_A0 + _A1)  # at (the event << 16 | packed counts)


_WHOLE = np.complex128  # a row's 16 bytes, which are only moved


class Table:
    """Packed counts of the nodes in contexts. The nodes of three bits lie together in a row of eight numbers, which a hash of (context, first node) finds:
    the row's head (how often it was reached, and check bits), then zeros and ones of each node in eight bits each. Rows lie in parts by the context's
    first bits; the last row of all is empty.
    """

    def __init__(self, events: int):
        bits = max(12, math.ceil(math.log2(max(1, events / EVENTS))))
        self.part_bits = max(3, bits - PART)
        self.row_bits = bits - self.part_bits

    @property
    def size(self) -> int:
        """Of a part, in numbers."""
        return 1 << (self.row_bits + ROW)

    def places(self, context: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows within the part, and check bits."""
        h = (context ^ head) * _U(0xD6E8FEB86659FD93)
        return (h >> _U(64 - self.row_bits)).view(np.int64), ((h >> _U(56 - self.row_bits)) & _U(255)).astype(np.uint16)

    def fill(self, key: np.ndarray, n: np.ndarray, code: Code) -> np.ndarray:
        """One part from its distinct (context | symbol) numbers, which are in order, and their counts.

        Of the rows with one hash the one that was reached most often stays. Below a row that one event alone reached nothing is kept.
        """
        out = np.zeros((1 << self.row_bits, 1 << ROW), np.uint16)
        symbol = (key & _LOW).astype(np.int64)
        context, word, length = key & ~_LOW, code.aligned[symbol], code.length[symbol]
        groups, depth = [], 0
        while len(n):
            on = length > depth
            if not on.all():
                context, word, length, n = context[on], word[on], length[on], n[on]
            if not len(n):
                break
            node = node_numbers(word, depth)
            first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (node[1:] != node[:-1])]))
            row, check = self.places(context[first], hashed_nodes(node[first]))
            size = np.diff(first, append=len(n))
            head = packed(np.add.reduceat(n, first)).astype(np.uint16) << np.uint16(8) | check
            np.maximum.at(out[:, 0], row, head)
            groups.append((depth, context, word, length, n, row, head, size))
            on = np.repeat(size > 1, size) | (n > 1)
            context, word, length, n = context[on], word[on], length[on], n[on]
            depth += ROW
        for depth, context, word, length, n, row, head, size in groups:
            stays = out[row, 0] == head
            on = np.repeat(stays, size)
            row = np.repeat(row, size)[on]
            context, word, length, n = context[on], word[on], length[on], n[on]
            for d in range(ROW):
                on = length > depth + d
                row, context, word, length, n = row[on], context[on], word[on], length[on], n[on]
                if not len(n):
                    break
                local = node_numbers(word << _U(depth), d).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (local[1:] != local[:-1]) | (context[1:] != context[:-1])]))
                one = ((word >> _U(63 - depth - d)) & _U(1)).astype(np.int64)
                both, ones = np.add.reduceat(n, first), np.add.reduceat(n * one, first)
                out[row[first], local[first]] = packed(both - ones) << np.uint32(8) | packed(ones)
        return out

    def open(self, path: str | None) -> Table:
        """Map the parts, one after another in one file; None: nothing is known."""
        self.path = path
        self.rows = np.zeros((self.size << self.part_bits) + (1 << ROW), np.uint16) if path is None else np.asarray(np.memmap(path, "<u2", "r"))
        return self

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "rows"}

    def __setstate__(self, state):
        vars(self).update(state)
        if "path" in state:
            self.open(self.path)

    def take(self, context: np.ndarray, groups: np.ndarray, head: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Packed counts (zeros << 8 | ones) at each bit; 0 where nothing is known.

        ``groups``: how many each context has, ``head``: their first nodes; ``place`` of each bit: its group << ROW | its place there. Rows are fetched whole, once for all of their bits.
        """
        own = np.repeat(context, groups)
        row, check = self.places(own, head)
        own >>= _U(64 - self.part_bits)
        own <<= _U(self.row_bits)
        row += own.view(np.int64)
        found = self.rows.view(_WHOLE).take(row)
        nodes = found.view(np.uint16)
        found[nodes[:: 1 << ROW] & np.uint16(255) != check] = 0
        return nodes.take(place).astype(np.int64)


# --- mixing ------------------------------------------------------------------------------------------------

BINS = 33


def _scaled(z: np.ndarray) -> np.ndarray:
    """Where a logit lies among the refinement bins."""
    x = np.minimum(np.maximum(z, np.float32(-7.99)), np.float32(7.99))
    x *= np.float32(2)
    x += np.float32(16)
    return x


def _bins(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The refinement bin below a logit, and how far it is to the next."""
    x = _scaled(z)
    low = x.astype(np.int64)
    return low, x - low


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Mixer:
    """Weights by input and gate, and the refinement table by node and bin."""

    def __init__(self, inputs: int):
        self.weights = np.full((inputs, LEVELS**3), 0.3, np.float32)
        self.refine = np.tile(squash(np.arange(BINS, dtype=np.float32) / 2 - 8), (256, 1)).astype(np.float32)

    def mix(self, logits: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate), np.float32)
        for x, w in zip(logits, self.weights):
            own = w.take(gate)
            own *= x
            z += own
        np.maximum(z, np.float32(-14), out=z)
        return np.minimum(z, np.float32(14), out=z)

    def chance(self, logits: list[np.ndarray], gate: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The probability of a one."""
        z = self.mix(logits, gate)
        low, part = _bins(z)
        low += row * BINS
        table = self.refine.reshape(-1)
        fine = table.take(low)
        low += 1
        fine += (table.take(low) - fine) * part
        fine += squash(z)
        fine *= np.float32(0.5)
        return np.clip(fine, np.float32(1e-6), np.float32(1 - 1e-6), out=fine)

    def learn(self, logits: list[np.ndarray], gate: np.ndarray, row: np.ndarray, bit: np.ndarray, rate: float) -> None:
        """Online steps: bits are predicted, then weights and refinement move towards them (of the refinement only what the bits reach)."""
        bit, first, flat = bit.astype(float), row.astype(np.int64) * BINS, self.refine.reshape(-1)
        limited = [np.minimum(np.maximum(x, np.float32(-8)), np.float32(8)) for x in logits]
        for at in range(0, len(gate), STEP):
            k = slice(at, at + STEP)
            g, b = gate[k], bit[k]
            z = self.mix([x[k] for x in logits], g)
            error = (b - squash(z)) * np.float32(rate)
            for x, w in zip(limited, self.weights):
                w += np.bincount(g, error * x[k], LEVELS**3).astype(np.float32)
            at_bin = np.ceil(_scaled(z) - np.float32(0.5)).astype(np.int64)  # the nearest; of two the lower one
            at_bin += first[k]
            count = np.bincount(at_bin, minlength=flat.size)
            reached = np.flatnonzero(count > 0)
            count, old = count.take(reached), flat.take(reached)
            mean = np.bincount(at_bin, b, flat.size).take(reached) / count
            flat[reached] = old + (count / (count + 60) * (mean - old)).astype(np.float32)


class Layer:
    """Symbols of one code (units, or letters) with a table of their contexts and a mixer; the last three contexts make the gate."""

    def __init__(self, code: Code, table: Table, contexts: int, alone: bool):
        self.code, self.table, self.alone, self.mixer = code, table, alone, Mixer(contexts + alone)

    def bits(self, symbol: np.ndarray) -> SimpleNamespace:
        """The bits of symbols: where each symbol's begin (and where all end), what is known of them, and their groups (their number by symbol, first nodes, and the place of each bit in them)."""
        code = self.code
        size, groups = code.length.take(symbol), code.groups.take(symbol)
        begin, of_groups = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(groups)])
        at = np.repeat(code.start.take(symbol) - begin[:-1], size)
        at += np.arange(len(at))
        facts = code.bits.facts.take(at).view(np.int32)
        known, alone = np.ascontiguousarray(facts[::2]), facts[1::2].view(np.float32)
        group = np.repeat(code.first_group.take(symbol) - of_groups[:-1], groups)
        group += np.arange(len(group))
        place = np.repeat(of_groups[:-1] << ROW, size)
        place += (known >> 12 << ROW) | (known >> 1) & 7
        return SimpleNamespace(begin=begin, bit=known & 1, row=(known >> 4) & 255, alone=alone, groups=groups, head=code.bits.head.take(group), place=place)

    def inputs(self, contexts: list[np.ndarray], of: SimpleNamespace, leave_out: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits by input, and the gate; ``leave_out``: each event itself is taken out of the counts."""
        logits, gate = [], np.zeros(len(of.bit), np.uint8)
        logit, level = LEFT_OUT if leave_out else (LOGIT, LEVEL)
        event = of.bit.astype(np.int64) << 16
        for k, c in enumerate(contexts):
            seen = self.table.take(c, of.groups, of.head, of.place)
            if leave_out:
                seen |= event
            logits.append(logit.take(seen))
            if k >= len(contexts) - 3:
                gate *= np.uint8(LEVELS)
                gate += level.take(seen)
        if self.alone:
            logits.append(of.alone)
        return logits, gate.astype(np.int64)

    def score(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each symbol. What comes again in the same contexts is worked out once, in the order of the last context, as the table has it."""
        key = symbol.astype(_U)
        for c in contexts:
            key = _spread(key ^ c)
        key = key >> _U(8) | contexts[-1] & _U(0xFF << 56)
        order = np.argsort(key)
        key = key.take(order)
        begin = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        first, own = order.take(begin), np.zeros(len(begin))
        for a in range(0, len(first), CHUNK):
            k = first[a : a + CHUNK]
            of = self.bits(symbol.take(k))
            p = self.mixer.chance(*self.inputs([c.take(k) for c in contexts], of, False), of.row)
            p = np.log(np.abs((1 - of.bit).astype(np.float32) - p))
            own[a : a + CHUNK] = np.diff(np.concatenate([[0], np.cumsum(p, dtype=float)])[of.begin])
        out = np.zeros(len(symbol))
        out[order] = np.repeat(own / math.log(10), np.diff(begin, append=len(key)))
        return out

    def learn(self, symbol: np.ndarray, contexts: list[np.ndarray], rate: float) -> int:
        for a in range(0, len(symbol), CHUNK):
            k = slice(a, a + CHUNK)
            of = self.bits(symbol[k])
            self.mixer.learn(*self.inputs([c[k] for c in contexts], of, True), of.row, of.bit, rate)
        return len(symbol)


# --- units and letters as symbols --------------------------------------------------------------------------


class Alphabet:
    """The dictionary: units and the escape (null), from the most frequent one on; and the order of bytes."""

    def __init__(self, units: pa.Array, n: np.ndarray, others: int, letters: np.ndarray):
        rows = pa.table({"unit": pa.concat_arrays([units, pa.nulls(1, pa.binary())]), "n": np.append(n, others + 1).astype(np.int64)})
        rows = rows.take(pc.sort_indices(rows, [("n", "descending"), ("unit", "ascending")])).combine_chunks()
        self.values, self.weights = rows["unit"].chunk(0), rows["n"].to_numpy()
        self.escape = pc.index_in(pa.nulls(1, pa.binary()), value_set=self.values)[0].as_py()
        self.letter_order = np.argsort(-letters, kind="stable")
        self.letter_weights = letters[self.letter_order] + 1
        self.letter_rank = np.argsort(self.letter_order)

    @functools.cached_property
    def endings(self) -> np.ndarray:
        return endings(pc.fill_null(self.values, b""))

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "endings"}


def unit_contexts(symbol: np.ndarray, endings: np.ndarray, begin: np.ndarray, escape: int) -> list[np.ndarray]:
    """The contexts of the units of texts that lie one after another; ``endings``: of each unit, ``begin``: where texts begin."""
    n = len(symbol)
    before, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], end[1:] = symbol[:-1] + 1, endings[:-1]
    before[begin], end[begin] = 0, 0
    place = np.where((symbol < MARKERS) & (symbol != escape), np.arange(n), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(place)[:-1]]) if n else place
    start = np.zeros(n, np.int64)
    start[begin] = begin
    marker = np.where(last >= np.maximum.accumulate(start), symbol[last] + 1, 0)
    return [_context(k, v.astype(_U)) for k, v in enumerate((marker, end, before))]


def letter_contexts(of: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The letters of spelled units, their contexts, and where each unit begins (and all end)."""
    data, begin = raw(of)
    size = np.diff(begin)
    owner = np.repeat(np.arange(len(of)), size)
    place = np.arange(len(data)) - begin[owner]
    value = data.astype(_U) + _U(1)
    out, seen = [], np.zeros(len(data), _U)
    for k in range(1, 5):
        seen = seen << _U(9)
        own = np.zeros(len(data), _U)
        own[k:] = value[:-k] if len(data) > k else 0
        seen = seen | np.where(place >= k, own, _U(0))
        if k in OF_LETTERS:
            out.append(_context(10 + k, seen))
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x100000001B3, _U))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(value * powers[place])])
    prefix = sums[:-1] - sums[begin[owner]]
    out.append(_context(20, _spread(prefix + place.astype(_U))))
    return alphabet.letter_rank.take(data), out, begin


class Model:
    """All that scoring needs: the alphabet and the layers of units and letters."""

    def __init__(self, alphabet: Alphabet, unit_code: Code, unit_table: Table, letter_code: Code, letter_table: Table):
        self.alphabet = alphabet
        self.of_units = Layer(unit_code, unit_table, len(OF_UNITS), True)
        self.of_letters = Layer(letter_code, letter_table, len(OF_LETTERS), False)

    def unlearned(self) -> Model:
        """The same counts with weights as they are at first."""
        return Model(self.alphabet, self.of_units.code, self.of_units.table, self.of_letters.code, self.of_letters.table)

    def state(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for y in (self.of_units, self.of_letters) for x in (y.mixer.weights, y.mixer.refine)])

    def set_state(self, flat: np.ndarray) -> None:
        at = 0
        for y in (self.of_units, self.of_letters):
            for name in ("weights", "refine"):
                old = getattr(y.mixer, name)
                setattr(y.mixer, name, flat[at : at + old.size].astype(np.float32).reshape(old.shape))
                at += old.size

    def spell(self, of: pa.Array) -> np.ndarray:
        """log10 of the probability of the letters of each unit."""
        out = np.zeros(len(of))
        for a in range(0, len(of), SPELLED):
            symbol, contexts, begin = letter_contexts(spelled(of.slice(a, SPELLED)), self.alphabet)
            out[a : a + SPELLED] = np.diff(np.concatenate([[0], np.cumsum(self.of_letters.score(symbol, contexts))])[begin])
        return out


class Read:
    """Texts as units: ``number`` is that of the dictionary, or beyond it one of ``others``; ``begin`` is where texts begin (and all end).

    All units out of the dictionary are the escape among the ``symbol``s.
    """

    def __init__(self, alphabet: Alphabet, texts: pa.Array):
        units, self.begin = cut(texts)
        self.base = len(alphabet.values)
        number = pc.fill_null(pc.index_in(units, value_set=alphabet.values), -1).to_numpy().astype(np.int64)
        out = np.flatnonzero(number < 0)
        other = units.take(pa.array(out)).dictionary_encode()
        self.others = other.dictionary
        self.symbol = number.copy()
        number[out] = self.base + other.indices.to_numpy()
        self.symbol[out] = alphabet.escape
        self.number, self.out = number, out
        ends = np.concatenate([alphabet.endings, endings(self.others)]).take(number)
        self.contexts = unit_contexts(self.symbol, ends, self.begin[:-1], alphabet.escape)


# --- what is counted in Spark ------------------------------------------------------------------------------


def count_units(train: DataFrame) -> DataFrame:
    """unit and n of all rows of ``train`` (text as bytes)."""

    def run(batches):
        kept, size = [], 0

        def out():
            rows = pa.concat_tables(kept).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])
            kept.clear()
            return rows.to_batches(max_chunksize=50_000)

        for batch in batches:
            for b in slices(batch, size=SLICE):
                encoded = cut(b.column(0))[0].dictionary_encode()
                kept.append(pa.table({"unit": encoded.dictionary, "n": np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary))}))
                size += len(encoded.dictionary)
                if size > CACHE:
                    yield from out()
                    size = 0
        if kept:
            yield from out()

    return train.mapInArrow(run, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def make_alphabet(counted: DataFrame) -> Alphabet:
    """The dictionary from stored counts: all units above the least count (1 at least) that leaves DICTIONARY of them at most.

    Units that occur once are always spelled: they teach how often, and how, new ones come.
    """
    by_count = sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True)  # so many different counts need half the square of their number of units
    total, cut = 0, 1
    for n, units_ in by_count:
        total += units_
        if total >= DICTIONARY:
            cut = max(n, 1)
            break
    rows = counted.where(F.col("n") > cut).toArrow()  # DICTIONARY rows at most
    rare = counted.where(F.col("n") <= cut)

    def letters(batches):
        total = np.zeros(256)
        for b in batches:
            data, begin = raw(spelled(b.column(0)))
            total += np.bincount(data, np.repeat(b.column(1).to_numpy(), np.diff(begin)), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    by_byte = np.zeros(256)
    for b, n in rare.mapInArrow(letters, "byte int, n double").groupBy("byte").agg(F.sum("n")).collect():
        by_byte[b] = n
    others = rare.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = rows.combine_chunks() if len(rows) else pa.table({"unit": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    units, n = (rows[c].chunk(0) if len(rows) else rows[c].combine_chunks() for c in ("unit", "n"))
    out = Alphabet(units.cast(pa.binary()), n.to_numpy(), others, by_byte.astype(np.int64))
    out.cut, out.total = cut, others + int(pc.sum(n).as_py() or 0)
    return out


def summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums (or how often they occur; then ``key`` itself is sorted)."""
    if n is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(first, append=len(key)) if n is None else np.add.reduceat(n, first) if len(first) else n


def pressed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and counts in few bytes: differences and counts, byte plane by byte plane."""
    step = np.diff(key, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.concatenate([step, n.astype("<u8").view(np.uint8).reshape(-1, 8).T]).tobytes(), 1)


def unpressed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(16, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=_U), np.ascontiguousarray(planes[8:].T).view("<u8").ravel().astype(np.int64)


def _parts(found: Iterator[tuple[np.ndarray, np.ndarray | None]], part_bits: int) -> Iterator[pa.RecordBatch]:
    """Counted (context | symbol) numbers, a row for each part of the table; ``found``: some numbers at a time, and what each counts (None: one).

    COUNTED of them wait at most, a third as many with counts (they take as much to be sorted), besides those that came last; then they are summed, and sent if that has not made them few.
    """

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(key, np.arange(1, 1 << part_bits, dtype=_U) << _U(64 - part_bits))
        filled = [(p, pressed(k, v)) for p, (k, v) in enumerate(zip(np.split(key, ends), np.split(n, ends))) if len(k)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in filled], pa.int32()), pa.array([x for _, x in filled], pa.binary())], names=["part", "counts"])

    kept: list[tuple[np.ndarray, np.ndarray | None]] = []

    def united() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in kept])
        n = None if kept[0][1] is None else np.concatenate([n for _, n in kept])
        kept.clear()
        return summed(key, n)

    size = 0
    for key, n in found:
        kept.append((key, n))
        size += len(key) * (1 if n is None else 3)
        del key
        if size > COUNTED:
            whole = united()
            size = 3 * len(whole[0])
            if n is None or size > COUNTED // 2:
                yield rows(*whole)
                size = 0
            else:
                kept.append(whole)
            del whole
    if kept:
        yield rows(*united())


PARTS = "part int, counts binary"


def count_unit_contexts(train: DataFrame, alphabet, part_bits: int) -> DataFrame:
    """Counts of units in their contexts, of all rows; ``alphabet``: broadcast."""

    def found(batches):
        for batch in batches:
            for b in slices(batch, size=SLICE >> 1):
                read = Read(alphabet.value, b.column(0))
                symbol, contexts = read.symbol.astype(_U), read.contexts
                del read
                while contexts:
                    yield contexts.pop() | symbol, None

    def run(batches):
        yield from _parts(found(batches), part_bits)

    return train.mapInArrow(run, PARTS)


def count_letter_contexts(rare: DataFrame, alphabet, part_bits: int) -> DataFrame:
    """Counts of letters in their contexts, of all units (unit, n) that are spelled."""

    def found(batches):
        for batch in batches:
            for b in slices(batch, size=LETTERS):
                symbol, contexts, begin = letter_contexts(spelled(b.column(0)), alphabet.value)
                symbol, n = symbol.astype(_U), np.repeat(b.column(1).to_numpy(), np.diff(begin))
                while contexts:
                    yield summed(contexts.pop() | symbol, n)

    def run(batches):
        yield from _parts(found(batches), part_bits)

    return rare.mapInArrow(run, PARTS)


def make_table(found: DataFrame, table: Table, code: Code, path: str) -> Table:
    """Sum up the counts of each part and write the table's file, part by part at its place."""
    sent = found.sparkSession.sparkContext.broadcast(code)
    with open(path, "wb") as f:
        f.truncate(2 * ((table.size << table.part_bits) + (1 << ROW)))

    def make(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [unpressed(v.as_py()) for b in batches for v in b.column("counts")]
        keys, n = summed(*(np.concatenate(x) for x in zip(*arrays)))
        data = table.fill(keys, n, sent.value).astype("<u2").tobytes()
        with open(path, "r+b") as f:  # a task that is run again writes the same bytes
            f.seek(key[0].as_py() * len(data))
            f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

    make.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    found.groupBy("part").applyInArrow(make, "n long").agg(F.sum("n")).collect()
    return table.open(path)


def learn_weights(train: DataFrame, sent, units: int) -> np.ndarray | None:
    """The weights and refinements learned on all training texts; ``sent``: the model, broadcast; ``units``: how many all texts have.

    Texts are dealt by their hash to groups, whose number follows from ``units``; a group learns from its texts in the order of their hashes, some at a time, and the groups' states are
    averaged in their order. So nothing depends on the files or partitions in which the texts lie.
    """
    groups = max(1, math.ceil(units / LEARNED))
    width = SLICE >> 2

    def learned(group: int, model: Model, batches: Iterator[pa.Array]) -> pa.RecordBatch:
        n, kept, size = 0, [], 0

        def step():
            nonlocal n
            read = Read(model.alphabet, pa.concat_arrays(kept))
            rate = 0.0003 + 0.003 / (1 + n / 50_000)
            n += model.of_units.learn(read.symbol, read.contexts, rate)
            model.of_letters.learn(*letter_contexts(spelled(read.others), model.alphabet)[:2], rate)
            kept.clear()

        for texts in batches:
            # pieces end after the text with which they reach the width, however the texts come in batches
            length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            first = 0
            for i, bytes_ in enumerate(length.tolist()):
                size += bytes_
                if size >= width:
                    kept.append(texts.slice(first, i + 1 - first))
                    step()
                    first, size = i + 1, 0
            if first < len(texts):
                kept.append(texts.slice(first))
        if kept:
            step()
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([model.state().astype(np.float64)], pa.list_(pa.float64()))], names=["g", "n", "state"])

    def run(batches):
        """Groups one after another, as they are sorted."""
        rest: list[tuple[int, pa.Array]] = []

        def runs():
            for b in batches:
                group = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
                yield from ((int(group[x]), b.column(1).slice(x, y - x)) for x, y in zip(cuts, cuts[1:]) if y > x)

        stream = runs()

        def of(group: int) -> Iterator[pa.Array]:
            yield rest.pop()[1]
            for g, texts in stream:
                if g != group:
                    rest.append((g, texts))
                    return
                yield texts

        for g, texts in stream:
            rest.append((g, texts))
            while rest:
                yield learned(rest[-1][0], sent.value.unlearned(), of(rest[-1][0]))

    hashed = train.where("data is not null").withColumn("h", F.xxhash64("data"))
    dealt = hashed.withColumn("g", F.pmod(F.shiftright("h", 8), F.lit(groups)).cast("int")).repartition(min(groups, 20_000), "g").sortWithinPartitions("g", "h")  # texts of one hash are equal
    each = dealt.select("g", "data").mapInArrow(run, "g int, n long, state array<double>").select("g", "n", F.posexplode("state").alias("k", "x"))
    own = F.array_sort(F.collect_list(F.struct("g", "n", "x")))  # as many as groups
    total = F.aggregate("own", F.lit(0.0), lambda a, r: a + r["x"] * r["n"]) / F.aggregate("own", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    rows = each.where("n > 0").groupBy("k").agg(own.alias("own")).select("k", total.alias("x")).collect()  # as many as weights
    if not rows:
        return None
    out = np.zeros(len(rows))
    for k, x in rows:
        out[k] = x
    return out


def score_texts(model: Model, known: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """n_words, score, n_known and the sum of log10(count + 1) of words in the dictionary, and the hashes of other words, of each text.

    ``known``: the counts of the dictionary's words (-2: no word).
    """
    read = Read(model.alphabet, texts)
    score, c = model.of_units.score(read.symbol, read.contexts), known.take(read.symbol)
    hashes = word_hashes(read.others)
    own = read.number[read.out] - read.base
    score[read.out] += model.spell(read.others).take(own)
    c[read.out] = np.where(hashes.take(own) == 0, -2, -1)
    rest = hashes.take(own[c[read.out] == -1])
    of_text = lambda x: np.add.reduceat(x.astype(x.dtype if x.dtype != bool else np.int64), read.begin[:-1]) if len(texts) else x[:0]  # noqa: E731  each has a unit
    ends = np.cumsum(of_text(c == -1))
    logs = np.zeros(len(c))
    logs[c >= 0] = np.log10(c[c >= 0] + 1)
    return of_text(c > -2), of_text(score), of_text(c >= 0), of_text(logs), np.split(rest, ends[:-1]) if len(ends) else []


def build(train: DataFrame, counted: DataFrame, scratch: Scratch) -> Model:
    """The model of the training texts (``data``: bytes) and their stored counts of (unit, n)."""
    alphabet = make_alphabet(counted)
    sent = train.sparkSession.sparkContext.broadcast(alphabet)
    root = scratch.local("contexts")
    unit_code, unit_table = Code(alphabet.weights).save(f"{root}/unit-code"), Table(alphabet.total)
    make_table(count_unit_contexts(train, sent, unit_table.part_bits), unit_table, unit_code, f"{root}/units")
    scratch.release()
    letter_code, letter_table = Code(alphabet.letter_weights).save(f"{root}/letter-code"), Table(int(alphabet.letter_weights.sum()))
    rare = counted.where(F.col("n") <= alphabet.cut)
    make_table(count_letter_contexts(rare, sent, letter_table.part_bits), letter_table, letter_code, f"{root}/letters")
    scratch.release()
    model = Model(alphabet, unit_code, unit_table, letter_code, letter_table)
    learned = learn_weights(train, train.sparkSession.sparkContext.broadcast(model), alphabet.total)
    if learned is not None:
        model.set_state(learned)
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each document.

    Learns from rows that are not held out (crc32 of the id mod 7 is 2).
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    out_of = held(F.col("doc_id"), 7, 2)
    train = docs.where(~out_of).select(F.encode("text", "UTF-8").alias("data"))
    counted = scratch.write(count_units(train))
    scratch.release()
    model = build(train, counted, scratch)
    ends = docs.where(~out_of).count()

    def words(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(b.column(0))), b.column(1)], names=["h", "c"])

    vocabulary = scratch.write(counted.mapInArrow(words, "h long, c long").where("h != 0").groupBy("h").agg(F.sum("c").alias("c")))
    scratch.drop(counted)
    scratch.release()
    v, n = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    v, n = v + (ends > 0), n + ends
    # the counts of the dictionary's words: DICTIONARY rows at most
    own = word_hashes(pc.fill_null(model.alphabet.values, b""))
    asked = np.unique(own[own != 0])
    known = np.full(len(own), -2, np.int64)
    if len(asked):
        found = vocabulary.join(F.broadcast(spark.createDataFrame(pa.table({"h": asked}))), "h").toArrow().sort_by("h")
        known[own != 0] = found["c"].to_numpy()[np.searchsorted(found["h"].to_numpy(), own[own != 0])]
    sent = spark.sparkContext.broadcast((model, known))
    floor = math.log10(n + v + 1)

    def run(batches):
        for batch in batches:
            for b in slices(batch, 3, SLICE):
                words, score, seen, logs, rare = score_texts(*sent.value, b.column(3))
                base = logs + math.log10(ends + 1) - (words + 1) * floor
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.array(np.concatenate(rare) if rare else [], pa.int64()))
                size = pc.fill_null(pc.binary_length(b.column(3)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words + 1), pa.array(seen + (ends > 0)), pa.array(base), pa.array(score), size, lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", out_of.alias("held_out"), F.encode("text", "UTF-8").alias("data"))
    scored = scratch.write(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<long>"))
    scratch.drop_local("contexts")
    rare = scored.select("row", F.explode("rare").alias("h")).join(vocabulary, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("rest"))
    whole = scored.drop("rare").join(rare, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
