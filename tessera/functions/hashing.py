"""Unsigned 64-bit hashes of seed codes, in Arrow batches with numpy (wrapping as the published formats do).

Numbers come and go as signed longs of the same bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Two rounds of xor-shift and multiply (the multipliers are fixed values)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def swap_multiply(factor: int, code: np.ndarray, bits: int) -> np.ndarray:
    """factor * code with its halves exchanged, in ``bits`` bits."""
    half, mask = _U(bits // 2), _U((1 << bits) - 1)
    return _U(factor & ((1 << 64) - 1)) * (((code << half) ^ (code >> half)) & mask) & mask


def bucket_of(factor: int, code: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The bucket of a code: top bits for a power of two, else folded (even) or plain (odd) remainders."""
    if buckets == 1:
        return np.zeros(len(code), _U)
    s = swap_multiply(factor, code, bits)
    if buckets & (buckets - 1) == 0:
        return s >> _U(bits - (buckets.bit_length() - 1))
    if buckets % 2 == 0:
        s = s ^ (s >> _U(bits // 2))
    return s % _U(buckets)


def _unsigned(a: pa.Array) -> np.ndarray:
    return a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


def _signed(x: np.ndarray, like: pa.Array) -> pa.Array:
    return pa.array(x.view(np.int64), mask=like.is_null().to_numpy(zero_copy_only=False))


def hash_mix(code: Column) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _signed(mix64(_unsigned(a)), a)

    return F.arrow_udf(run, "long")(code)


def swap_mul(code: Column, factor: int, bits: int) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _signed(swap_multiply(factor, _unsigned(a), bits), a)

    return F.arrow_udf(run, "long")(code)


def get_bucket(code: Column, factor: int, buckets: int, bits: int) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _signed(bucket_of(factor, _unsigned(a), buckets, bits), a)

    return F.arrow_udf(run, "long")(code)


def fingerprint(hashed: Column) -> Column:
    """The top 16 bits of a hash, never zero."""
    return F.greatest(F.shiftrightunsigned(hashed, 48), F.lit(1)).cast("int")


def bucket_pair(hashed: Column, log2_buckets: int) -> tuple[Column, Column]:
    """The two buckets in which a hash's fingerprint may lie; either leads to the other."""
    mask = F.lit((1 << log2_buckets) - 1).cast("long")
    first = hashed.bitwiseAND(mask)
    return first, first.bitwiseXOR(hash_mix(fingerprint(hashed).cast("long")).bitwiseAND(mask))
