"""The functions under names for SQL: native ones as SQL functions, and a table function that cuts seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from tessera.functions.seeds import Seed, base_table, coded_windows


def code_texts(code: np.ndarray, weight: int) -> pa.Array:
    """Numbers of two bits a base as texts of base codes."""
    shift = np.arange(2 * (weight - 1), -1, -2, dtype=np.uint64)
    digits = ((code[:, None] >> shift) & np.uint64(3)).astype(np.uint8) + np.uint8(ord("0"))
    ends = np.arange(len(code) + 1, dtype=np.int32) * weight
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(digits)))


class Seeds:
    """``seeds(seq, mask)``: each valid window's place and its strand-independent seed. A plain table function: those in Arrow batches can't stand in a lateral join."""

    def eval(self, seq: str, mask: str) -> Iterator[tuple[int, str]]:
        if seq is None or mask is None:
            return
        seed = Seed(mask)
        for _, place, code in coded_windows([seq.encode("latin-1", "replace")], seed, base_table("strict"), True):
            yield from zip(place.tolist(), code_texts(code, seed.weight).to_pylist())


def seed_list(texts: pa.Array, masks: pa.Array) -> pa.Array:
    """``seed_list(seq, mask)``: the same of whole batches, as an array of places and seeds (numbers of two bits a base; of 32 bases as signed ones) of each text; null without a text or mask."""
    text, mask, lut = texts.to_pylist(), masks.to_pylist(), base_table("strict")
    number, place, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for m in {x for x in mask if x is not None}:
        of = np.array([i for i, (t, x) in enumerate(zip(text, mask)) if x == m and t is not None], np.int64)
        for row, p, c in coded_windows([text[i].encode("latin-1", "replace") for i in of], Seed(m), lut, True):
            number.append(of[row])
            place.append(p)
            code.append(c)
    number, place, code = map(np.concatenate, (number, place, code))
    order = np.argsort(number, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(text)))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(place[order].astype(np.int32)), pa.array(code[order].view(np.int64))], names=["pos", "code"])
    none = pa.array([t is None or m is None for t, m in zip(text, mask)], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=none) if len(text) else pa.ListArray.from_arrays(pa.array([0], pa.int32()), items)


SCALARS = {
    "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
    "seed_codes(s STRING) RETURNS STRING": "regexp_replace(translate(regexp_replace(upper(s), '[0-9]', '.'), 'ACTGU', '01232'), '[^0-3]', '.')",
    "canonical_seed(codes STRING) RETURNS STRING": "greatest(codes, reverse(translate(codes, '0123', '2301')))",
    "covered_bases(places ARRAY<INT>, mask STRING) RETURNS INT": "size(array_distinct(flatten(transform(places, p -> transform(filter(sequence(0, length(mask) - 1), o -> substring(mask, o + 1, 1) = '#'), o -> p + o)))))",
    "read_matches(covered BIGINT, size BIGINT, permille INT) RETURNS BOOLEAN": "covered * 1000 > permille * size",
}


def register_sql(spark: SparkSession) -> None:
    """Make revcomp, seed_codes, canonical_seed, covered_bases, read_matches, seed_list and seeds known to a session."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("seed_list", arrow_udf(seed_list, "array<struct<pos: int, code: bigint>>"))
    spark.udtf.register("seeds", udtf(Seeds, returnType="pos: int, seed: string"))
