"""File names: admission by extension, mates, output names and sizes for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each role admits (fixed lists of extensions), plain or compressed.
FASTA = r"(?i)\.(fa|fasta|fna)(\.(gz|bgz|bgzf))?$"
FASTQ = r"(?i)\.(fastq|fq)(\.(gz|bgz|bgzf))?$"
INDEX = r"(?i)\.(filter|info)$"
_MATE = r"(?i)^(.*)_(R?)([12])(?=[._]|$)(.*)$"


def role(name: Column) -> Column:
    """reference, index, reads, or null for a file that is not admitted."""
    return F.when(name.rlike(FASTA), "reference").when(name.rlike(INDEX), "index").when(name.rlike(FASTQ), "reads")


def stem(name: Column) -> Column:
    """The name without its FASTQ suffix."""
    return F.regexp_replace(name, FASTQ, "")


def mate_key(name: Column) -> Column:
    """What both mates share: the stem without its last mate marker."""
    return F.regexp_replace(stem(name), _MATE, "$1$4")


def mate(name: Column) -> Column:
    """1 or 2, or 0 without a marker."""
    found = F.regexp_extract(stem(name), _MATE, 3)
    return F.when(found == "1", 1).when(found == "2", 2).otherwise(0)


def output_name(name: Column, matched: bool, gzip: bool = False) -> Column:
    """``X.fq.gz`` gives ``X.matched.fq``, a name without a FASTQ suffix ``name.matched.fastq``; ``.gz`` if compressed."""
    side = ".matched" if matched else ".unmatched"
    bare = F.regexp_replace(name, r"(?i)\.(gz|bgz|bgzf)$", "")
    named = F.when(name.rlike(FASTQ), F.regexp_replace(bare, r"(?i)\.(fastq|fq)$", rf"{side}.$1")).otherwise(F.concat(name, F.lit(f"{side}.fastq")))
    return F.concat(named, F.lit(".gz")) if gzip else named


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB or GB of 1024, with one decimal below ten (not for bytes), halves rounded up."""
    out = F.concat(F.floor(n + 0.5).cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        v = n / float(1024**k)
        small = F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)
        out = F.when(n >= 1024**k, F.concat(F.when(v < 10, small).otherwise(F.floor(v + 0.5).cast("string")), F.lit(f" {unit}"))).otherwise(out)
    return out
