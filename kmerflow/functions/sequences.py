"""Column functions on sequences, labels and lineages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper_ascii(col: Column | str) -> Column:
    """Upper case of a-z alone: other letters differ between engines."""
    return F.translate(F.col(col) if isinstance(col, str) else col, LOWER, UPPER)


def kmers(col: Column | str, k: int, include_last: bool = False) -> Column:
    """Array of overlapping windows of ``k`` characters.

    By default the last window is left out, as the counting convention of the profiles has it; a sequence of at most
    ``k`` characters then has no window. Null stays null.
    """
    pattern = f"(?s)(?=(.{{{k}}}))" if include_last else f"(?s)(?=(.{{{k}}}).)"
    return F.regexp_extract_all(F.col(col) if isinstance(col, str) else col, F.lit(pattern), F.lit(1))


def kmers_of_chunk(chunk: Column, last: Column, k: int, include_last: bool = False) -> Column:
    """Windows of one chunk of a long sequence; chunks overlap by ``k - 1``, only the last one leaves a window out."""
    every = kmers(chunk, k, include_last=True)
    return every if include_last else F.when(last, kmers(chunk, k)).otherwise(every)


def is_valid(col: Column | str, alphabet: str = "ATCG") -> Column:
    """Whether every character is in the alphabet."""
    return (F.col(col) if isinstance(col, str) else col).rlike(f"^[{alphabet}]+\\z")


def seeded_hash(seed: int, *cols):
    """A number from 0 to 2^32 - 1 that depends on the seed and the columns alone, the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def canonical_domain(col: Column | str) -> Column:
    """Archaea in any case count as Bacteria."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.lower(c) == "archaea", F.lit("Bacteria")).otherwise(c)


def one_class_truth(col: Column | str) -> Column:
    """Anything but a spelling of bacteria is Unknown (P5); null too."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin("Bacteria", "bacteria", "bact"), c).otherwise(F.lit("Unknown"))


def accession(col: Column | str, keep_version: bool = False) -> Column:
    """Accession of a sequence id: first token without ``>``, fourth ``|`` field if there is one."""
    c = F.col(col) if isinstance(col, str) else col
    token = F.regexp_extract(F.regexp_replace(c, "^>", ""), r"^(\S*)", 1)
    field = F.get(F.split(token, r"\|"), F.lit(3))
    out = F.coalesce(F.when(field != "", field), token)
    return out if keep_version else F.regexp_replace(out, r"\.\d+$", "")


def lineage_path(text: Column | str) -> Column:
    """Levels of a tab-separated lineage line, empty ones left out; null for comment lines."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(~c.startswith("#"), F.filter(F.split(c, "\t"), lambda x: x != ""))
