"""Text functions as Column expressions: folding, tokens, size estimates, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and their base letters; fixed, and the same in the SQL oracle.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿąćęłńśźżčďěňřšťůž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyacelnszzcdenrstuz"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def tokens(c: Column) -> Column:
    """array<string>: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def estimate_tokens(c: Column, up: bool = True) -> Column:
    """A quarter of the UTF-8 bytes, rounded up (store) or down (custom chunker)."""
    q = F.octet_length(c) / F.lit(4)
    return (F.ceil(q) if up else F.floor(q)).cast("int")


def heading(c: Column) -> Column:
    """First '# ' heading of a content, else Unknown."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"# (.+)", 1)), F.lit("")), F.lit("Unknown"))


def preview(c: Column, n: int = 60) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def feature_header(c: Column) -> Column:
    """'k=v; k2' to a map with trimmed keys and values."""
    pairs = F.transform(F.split(c, ";"), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.split_part(p, F.lit("="), F.lit(2))).alias("v")))
    return F.map_from_entries(F.array_distinct(F.filter(pairs, lambda x: x["k"] != "")))
