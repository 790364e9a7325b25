"""Duplicates hidden by formatting differences.

A content becomes a set of (name, value) pairs, each reduced to its letters and digits in folded case; a content
without named fields is one pair without a name. Every pair is hashed and the hashes are added lane by lane (four lanes of
32 bits in 64-bit sums): a commutative multiset hash, so the order of fields needs no sort. Records are grouped by the
fingerprint with a combine before the shuffle, and only members of groups of two or more move again, to be compared
with the group's smallest member by set difference. What differs there (a collision) is compared with the smallest of what is left, until
nothing is.

A group may hold a third of all rows: a group of more than `SLICE` rows is salted into as many slices as it needs, and its
representative is given to each; other groups move once.

Defined cases: null contents and contents without a letter or digit belong to no set; repeated rows of one id count once; repeated equal
pairs in a record count once; one named line alone is text; broken JSON is text; nested JSON values compare as their
text; other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

SLICE, MOST_SENT = 200_000, 100_000
_FIELD = r"(?s)^[^:=;.!?\n]{1,40}[:=].*\S.*$"
_PAIR = r"(?s)^[^:=;.!?\n]{1,40}=.*\S.*$"
_FP = ["f1", "f2", "f3", "f4", "fn"]


def folded(c: Column) -> Column:
    """Letters and digits in folded case: sharp s equals ss, final sigma and long s equal the plain letters."""
    low = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def _named(parts: Column) -> Column:
    return F.transform(
        parts, lambda p: F.concat(folded(F.regexp_extract(p, r"(?s)^([^:=]*)[:=](.*)$", 1)), F.lit("\x00"), folded(F.regexp_extract(p, r"(?s)^([^:=]*)[:=](.*)$", 2)))
    )


def trimmed(content: Column) -> Column:
    return F.trim(content, F.lit(" \t\r\n\f\x0b ​﻿"))


def fields(t: Column) -> Column:
    """array<string> of distinct "name NUL value" entries of a trimmed content; empty where nothing is left to compare."""
    shape = F.when(t.startswith("{") & t.endswith("}"), F.from_json(t, "map<string,string>"))
    json = F.transform(F.map_entries(shape), lambda e: F.concat(folded(e["key"]), F.lit("\x00"), folded(F.coalesce(e["value"], F.lit("")))))
    lines = F.filter(F.split(t, r"\r\n?|\n"), lambda x: x.rlike(r"\S"))
    by_line = F.when((F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(_FIELD)), _named(lines))
    parts = F.filter(F.split(t, ";"), lambda x: x.rlike(r"\S"))
    by_part = F.when((F.size(parts) > 1) & F.forall(parts, lambda x: x.rlike(_PAIR)), _named(parts))
    # the tests by line and part run only where the first characters hold a sign of a field
    maybe = t.rlike(r"^[^:=;.!?\n]{1,40}[:=]")
    text = F.array_remove(F.array(F.concat(F.lit("\x00"), folded(t))), "\x00")
    return F.array_distinct(F.coalesce(F.nullif(json, F.array().cast("array<string>")), F.when(maybe, F.coalesce(by_line, by_part)), text))


def _fingerprint(df: DataFrame) -> DataFrame:
    """Adds the lanes f1..f4 and the number of fields fn."""
    low = F.lit(0xFFFFFFFF).cast("long")
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in "abcd"))

    def add(acc: Column, x: Column) -> Column:
        h, g = F.xxhash64(x), F.xxhash64(F.lit(11), x)
        return F.struct(
            (acc["a"] + h.bitwiseAND(low)).alias("a"), (acc["b"] + F.shiftrightunsigned(h, 32)).alias("b"),
            (acc["c"] + g.bitwiseAND(low)).alias("c"), (acc["d"] + F.shiftrightunsigned(g, 32)).alias("d"),
        )

    df = df.withColumn("_s", F.aggregate("fields", zero, add))
    return df.select("id", "fields", *(F.col("_s")[x].alias(f) for x, f in zip("abcd", _FP, strict=False)), F.size("fields").alias("fn"))


def _base(documents: DataFrame, key: str, content: str) -> DataFrame:
    # one step an expression, so that none is computed twice; empty contents fall out by fn
    t = documents.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), trimmed(F.col(content)).alias("t"))
    return _fingerprint(t.select("id", fields(F.col("t")).alias("fields")))


def duplicate_members(documents: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(id, keep_id) for every member of a set of two or more, the kept one included."""
    # the texts are parsed once: what later steps read is the fingerprints with their fields
    base = cut(_base(documents, key, content).filter("fn > 0"))
    slices = F.ceil(F.count("*") / SLICE).cast("int").alias("slices")
    groups = cut(base.groupBy(*_FP).agg(F.count("*").alias("n"), F.min("id").alias("keep"), slices).filter("n > 1"))
    wide = groups.filter("slices > 1").select(*_FP, "slices")  # only these groups are spread, by their own size
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("salt")
    few = wide.count()
    if few:
        salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"), F.lit(0)).alias("salt")
        salted = base.join(F.broadcast(wide) if few <= MOST_SENT else wide, _FP, "left").select(*base.columns, salt)
    else:
        salted = base.select("*", F.lit(0).alias("salt"))
    spread = groups.select(*_FP, "keep", "slices", each)
    members = cut(salted.join(spread, [*_FP, "salt"]).select("id", "keep", "salt", "slices", "fields", *_FP))
    first = members.filter("id = keep").select(*_FP, F.col("fields").alias("kept"), "slices").dropDuplicates(_FP).select(*_FP, "kept", each)
    same = (F.size("fields") == F.size("kept")) & (F.size(F.array_except("fields", "kept")) == 0)
    checked = cut(members.join(first, [*_FP, "salt"]).select("id", "keep", same.alias("same"), F.when(~same, F.col("fields")).alias("fields"), *_FP).distinct())
    out, rest = checked.filter("same").select("id", F.col("keep").alias("keep_id")), checked.filter("not same").drop("same", "keep")
    while rest.limit(1).count():  # a collision of 128 bits: the smallest of what is left represents the next set of each fingerprint
        keep = rest.groupBy(*_FP).agg(F.min("id").alias("keep"))
        kept = rest.join(keep, _FP).filter("id = keep").select(*_FP, "keep", F.col("fields").alias("kept")).dropDuplicates(_FP)
        checked = cut(rest.join(kept, _FP).select(*rest.columns, "keep", same.alias("same")))
        out = out.unionByName(checked.filter("same").select("id", F.col("keep").alias("keep_id")))
        rest = checked.filter("not same").select(*rest.columns)
    sizes = out.groupBy("keep_id").agg(F.count("*").alias("n")).filter("n > 1")
    return out.join(sizes, "keep_id", "left_semi").select("id", "keep_id")


def duplicate_pairs(documents: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(keep_id, copy_id)."""
    m = duplicate_members(documents, key, content)
    return m.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def collapsed_records(documents: DataFrame, cache: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(keep_id, copies, contents, cache_entries): one row a record; contents counts distinct texts, cache_entries the cache rows of
    any of them. Cache hashes compare by their 64 hex digits, however written."""
    hexed = F.regexp_extract(F.lower(F.regexp_replace("content_hash", r"[^0-9A-Fa-f:]", "")), r"([0-9a-f]{64})$", 1)
    entries = cache.select(hexed.alias("hash")).filter("hash <> ''").groupBy("hash").agg(F.count("*").alias("entries"))
    keep = duplicate_members(documents, key, content).withColumnRenamed("id", key)
    rows = documents.select(key, F.sha2(content, 256).alias("hash")).filter(F.col(key).isNotNull())
    rows = rows.join(keep, key, "left").withColumn("keep_id", F.coalesce("keep_id", F.col(key)))
    per_text = rows.groupBy("keep_id", "hash").agg(F.count("*").alias("copies"))
    return (
        per_text.join(entries, "hash", "left")
        .groupBy("keep_id")
        .agg(
            F.sum("copies").alias("copies"), F.count("hash").alias("contents"), F.sum(F.coalesce("entries", F.lit(0))).alias("cache_entries")
        )
    )
