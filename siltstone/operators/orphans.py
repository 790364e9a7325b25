"""References to records that do not exist.

Parents lie in ranges of their key's 64-bit hash. The ranges' bounds are known without sampling and
hold about equally many keys whatever the ids look like. Within a range the parents form a sorted array,
and a batch of references is probed by one vectorised binary search; the key itself is compared at each
hit, so a collision of hashes can't hide an orphan. A range whose references exceed `batch_rows`
(a hot target) is split by salt, with the parents' array given to each split. There are as many ranges as keys
need, so an array stays near `range_keys` keys however large the table is. Only misses leave the tasks.

Defined cases: ids and references compare trimmed and in lower case; null and empty references count as
none; a parent with null created_at exists at any time; a referring row with null created_at can't be
earlier than its parent; repeated rows give one result row; empty tables give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import blocks, cut, ref_key

MISS = "ref_table string, row_id string, ref_field string, kind string, created_us long"


def references(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """All references: (ref_table, row_id, ref_field, key, created_us), without null and empty ones."""
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    ends = relations.select(
        F.lit("document_relations").alias("ref_table"),
        F.col("id").alias("row_id"),
        us.alias("created_us"),
        F.explode(
            F.array(*(F.struct(F.lit(f).alias("ref_field"), ref_key(f).alias("key")) for f in ("source_id", "target_id")))
        ).alias("e"),
    ).select("ref_table", "row_id", "e.ref_field", "e.key", "created_us")
    parents = documents.select(
        F.lit("store_documents").alias("ref_table"),
        F.col("id").alias("row_id"),
        F.lit("parent_id").alias("ref_field"),
        ref_key("parent_id").alias("key"),
        us.alias("created_us"),
    )
    return ends.unionByName(parents).filter(F.col("key").isNotNull())


def known_keys(documents: DataFrame, deletes: DataFrame | None) -> DataFrame:
    """One row per key: earliest created_us of a live row (null: no live row), and whether one is live or was deleted."""
    live = documents.select(
        ref_key("id").alias("key"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))).alias("since"),
    )
    if deletes is not None:
        live = live.unionByName(deletes.select(ref_key("document_id").alias("key"), F.lit(None).cast("long").alias("since")))
    return live.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("since").alias("since"))


def _probe(refs: pa.Table, known: pa.Table) -> pa.Table:
    """Misses of one batch of references against one range of sorted keys."""
    n = refs.num_rows
    order = pc.sort_indices(known, sort_keys=[("hash", "ascending")]) if known.num_rows else None
    found, since = np.zeros(n, bool), np.zeros(n, np.int64)
    dead = np.zeros(n, bool)
    if n and order is not None:
        known = known.take(order)
        hashes = known["hash"].to_numpy()
        start = known["since"].fill_null(np.iinfo(np.int64).max).to_numpy()
        gone = known["since"].is_null().to_numpy()
        keys, sought = known["key"].combine_chunks(), refs["key"].combine_chunks()
        probe = refs["hash"].to_numpy()
        at = np.searchsorted(hashes, probe, side="left")
        open_ = np.flatnonzero(at < len(hashes))
        while len(open_):  # a second round only where different keys share a hash
            open_ = open_[hashes[at[open_]] == probe[open_]]
            same = pc.equal(keys.take(pa.array(at[open_])), sought.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            hit = open_[same]
            found[hit], since[hit], dead[hit] = True, start[at[hit]], gone[at[hit]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(hashes)]
    created = refs["created_us"].fill_null(np.iinfo(np.int64).max).to_numpy() if n else np.zeros(0, np.int64)
    live = found & ~dead
    miss = ~live | (since > created)
    kind = np.where(~found, "missing", np.where(dead, "deleted", "created_later"))
    out = refs.select(["ref_table", "row_id", "ref_field"]).append_column("kind", pa.array(kind.astype(str), pa.string()))
    return out.append_column("created_us", refs["created_us"]).filter(pa.array(miss))


def orphan_references(
    relations: DataFrame,
    documents: DataFrame,
    deletes: DataFrame | None = None,
    range_keys: int = 25_000,
    batch_rows: int = 100_000,
) -> DataFrame:
    """Every orphan reference with its kind: missing, deleted or created_later."""
    refs = references(relations, documents).withColumn("hash", F.xxhash64("key"))
    known = known_keys(documents, deletes).withColumn("hash", F.xxhash64("key"))
    ranges = blocks(documents.count(), range_keys)
    bits = int(math.log2(ranges))
    # the arithmetic shift keeps the order of hashes, so each range is an interval of them
    band = F.shiftright("hash", 64 - bits) if bits else F.lit(0).cast("long")
    refs, known = refs.withColumn("band", band), known.withColumn("band", band)
    # ranges with more references than a batch: a table of its own, joined, never collected
    hot = cut(refs.groupBy("band").agg(F.ceil(F.count("*") / batch_rows).cast("int").alias("splits")).filter("splits > 1"))
    salt = F.coalesce(F.pmod(F.xxhash64("row_id", "ref_field"), F.col("splits")).cast("int"), F.lit(0))
    refs = refs.join(hot, "band", "left").withColumn("salt", salt)
    known = known.join(hot, "band", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits") - 1, F.lit(0)))))
    refs = refs.select("band", "salt", "hash", "key", "ref_table", "row_id", "ref_field", "created_us")
    known = known.select("band", "salt", "hash", "key", "since")
    return refs.groupBy("band", "salt").cogroup(known.groupBy("band", "salt")).applyInArrow(_probe, MISS)


def orphan_rows(relations: DataFrame, documents: DataFrame, deletes: DataFrame | None = None, **kw) -> DataFrame:
    """Distinct (ref_table, row_id, ref_field)."""
    return orphan_references(relations, documents, deletes, **kw).select("ref_table", "row_id", "ref_field").distinct()


def orphan_report(relations: DataFrame, documents: DataFrame, deletes: DataFrame | None = None, **kw) -> DataFrame:
    """Orphans per table, field, kind and month of the referring row; a row sent twice counts once."""
    month = F.date_format(F.timestamp_micros("created_us"), "yyyy-MM")
    found = orphan_references(relations, documents, deletes, **kw).withColumn("month", month)
    return (
        found.select("ref_table", "ref_field", "kind", "month", "row_id")
        .distinct()
        .groupBy("ref_table", "ref_field", "kind", "month")
        .agg(F.count("*").alias("orphans"))
    )
