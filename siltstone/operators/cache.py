"""Embedding cache keyed by content hash and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import content_hash


def probe(docs: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """docs with content_hash and cached_vector; null where the cache has no entry of that model."""
    hits = cache.filter(F.col("model") == model).groupBy("content_hash").agg(F.max_by("vector", F.struct("created_at", "vector")).alias("cached_vector"))
    return docs.withColumn("content_hash", content_hash(F.col("content"))).join(hits, "content_hash", "left")


def misses(docs: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct (content_hash, content) to embed: equal texts once."""
    have = cache.filter(F.col("model") == model).select("content_hash")
    rows = docs.select(content_hash(F.col("content")).alias("content_hash"), "content").filter("content is not null").dropDuplicates(["content_hash"])
    return rows.join(have, "content_hash", "left_anti")


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries; the later created_at wins for a hash and model."""
    w = Window.partitionBy("content_hash", "model").orderBy(F.desc("created_at"), F.desc("new"))
    both = cache.withColumn("new", F.lit(0)).unionByName(new.select(*cache.columns).withColumn("new", F.lit(1)))
    return both.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "new")


def evict(cache: DataFrame, now, days: int) -> DataFrame:
    return cache.filter(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def statistics(probed: DataFrame) -> DataFrame:
    """One row: hits, misses, hit_rate (0 when empty)."""
    hit = F.col("cached_vector").isNotNull().cast("long")
    return probed.agg(F.coalesce(F.sum(hit), F.lit(0)).alias("hits"), F.coalesce(F.sum(1 - hit), F.lit(0)).alias("misses")).withColumn(
        "hit_rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 6)
    )
