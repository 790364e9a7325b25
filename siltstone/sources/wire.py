"""JSON wire form of documents: millisecond timestamps, no vector, no empty tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVELS = {"none": ["id"], "minimal": ["id", "created_at", "updated_at", "is_embedded"], "full": None}


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def to_wire(docs: DataFrame) -> DataFrame:
    """(id, json). Metadata that isn't a JSON object becomes an empty one."""
    meta = F.coalesce(F.when(F.trim("metadata").startswith("{"), F.try_parse_json("metadata")), F.parse_json(F.lit("{}")))
    tags = F.when(F.size("tags") > 0, F.col("tags"))
    cols = [c for c in docs.columns if c not in ("vector", "metadata", "tags", "created_at", "updated_at")]
    return docs.select("id", F.to_json(F.struct(*cols, meta.alias("metadata"), tags.alias("tags"), millis("created_at").alias("created_at"), millis("updated_at").alias("updated_at"))).alias("json"))


def from_wire(rows: DataFrame, schema: str, c: str = "json") -> DataFrame:
    r = rows.select(F.from_json(c, schema).alias("r")).select("r.*")
    for t in {"created_at", "updated_at"} & set(r.columns):
        r = r.withColumn(t, F.timestamp_millis(t))
    return r


def respond(docs: DataFrame, level: str = "full") -> DataFrame:
    """Projection of a response: none, minimal or full (without the vector)."""
    if level not in _LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return docs.select(*_LEVELS[level]) if _LEVELS[level] else docs.drop("vector")
