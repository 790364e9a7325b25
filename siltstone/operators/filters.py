"""Predicates on documents, as Columns so that they run before a top-k."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_tag(tag: str, tags: str = "tags") -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def has_tags(wanted: list[str], tags: str = "tags") -> Column:
    return reduce(lambda a, b: a & b, (has_tag(t, tags) for t in wanted), F.lit(True))


def metadata_equals(key: str, value, metadata: str = "metadata") -> Column:
    """Typed equality on a top-level JSON value: a string doesn't equal a number. Broken JSON never matches."""
    got = F.try_variant_get(F.try_parse_json(F.col(metadata)), f"$['{key}']", "variant")
    kind = F.schema_of_variant(got)
    if isinstance(value, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(got, "$", "boolean") == value), F.lit(False))
    if isinstance(value, int | float):
        return F.coalesce(~kind.isin("STRING", "BOOLEAN", "VOID") & (F.try_variant_get(got, "$", "double") == float(value)), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(got, "$", "string") == value), F.lit(False))


def build(filters: dict | str | None) -> Column:
    """tag, tags, and any other key as metadata equality, all of them together."""
    filters = json.loads(filters) if isinstance(filters, str) else dict(filters or {})
    out = F.lit(True)
    for k, v in filters.items():
        out = out & (has_tag(v) if k == "tag" else has_tags(v) if k == "tags" else metadata_equals(k, v))
    return out


def is_root(parent: str = "parent_id") -> Column:
    return F.coalesce(F.trim(parent), F.lit("")) == ""


def in_queue() -> Column:
    return ~F.coalesce("is_embedded", F.lit(False)) & F.coalesce("vectorize", F.lit(True))


def embedded() -> Column:
    return F.coalesce("is_embedded", F.lit(False)) & F.col("vector").isNotNull()
