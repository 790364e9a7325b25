"""Schemas, configuration and name rules of the document store."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from enum import Enum

from pyspark.sql import types as T


def _s(name: str, kind: T.DataType, null: bool = True) -> T.StructField:
    return T.StructField(name, kind, null)


DOCUMENT = T.StructType(
    [
        _s("id", T.StringType(), False), _s("content", T.StringType(), False), _s("metadata", T.StringType()), _s("tags", T.ArrayType(T.StringType())),
        _s("vector", T.ArrayType(T.FloatType())), _s("created_at", T.TimestampType(), False), _s("updated_at", T.TimestampType(), False),
        _s("is_embedded", T.BooleanType(), False), _s("vectorize", T.BooleanType(), False), _s("is_chunk", T.BooleanType(), False), _s("parent_id", T.StringType()),
        _s("chunk_index", T.IntegerType()), _s("token_count", T.IntegerType()), _s("is_vectorized", T.BooleanType(), False),
    ]
)
RELATION = T.StructType(
    [_s("id", T.StringType(), False), _s("source_id", T.StringType(), False), _s("target_id", T.StringType(), False), _s("relation_type", T.StringType(), False), _s("metadata", T.StringType()), _s("created_at", T.TimestampType(), False)]
)
CACHE = T.StructType([_s("content_hash", T.StringType(), False), _s("model", T.StringType(), False), _s("vector", T.ArrayType(T.FloatType()), False), _s("created_at", T.TimestampType(), False)])
LOG = T.StructType(
    [
        _s("timestamp", T.StringType()), _s("level", T.StringType()), _s("target", T.StringType()),
        _s("fields", T.StructType([_s("message", T.StringType())])), _s("span", T.StructType([_s("name", T.StringType())])),
    ]
)


class SearchType(Enum):
    VECTOR = "vector"
    FULLTEXT = "fulltext"
    HYBRID = "hybrid"


class StoreError(ValueError):
    """A request that the store refuses."""


def check_name(name: str) -> str:
    """Table and database names: letters, digits and underscores."""
    if not re.fullmatch(r"\w+", name or ""):
        raise StoreError(f"invalid name: {name!r}")
    return name


@dataclass
class Config:
    """Feature flags and sizes; unknown keys in a file are ignored, missing ones keep their default."""

    embedding: bool = False
    embedding_cache: bool = False
    embedding_job: bool = False
    vector_index: bool = False
    chunking: bool = False
    document_relations: bool = False
    hybrid_search: bool = False
    index_threshold: int = 1000
    chunk_strategy: str = "fixed_token"
    chunk_size: int = 512
    chunk_overlap: int = 50
    chunk_threshold: int = 512
    worker_seconds: int = 10
    worker_batch: int = 10
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str | None) -> Config:
        """From JSON text; text that can't be read gives the defaults, all features off."""
        try:
            got = json.loads(text or "{}")
        except ValueError:
            return cls()
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in got.items() if k in known}, extra={k: v for k, v in got.items() if k not in known})

    def dump(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "extra"} | self.extra)
