"""Embedders: anything with a model name, its dimensions and a batch call; used inside Arrow batches."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic unit vectors from hashed words; stands in where no service is reachable."""

    model = "hash-words"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


class HttpEmbedder:
    """A service with POST {base}/v1/embeddings taking {input, model}."""

    def __init__(self, base: str, model: str, dimensions: int, timeout: float = 30):
        self.base, self.model, self.dimensions, self.timeout = base.rstrip("/"), model, dimensions, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"input": texts, "model": self.model}).encode()
        req = urllib.request.Request(f"{self.base}/v1/embeddings", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            got = [d["embedding"] for d in json.load(r)["data"]]
        if len(got) != len(texts) or any(len(v) != self.dimensions for v in got):
            raise ValueError(f"the service returned {len(got)} vectors for {len(texts)} texts, or not {self.dimensions} numbers each")
        return got


def embed(rows: DataFrame, embedder: Embedder, key: str = "content_hash", content: str = "content", batch: int = 32) -> DataFrame:
    """(key, vector); the key stays with its vector whatever order batches end in."""

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(vectors, pa.list_(pa.float32()))], names=[key, "vector"])

    return rows.select(F.col(key).cast("string"), F.col(content)).mapInArrow(run, f"{key} string, vector array<float>")
