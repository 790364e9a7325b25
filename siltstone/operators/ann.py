"""Approximate vector search: an inverted file of k-means cells, and the choice between it and the exact search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import vector as V
from siltstone.operators.search import vector_batch, vector_topk


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


@dataclass
class VectorIndex:
    """Cells over unit vectors of one length. Rows keep their id, so a skipped vector shifts nothing."""

    centroids: np.ndarray
    cells: DataFrame  # id, vector, cell

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def build(cls, docs: DataFrame, cells: int | None = None, dims: int | None = None, sample: int = 20_000, steps: int = 12, seed: int = 7) -> VectorIndex:
        """Fits the centroids on at most `sample` vectors (smallest hash of the id) and assigns every row. Vectors of
        another length than the first by id, or `dims`, are left out. As many cells as the square root of the rows, unless said
        otherwise, and at most an eighth of the sample."""
        rows = docs.filter("vector is not null").select("id", "vector")
        if dims is None:
            first = rows.orderBy("id").limit(1).collect()
            if not first:
                raise ValueError("no vectors to index")
            dims = len(first[0]["vector"])
        rows = rows.filter(F.size("vector") == dims)
        n = rows.count() if cells is None else 0
        cells = cells or max(1, min(round(n**0.5), min(sample, n) // 8))
        part = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()
        x = _units(np.array(part["vector"].tolist(), np.float64).reshape(len(part), dims))
        centre = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
        for _ in range(steps):
            near = (x @ centre.T).argmax(axis=1)
            centre = _units(np.stack([x[near == k].sum(axis=0) if (near == k).any() else centre[k] for k in range(len(centre))]))
        return cls(centre, cls._assign(rows, centre))

    @staticmethod
    def _assign(rows: DataFrame, centre: np.ndarray) -> DataFrame:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    v = _units(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((v @ centre.T).argmax(axis=1).astype(np.int32))], names=["id", "vector", "cell"])

        return rows.mapInArrow(run, "id string, vector array<float>, cell int")

    def add(self, docs: DataFrame) -> VectorIndex:
        """New rows; an id that is there already is ignored, as is another length."""
        new = docs.filter((F.size("vector") == self.dims)).select("id", "vector").join(self.cells.select("id"), "id", "left_anti")
        return VectorIndex(self.centroids, self.cells.unionByName(self._assign(new, self.centroids)))

    def write(self, path: str) -> VectorIndex:
        """Stores cells and centroids; the index that comes back reads only the cells it probes."""
        spark = self.cells.sparkSession
        self.cells.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        rows = [(k, c.tolist()) for k, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return VectorIndex.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        centre = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # as many rows as cells
        cells = spark.read.schema("id string, vector array<float>, cell int").parquet(f"{path}/cells")
        return cls(np.array([r["centre"] for r in centre]), cells)

    def __len__(self) -> int:
        return self.cells.count()

    def is_built(self) -> bool:
        return len(self.centroids) > 0

    def clear(self) -> VectorIndex:
        """The same cells without rows."""
        return VectorIndex(self.centroids, self.cells.limit(0))

    def recall(self, queries: DataFrame, k: int, probes: int | None = None) -> float:
        """Share of the exact k nearest of queries(query_id, q) that a search of so many cells finds; a bounded query set."""
        exact = vector_batch(self.cells, queries.select(F.col("query_id").cast("string").alias("query_id"), "q"), k)
        near = self.search_batch(queries, k, probes).select("query_id", "id", F.lit(1).alias("hit"))
        got = exact.join(near, ["query_id", "id"], "left").agg(F.count("hit"), F.count("*")).first()
        return got[0] / got[1] if got[1] else 1.0

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.95) -> int:
        """The fewest cells by halving at which the measured recall is `least` or more; all cells give 1."""
        low, high = 1, len(self.centroids)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.recall(queries, k, mid) >= least else (mid + 1, high)
        return low

    def _probes(self, probes: int | None) -> int:
        """Three quarters of the cells where no number is given: vectors without clusters lie in many cells' neighbourhoods."""
        return -(-3 * len(self.centroids) // 4) if probes is None else probes

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, sim) best first, from the `probes` nearest cells."""
        if len(query) != self.dims:
            raise ValueError(f"query has {len(query)} numbers, the index {self.dims}")
        near = np.argsort(-(self.centroids @ _units(np.array([query], np.float64))[0]), kind="stable")[: self._probes(probes)]
        return vector_topk(self.cells.filter(F.col("cell").isin([int(c) for c in near])), query, k)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, sim, rank) for queries(query_id, q), each from its `probes` nearest cells."""
        centre, most = self.centroids, self._probes(probes)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    v = _units(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64))
                    near = np.argsort(-(v @ centre.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                    row = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(near.ravel())], names=["query_id", "q", "cell"])

        probed = queries.select(F.col("query_id").cast("string"), "q").filter(F.size("q") == self.dims).mapInArrow(run, "query_id string, q array<float>, cell int")
        scored = self.cells.join(probed, "cell").select("query_id", "id", V.cosine(F.col("vector"), F.col("q")).alias("sim")).filter(~F.isnan("sim"))
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def choose_search(docs: DataFrame, enabled: bool, threshold: int = 1000) -> str:
    """'index' if enabled and at least `threshold` rows are embedded, else 'exact'."""
    return "index" if enabled and docs.filter("is_embedded and vector is not null").limit(threshold).count() >= threshold else "exact"
