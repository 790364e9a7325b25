"""Session helpers shared by every operator: table access, checkpoints, partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(cores: int = 8, app: str = "siltstone", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows below the checkpoint folder and reads them back.

    The table survives the loss of executors like a reliable checkpoint, later plans read only the columns they need and see its
    real size; checkpoint() keeps the estimate of the plan behind it, which multiplies with each join of a loop."""
    return cut_counting(df)[0]


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut() together with aggregates of the rows, taken while they are written."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    schema, got = df.schema, {}
    if counts:
        seen = Observation()
        df.observe(seen, *(c.alias(k) for k, c in counts.items())).write.parquet(path)
        got = seen.get
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._cut_path = path
    return out, {k: int(got.get(k) or 0) for k in counts}


def cut_ordered(df: DataFrame, *order: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """cut() of the rows in order, with a `_place` that grows along it; and the runs of consecutive places, one a partition: (first place, rows)."""
    plain = cut(df)  # a sort by ranges evaluates its input twice
    out = cut(plain.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    discard(plain)
    runs = out.groupBy(F.shiftright("_place", 33)).agg(F.min("_place").alias("place"), F.count(F.lit(1)).alias("rows")).collect()
    return out, sorted((r["place"], r["rows"]) for r in runs)


class Levels:
    """Rows that a loop adds level by level: one folder of the checkpoint folder, one job a level, one scan for all levels."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count, self._schema = spark, f"{ensure_checkpoint_dir(spark)}/levels-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame, **counts: Column) -> dict[str, int]:
        """Writes the next level; gives its number of rows as `rows`, and further counts."""
        self._schema = self._schema or T.StructType([*df.schema.fields, T.StructField("level", T.IntegerType())])
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items())).write.parquet(f"{self.path}/level={self.count}")
        self.count += 1
        return {k: int(seen.get.get(k) or 0) for k in ("rows", *counts)}

    def rows(self, level: int | None = None) -> DataFrame:
        """All rows with their level, or those of one."""
        read = self.spark.read.schema(self._schema).option("basePath", self.path)
        return read.parquet(self.path if level is None else f"{self.path}/level={level % self.count}")


def discard(df: DataFrame) -> None:
    """Deletes a table of cut() that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ref_key(c: Column | str) -> Column:
    """Comparable form of an id or reference: trimmed, lower case, empty as null."""
    k = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(k != "", k)


def blocks(rows: int, target: int) -> int:
    """Power-of-two number of blocks so that one holds about `target` rows."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, rows / target))))
