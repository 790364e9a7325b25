"""Processing only new or changed records.

A run takes the records whose (key, version) pair no successful run has processed. Pairs are anti-joined
with the ledger of processed pairs, so a flag on the record, a run that crashed, a record that arrived late
and an attempt logged twice change nothing.

`IncrementalRuns` keeps such a ledger for any source. Each commit also keeps what its run took and didn't finish, and the oldest
transaction that was still open when it read the source. The next run rereads only what arrived since that transaction began,
adds what was left over, and the anti-join removes the overlap. The bound goes by arrival (a commit or load time), never by
a record's own version: an old version may arrive late. Where records carry no arrival, or a commit doesn't say what
its run took, the next run rereads everything: slower, but nothing is lost.

Defined cases: a null `vectorize` counts as true; rows with null key or version are never due; a repeated
row is due once by its key and version; a null arrival is always reread; ids in the ledger compare trimmed and in lower case;
an empty ledger makes all rows due; runs may commit in any order; a commit file without readable content is none.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from siltstone.runtime import ref_key


def version_ms(c: str) -> Column:
    """Whole epoch milliseconds, rounded down."""
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1000).cast("decimal(20,0)")).cast("long")


def processed_ledger(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct (key, version) that an attempt of a successful run finished.

    distinct() combines before its shuffle, so a document with very many attempts moves as one row per task and version.
    The runs come one a day; the join leaves their strategy to the planner's size estimate."""
    good = runs.filter(F.col("status") == "success").select("run_id").distinct()
    return (
        attempts.filter(F.col("outcome") == "done")
        .join(good, "run_id", "left_semi")
        .select(ref_key("document_id").alias("key"), F.col("version_ms").alias("version"))
        .filter(F.col("key").isNotNull() & F.col("version").isNotNull())
        .distinct()
    )


def unprocessed(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of records(key, version, ...) without their pair in the ledger."""
    return records.filter(F.col("key").isNotNull() & F.col("version").isNotNull()).join(ledger, ["key", "version"], "left_anti")


def due_documents(documents: DataFrame, attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Ids due for the next embedding run."""
    records = documents.filter(F.coalesce("vectorize", F.lit(True))).select(
        "id", ref_key("id").alias("key"), version_ms("updated_at").alias("version")
    )
    return unprocessed(records, processed_ledger(attempts, runs)).select("id").distinct()


@dataclass(frozen=True)
class RunMark:
    run_id: int
    oldest_open: int  # arrival before which this run, or one before it, has seen every record
    part: str  # names the folders of this commit
    complete: bool  # whether what the run took and didn't finish is known


class IncrementalRuns:
    """Ledger of processed (key, version) pairs below `path`.

    A commit writes its pairs and leftovers into folders of its own name first; one rename of a finished file then makes them part
    of the ledger. A crash anywhere before it leaves nothing that counts, and two processes can't write into each other's folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(self._conf)

    def _p(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _mark(self, name: str) -> RunMark | None:
        stream = self._fs.open(self._p(name))
        try:
            return RunMark(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        except (ValueError, TypeError):
            return None
        finally:
            stream.close()

    def marks(self) -> list[RunMark]:
        """Committed runs by number."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = (self._mark(n) for n in names if n.endswith(".commit") and not n.startswith("."))
        return sorted((m for m in found if m), key=lambda m: m.run_id)

    def _pairs(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], "key string, version long")
        return self.spark.read.schema("key string, version long").parquet(*(f"{self.path}/{n}" for n in names))

    def ledger(self) -> DataFrame:
        return self._pairs([f"done-{m.part}" for m in self.marks()])

    def pending(self, records: DataFrame, arrived: str | None = None) -> DataFrame:
        """What the next run must take of records(key, version, ...); arrived: the column of their arrival, in the unit of oldest_open."""
        marks = self.marks()
        known = [m for m in marks if m.complete]
        if arrived is not None and known:
            best = max(known, key=lambda m: (m.oldest_open, m.run_id))  # it has seen most, and knows what it left over
            fresh = F.col(arrived).isNull() | (F.col(arrived) >= best.oldest_open)
            left = self._pairs([f"left-{best.part}"])
            records = records.filter(fresh).unionByName(records.filter(~fresh).join(left, ["key", "version"], "left_semi"))
        return unprocessed(records, self.ledger())

    def commit(self, run_id: int, processed: DataFrame, oldest_open: int, taken: DataFrame | None = None) -> None:
        """Record the pairs of a run that ended well. A committed run can't be committed again.

        taken: what pending() gave the run; without it the next run rereads everything. oldest_open: arrival of the oldest
        transaction that was open when the run read the source."""
        name = f"{run_id}.commit"
        if self._fs.exists(self._p(name)):
            if self._mark(name):
                raise ValueError(f"run {run_id} is already committed")
            self._fs.delete(self._p(name), False)
        part = f"{run_id}-{uuid.uuid4().hex}"
        processed.select("key", "version").distinct().write.parquet(f"{self.path}/done-{part}")
        if taken is not None:
            done = self._pairs([f"done-{part}"])
            taken.select("key", "version").distinct().join(done, ["key", "version"], "left_anti").write.parquet(f"{self.path}/left-{part}")
        draft = f".{part}.draft"
        out = self._fs.create(self._p(draft), False)
        out.write(bytearray(json.dumps(asdict(RunMark(run_id, int(oldest_open), part, taken is not None))).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)  # no overwriting
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._p(draft), self._p(name), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise ValueError(f"run {run_id} was committed by another process") from e
            raise
