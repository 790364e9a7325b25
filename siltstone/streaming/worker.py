"""Background embedding as a structured stream over a table's change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import filters
from siltstone.runtime import cut, cut_ordered, discard
from siltstone.schema import DOCUMENT, StoreError
from siltstone.sources.embedder import Embedder
from siltstone.sources.store import Store


def queue(docs: DataFrame, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """Documents to embed, oldest first, from behind the place `after` (created_at, id)."""
    q = docs.filter(filters.in_queue())
    if after is not None:
        at, id = F.lit(after[0]), F.lit(after[1])
        q = q.filter((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > id)))
    q = q.orderBy("created_at", "id")
    return q if limit is None else q.limit(limit)


COMPACT_AFTER = 64


def rounds(runs: list[tuple[int, int]], first: int) -> list[tuple[int | None, int | None]]:
    """Bounds [from, to) of places for `first` rows, then each time twice as many; None is open. runs: (place, rows) of consecutive places, in order."""
    bounds, size, want, seen = [], first, first, 0
    for place, rows in runs:
        while seen + rows > want:
            bounds.append(place + want - seen)
            size, want = 2 * size, want + 2 * size
        seen += rows
    return list(zip([None, *bounds], [*bounds, None], strict=True)) if seen else []


class Worker:
    """Each new change file of the table triggers one batch: what is in the queue then is embedded through the cache and its vectors are set.

    Idempotent: a batch that runs again finds its documents embedded already. The queue is read once and taken in rounds, oldest
    first: config.worker_batch documents, then each time twice as many, each written when it is done. So a failure costs one round, about as
    much as was done before it, and there are few rounds however long the queue is. In a round tasks take config.worker_batch documents each, or more
    where they would outnumber the cores."""

    def __init__(self, store: Store, embedder: Embedder):
        self.store, self.embedder = store, embedder
        self._drained: dict[tuple[str, str], tuple] = {}  # what the last drain of a table read and wrote

    def drain(self, db: str, table: str) -> int:
        """Embeds what waits now; returns how many documents."""
        done, after, first, own, batch = 0, None, None, [], max(1, self.store.config.worker_batch)
        while True:
            read = self.store._parts(db, table)
            first = first or read
            waits, runs = cut_ordered(queue(self.store.waiting(db, table, read), after=after), "created_at", "id")
            for k, (start, end) in enumerate(rounds(runs, batch)):
                rows = waits if start is None else waits.filter(F.col("_place") >= start)
                rows = rows if end is None else rows.filter(F.col("_place") < end)
                tasks = min(1 << k, 4 * self.store.spark.sparkContext.defaultParallelism)
                rows = self.store.embedded(db, rows.drop("_place"), self.embedder, tasks).filter("vector is not null")
                seq, n = self.store.set_vectors_of(db, table, rows, read, own)
                own += [seq] * (n > 0)
                done += n
            if not runs or self.store.unchanged(db, table, read, own):  # none came meanwhile
                break
            last = waits.orderBy(F.desc("_place")).select("created_at", "id").first()
            after = (last["created_at"], last["id"])  # documents that get no vector hold up none behind them
            discard(waits)
        discard(waits)
        self._drained[db, table] = first, own
        if len(self.store._log(db, table)) > COMPACT_AFTER:
            self.store.compact(db, table)
        return done

    def start(self, db: str, table: str, checkpoint: str, once: bool = False):
        """A streaming query; with `once` it ends when the files there are done."""
        if not self.store.config.embedding_job:
            raise StoreError("the embedding job is switched off")
        schema = T.StructType([*DOCUMENT.fields, T.StructField("op", T.StringType())])
        stream = self.store.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{self.store.base}/{db}/{table}/seq=*")

        def batch(rows: DataFrame, _: int) -> None:
            if (db, table) in self._drained and self.store.unchanged(db, table, *self._drained[db, table]):
                return  # the files were there already when the last drain read the table
            if not rows.filter((F.col("op") == "put") & filters.in_queue()).isEmpty():
                self.drain(db, table)

        out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        out = out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{self.store.config.worker_seconds} seconds")
        return out.start()
