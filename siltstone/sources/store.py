"""The store: databases and tables as change logs on Parquet, read through latest-wins views.

A table is a folder of change files. Each write appends one file set under the next sequence number, staged and
moved into place by one rename, so a reader sees a write whole or not at all. `compact` rewrites the changes listed at its start as a
base of that number; a write that lands meanwhile has a higher number and stays on top of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import ann, chunking, filters
from siltstone.operators import cache as C
from siltstone.operators import graph as G
from siltstone.operators import search as S
from siltstone.runtime import Levels, cut, cut_counting
from siltstone.schema import CACHE, DOCUMENT, RELATION, Config, StoreError, check_name
from siltstone.sources import embedder as E

RELATIONS, CACHE_TABLE = "document_relations", "embedding_cache"


def latest(changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Current rows of a change log (op 'put' or 'delete'): the last put of each key after which no delete came;
    created_at is that of the first put since the last delete."""
    w = Window.partitionBy(key)
    dead = F.max(F.when(F.col("op") == "delete", F.col(seq))).over(w)
    alive = changes.withColumn("_dead", dead).filter((F.col("op") == "put") & (F.col("_dead").isNull() | (F.col(seq) > F.col("_dead"))))
    born = F.min_by("created_at", seq).over(w)
    last = F.row_number().over(w.orderBy(F.desc(seq)))
    return alive.withColumn("_born", born).withColumn("_k", last).filter("_k = 1").withColumn("created_at", F.col("_born")).drop("_dead", "_born", "_k", "op", seq)


def cascade(documents: DataFrame, dead: DataFrame) -> DataFrame:
    """Ids of dead(id) and of all that hang below them."""
    links = documents.filter("parent_id is not null").select("id", "parent_id")
    levels = Levels(documents.sparkSession)
    new = levels.add(dead.select("id").distinct())
    while new["rows"]:
        newest = levels.rows(-1).select(F.col("id").alias("parent_id"))
        below = links.join(newest, "parent_id", "left_semi").select("id").distinct()
        new = levels.add(below.join(levels.rows().select("id"), "id", "left_anti"))
    return levels.rows().select("id")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows as the store keeps them: flags follow the vector, token counts are estimated where missing, ids are made where missing."""
    now, have = F.current_timestamp(), set(rows.columns)
    col = lambda c, d: F.coalesce(F.col(c), d) if c in have else d
    cast = {f.name: f.dataType for f in DOCUMENT}
    vec = F.col("vector") if "vector" in have else F.lit(None).cast(cast["vector"])
    null = lambda c: F.col(c).cast(cast[c]) if c in have else F.lit(None).cast(cast[c])
    from siltstone.functions.text import estimate_tokens

    return rows.select(
        col("id", F.uuid()).alias("id"), "content", col("metadata", F.lit("{}")).alias("metadata"), null("tags").alias("tags"), vec.cast(cast["vector"]).alias("vector"),
        col("created_at", now).alias("created_at"), col("updated_at", now).alias("updated_at"), vec.isNotNull().alias("is_embedded"), col("vectorize", F.lit(True)).alias("vectorize"),
        col("is_chunk", F.lit(False)).alias("is_chunk"), null("parent_id").alias("parent_id"), null("chunk_index").alias("chunk_index"),
        col("token_count", estimate_tokens(F.col("content"))).cast("int").alias("token_count"), vec.isNotNull().alias("is_vectorized"),
    )


def with_vectors(rows: DataFrame) -> DataFrame:
    """Rows as a change that sets their vectors."""
    return rows.withColumns({"updated_at": F.current_timestamp(), "is_embedded": F.lit(True), "is_vectorized": F.lit(True)}).select(*DOCUMENT.names)


class Store:
    def __init__(self, spark: SparkSession, base: str, config: Config | None = None):
        self.spark, self.base, self.config = spark, base.rstrip("/"), config or Config()
        self._jvm = spark._jvm
        self._root = self._path("")
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._root)

    # files
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def _names(self, where: str) -> list[str]:
        p = self._path(where)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _parts(self, db: str, table: str) -> tuple[int, list[int]]:
        """Number of the base (0 without one) and those of the changes on top of it."""
        names = self._names(f"{check_name(db)}/{check_name(table)}")
        base = max((int(n[5:]) for n in names if n.startswith("base=")), default=0)
        return base, sorted(k for k in (int(n[4:]) for n in names if n.startswith("seq=")) if k > base)

    def _log(self, db: str, table: str) -> list[int]:
        base, seqs = self._parts(db, table)
        return [base] * (base > 0) + seqs

    def _append(self, db: str, table: str, rows: DataFrame, op: str, counted: bool = False) -> int | tuple[int | None, int]:
        """Number of the change; when counted, with that of its rows, and without rows there is no change."""
        where = f"{check_name(db)}/{check_name(table)}"
        seen, staged = Observation(), f"{where}/_staged-{uuid.uuid4().hex}"
        rows = rows.withColumn("op", F.lit(op))
        if counted:
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.parquet(f"{self.base}/{staged}")
        if counted and not seen.get.get("rows"):
            self._fs.delete(self._path(staged), True)
            return None, 0
        for seq in range((self._log(db, table) or [0])[-1] + 1, 1 << 31):
            goal = self._path(f"{where}/seq={seq}")
            if not self._fs.exists(goal) and self._fs.rename(self._path(staged), goal):
                return (seq, int(seen.get["rows"])) if counted else seq
        raise StoreError("no sequence number is free")

    # catalog
    def databases(self) -> list[str]:
        return self._names("")

    def tables(self, db: str) -> list[str]:
        return [t for t in self._names(check_name(db)) if t not in (RELATIONS, CACHE_TABLE) and not t.startswith(("_", "."))]

    def ensure_table(self, db: str, table: str) -> None:
        if not self._log(db, table):
            self._append(db, table, self.spark.createDataFrame([], DOCUMENT), "put")

    def drop_table(self, db: str, table: str) -> bool:
        return self._fs.delete(self._path(f"{check_name(db)}/{check_name(table)}"), True)

    def drop_database(self, db: str) -> bool:
        return self._fs.delete(self._path(check_name(db)), True)

    # reads
    def _changes(self, db: str, table: str, schema, parts: tuple[int, list[int]] | None = None) -> DataFrame:
        base, seqs = parts or self._parts(db, table)
        full = T.StructType([*schema.fields, T.StructField("op", T.StringType())])
        where, out = f"{self.base}/{db}/{table}", None
        if seqs:  # one scan, however many changes
            read = self.spark.read.schema(T.StructType([*full.fields, T.StructField("seq", T.IntegerType())])).option("basePath", where)
            out = read.parquet(*(f"{where}/seq={k}" for k in seqs))
        if base:
            old = self.spark.read.schema(full).parquet(f"{where}/base={base}").withColumn("seq", F.lit(base))
            out = old if out is None else old.unionByName(out)
        if out is None:
            return self.spark.createDataFrame([], schema).withColumn("op", F.lit("put")).withColumn("seq", F.lit(0))
        return out

    def documents(self, db: str, table: str) -> DataFrame:
        return latest(self._changes(db, table, DOCUMENT))

    def waiting(self, db: str, table: str, parts: tuple[int, list[int]] | None = None) -> DataFrame:
        """Current rows that wait for a vector. Ids that never came so don't reach the window."""
        changes = self._changes(db, table, DOCUMENT, parts)
        came = changes.filter((F.col("op") == "put") & filters.in_queue()).select("id")
        return latest(changes.join(came, "id", "left_semi")).filter(filters.in_queue())

    def unchanged(self, db: str, table: str, parts: tuple[int, list[int]], own: list[int]) -> bool:
        """Whether the table has nothing but these parts and the caller's own writes."""
        base, seqs = self._parts(db, table)
        return base == parts[0] and not set(seqs) - set(parts[1]) - set(own)

    def relations(self, db: str) -> DataFrame:
        return latest(self._changes(db, RELATIONS, RELATION))

    def get(self, db: str, table: str, id: str) -> dict:
        rows = self.documents(db, table).filter(F.col("id") == id).limit(1).collect()
        if not rows:
            raise KeyError(id)
        return rows[0].asDict()

    def listing(self, db: str, table: str, limit: int = 1000) -> DataFrame:
        return self.documents(db, table).orderBy("created_at", "id").limit(limit)

    def root_listing(self, db: str, table: str, scan: int = 1000, limit: int = 100) -> DataFrame:
        return list_roots(self.documents(db, table), scan, limit)

    def info(self, db: str, table: str) -> DataFrame:
        return table_info(self.documents(db, table))

    # writes
    def upsert(self, db: str, table: str, rows: DataFrame) -> int:
        """Puts whole rows; of rows with one id in a batch the last by updated_at stays."""
        ready, seen = cut_counting(prepared(rows), empty=F.count_if(F.coalesce("content", F.lit("")) == ""))  # made ids must not change between checks and the write
        if seen["empty"]:
            raise StoreError("empty content")
        if not ready.groupBy("id").count().filter("count > 1").isEmpty():  # else the rows need not be shuffled
            w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("content"))
            ready = ready.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
        return self._append(db, table, ready, "put")

    def add(self, db: str, table: str, content: str, id: str | None = None, metadata: str = "{}", tags: list[str] | None = None, parent_id: str | None = None) -> str:
        """One document without a vector; gives its id."""
        id = id or str(uuid.uuid4())
        row = self.spark.createDataFrame([(id, content, metadata, tags, parent_id)], "id string, content string, metadata string, tags array<string>, parent_id string")
        self.upsert(db, table, row)
        return id

    def set_vectors(self, db: str, table: str, vectors: DataFrame) -> int:
        """vectors(id, vector) for ids that live."""
        docs = self.documents(db, table).drop("vector")
        return self._append(db, table, with_vectors(docs.join(vectors.select("id", "vector"), "id")), "put")

    def set_vectors_of(self, db: str, table: str, rows: DataFrame, parts: tuple[int, list[int]], own: list[int]) -> tuple[int | None, int]:
        """Sets the vectors of whole rows that were read from these parts; gives number of the change (None without rows) and of its rows.

        If others than the caller wrote since, current rows of the same content get them; those of another content wait for their own."""
        if not self.unchanged(db, table, parts, own):
            changes = self._changes(db, table, DOCUMENT).join(rows.select("id"), "id", "left_semi")
            rows = latest(changes).drop("vector").join(rows.select("id", "content", "vector"), ["id", "content"])
        return self._append(db, table, with_vectors(rows), "put", counted=True)

    def delete(self, db: str, table: str, ids: list[str], cascade_relations: bool = False) -> None:
        """Documents with all that hang below them. A row with a parent can't be deleted alone; a missing id is no error."""
        docs = self.documents(db, table)
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        if docs.join(asked, "id", "left_semi").filter("coalesce(trim(parent_id), '') <> ''").limit(1).count():
            raise StoreError("a child can't be deleted without its parent")
        dead = cascade(docs, asked)
        self._append(db, table, docs.join(dead, "id", "left_semi"), "delete")
        if cascade_relations:
            rel = self.relations(db)
            ends = dead.withColumnRenamed("id", "d")
            self._append(db, RELATIONS, rel.join(ends, (F.col("d") == F.col("source_id")) | (F.col("d") == F.col("target_id")), "left_semi"), "delete")

    def delete_chunks(self, db: str, table: str, parent: str) -> None:
        docs = self.documents(db, table)
        self._append(db, table, docs.filter((F.col("parent_id") == parent) & F.col("is_chunk")), "delete")

    def rechunk(self, db: str, table: str, id: str) -> DataFrame:
        """Replaces a document's chunks by fixed windows, whatever the strategy; the document stays as it is."""
        self.get(db, table, id)
        before = cut(self.documents(db, table))
        after = chunking.rechunk(before, id, self.config.chunk_size, self.config.chunk_overlap)
        new = cut(after.filter((F.col("parent_id") == id) & F.col("is_chunk")))
        self.delete_chunks(db, table, id)
        self._append(db, table, new.select(*DOCUMENT.names), "put")
        return chunking.chunks_of(self.documents(db, table), id)

    def relate(self, db: str, rows: DataFrame) -> int:
        """New relations (source_id, target_id, relation_type, ...); a triple that exists, or comes twice, is refused."""
        self._relations_on()
        have = set(rows.columns)
        new = cut(
            rows.select(
                (F.coalesce("id", F.uuid()) if "id" in have else F.uuid()).alias("id"), "source_id", "target_id", "relation_type",
                (F.col("metadata") if "metadata" in have else F.lit("{}")).alias("metadata"), (F.col("created_at") if "created_at" in have else F.current_timestamp()).alias("created_at"),
            )
        )
        if duplicate_relations(self.relations(db), new).limit(1).count():
            raise StoreError("a relation of this source, target and type exists")
        return self._append(db, RELATIONS, new, "put")

    def get_relation(self, db: str, id: str) -> dict:
        rows = self.relations(db).filter(F.col("id") == id).limit(1).collect()
        if not rows:
            raise KeyError(id)
        return rows[0].asDict()

    def delete_relation(self, db: str, id: str) -> None:
        self._append(db, RELATIONS, self.relations(db).filter(F.col("id") == id), "delete")

    def compact(self, db: str, table: str) -> None:
        """Rewrites what is there now as one base; readers switch to it by its rename, and only then do the old files go."""
        base, seqs = parts = self._parts(db, table)
        if not seqs:
            return
        where, schema = f"{check_name(db)}/{check_name(table)}", RELATION if table == RELATIONS else DOCUMENT
        staged = f"{where}/_staged-{uuid.uuid4().hex}"
        latest(self._changes(db, table, schema, parts)).withColumn("op", F.lit("put")).write.parquet(f"{self.base}/{staged}")
        if not self._fs.rename(self._path(staged), self._path(f"{where}/base={seqs[-1]}")):
            raise StoreError("another compaction of this table ended first")
        for name in [f"seq={k}" for k in seqs] + [f"base={base}"] * (base > 0):
            self._fs.delete(self._path(f"{where}/{name}"), True)

    # pipeline
    def cache(self, db: str) -> DataFrame:
        return self._changes(db, CACHE_TABLE, CACHE).drop("op", "seq")

    def embedded(self, db: str, rows: DataFrame, embedder: E.Embedder, tasks: int | None = None) -> DataFrame:
        """rows, which must be those of a table, with vectors where vectorize holds, each text embedded once: from the cache where it is switched on, else from the embedder.

        tasks: among how many the texts are dealt out; by default by their size, which is little beside what embedding costs."""
        todo = rows.filter(F.coalesce("vectorize", F.lit(True)))
        have = self.cache(db) if self.config.embedding_cache else self.spark.createDataFrame([], CACHE)
        miss = C.misses(todo, have, embedder.model)
        new = E.embed(miss if tasks is None else miss.repartition(tasks), embedder).withColumns({"model": F.lit(embedder.model), "created_at": F.current_timestamp()})
        new, made = cut_counting(new, vectors=F.count("vector"))
        new = new.select("content_hash", "model", "vector", "created_at")
        if self.config.embedding_cache and made["vectors"]:
            self._append(db, CACHE_TABLE, new.filter("vector is not null"), "put")
        got = C.probe(rows.drop("content_hash"), have.select(new.columns).unionByName(new), embedder.model)
        vec = F.when(F.coalesce("vectorize", F.lit(True)), F.coalesce("cached_vector", "vector")).otherwise(F.col("vector"))
        return got.withColumn("vector", vec).drop("cached_vector", "content_hash")

    def ingest(self, db: str, table: str, rows: DataFrame, embedder: E.Embedder | None = None, wait: bool = True, tokenizer: chunking.Tokenizer | None = None) -> int:
        """Validate, chunk by the configured strategy, embed if that is switched on, then one write. Without `wait` the worker embeds later.

        With a tokenizer the chunking threshold and windows count its tokens."""
        ready = cut(prepared(rows))
        if ready.filter("content is null or content = ''").limit(1).count():
            raise StoreError("empty content")
        if self.config.chunking:
            ready = chunking.auto_chunk(ready, self.config.chunk_threshold, self.config.chunk_size, self.config.chunk_overlap, self.config.chunk_strategy, tokenizer)
        if self.config.embedding and embedder is not None and wait:
            ready = self.embedded(db, cut(ready), embedder)
        return self.upsert(db, table, ready)

    def snapshot(self, db: str, path: str) -> None:
        kinds = {RELATIONS: self.relations, CACHE_TABLE: self.cache}
        for t in [*self.tables(db), *(k for k in kinds if self._log(db, k))]:
            (kinds[t](db) if t in kinds else self.documents(db, t)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{t}")

    def restore(self, db: str, path: str) -> None:
        self.drop_database(db)
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        for s in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p):
            name = s.getPath().getName()
            self._append(db, name, self.spark.read.parquet(f"{path.rstrip('/')}/{name}"), "put")

    # search and graph
    def search(self, db: str, table: str, query: str, limit: int = 10, vector: list[float] | None = None, group: bool = False, index: ann.VectorIndex | None = None, **kw) -> DataFrame:
        """Result rows best first; with `group` collapsed under their parents. An index of the table is used where the configuration
        says so and the table is large enough."""
        docs = self.documents(db, table)
        use = index if index is not None and ann.choose_search(docs, self.config.vector_index, self.config.index_threshold) == "index" else None
        found = S.search(docs, query, limit, vector, index=use, **kw)
        return S.group_by_parent(found, documents=docs) if group else found

    def _graph(self, db: str, types: list[str] | None) -> DataFrame:
        return G.of_types(self.relations(db), types)

    def _relations_on(self) -> None:
        if not self.config.document_relations:
            raise StoreError("relations are switched off")

    def traverse(self, db: str, start: str, depth: int, types: list[str] | None = None) -> DataFrame:
        self._relations_on()
        return G.bfs(self._graph(db, types), start, depth)

    def path(self, db: str, start: str, goal: str, types: list[str] | None = None) -> DataFrame:
        if not start or not goal:
            raise StoreError("a path needs two ends")
        return G.shortest_path(self._graph(db, types), start, goal)

    def graph_statistics(self, db: str) -> DataFrame:
        return G.statistics(self._graph(db, None))


def duplicate_relations(have: DataFrame, new: DataFrame) -> DataFrame:
    """New relations whose triple exists or comes again within the new ones."""
    keys = ["source_id", "target_id", "relation_type"]
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "id"))
    again = new.withColumn("_k", k).filter("_k > 1").drop("_k")
    return new.join(have.select(*keys), keys, "left_semi").unionByName(again).distinct()


def list_roots(docs: DataFrame, scan: int = 1000, limit: int = 100) -> DataFrame:
    """The first `scan` by age, of these the roots, of these the first `limit`."""
    first = docs.orderBy("created_at", "id").limit(scan)
    return first.filter(F.coalesce(F.trim("parent_id"), F.lit("")) == "").orderBy("created_at", "id").limit(limit)


def table_info(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("document_count"), F.count(F.when(F.coalesce("is_embedded", F.lit(False)), 1)).alias("embedded_count"),
        F.min("created_at").alias("first_created"), F.max("updated_at").alias("last_updated"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("content_bytes"),
    )
