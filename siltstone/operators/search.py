"""Full-text, vector and hybrid search. Filters run before every top-k; payloads join after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vector as V
from siltstone.functions.text import tokens
from siltstone.plans import fts_query
from siltstone.schema import SearchType

K1, B, RRF = 1.2, 0.75, 60


def _tokenised(docs: DataFrame, key: str, content: str, *more: Column) -> DataFrame:
    """(id, ..., t): the tokens come out of a generator, which no predicate is pushed through, so they are made once a row."""
    text = tokens(F.coalesce(F.col(content), F.lit("")))
    return docs.select(F.col(key).alias("id"), *more, F.explode(F.array(text)).alias("t"))


def fts_match(docs: DataFrame, query: str, key: str = "id", content: str = "content") -> DataFrame:
    """(id) of the documents that a query matches."""
    tree = fts_query.parse(query)
    return _tokenised(docs, key, content).filter(fts_query.matches(tree, F.col("t"))).select("id")


def _bm25(counts: DataFrame, stats: DataFrame, ps: list, wanted: Column) -> DataFrame:
    """(id, rank) from counts(id, dl, hit, f0...) and one row of stats(n, avgdl, df0...)."""

    def part(i: int) -> Column:
        df, f = F.col(f"df{i}"), F.col(f"f{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    hits = counts.filter(F.col("hit") & wanted).crossJoin(F.broadcast(stats))  # one row of statistics
    return hits.select("id", (-reduce(lambda a, b: a + b, (part(i) for i in range(len(ps))))).alias("rank"))


def fts_scores(docs: DataFrame, query: str, key: str = "id", content: str = "content", where: Column | None = None) -> DataFrame:
    """(id, rank) of matching documents; rank is negative BM25, best lowest. Statistics cover every row, `where` only the hits.

    One pass gives the phrase counts; the statistics are one row, joined by broadcast."""
    tree = fts_query.parse(query)
    ps = list(dict.fromkeys(fts_query.phrases(tree)))
    t = _tokenised(docs, key, content, (where if where is not None else F.lit(True)).alias("wanted"))
    counts = t.select("id", "wanted", F.size("t").alias("dl"), fts_query.matches(tree, F.col("t")).alias("hit"), *(p.count(F.col("t")).alias(f"f{i}") for i, p in enumerate(ps)))
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(ps))))
    return _bm25(counts, stats, ps, F.col("wanted"))


class Postings:
    """Full-text postings: one row an occurrence (term, id, pos, dl), in ranges of (term, id) and sorted, so a query reads the row groups
    of its words alone and a word that every document holds spreads over files; beside them one row of corpus statistics."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows, self.stats = spark.read.parquet(f"{self.path}/rows"), spark.read.parquet(f"{self.path}/stats")

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "id", content: str = "content") -> Postings:
        t = _tokenised(docs, key, content)
        rows = t.select("id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term")).select("term", "id", "pos", "dl")
        cls._lay(rows, path)
        t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(docs.sparkSession, path)

    @staticmethod
    def _lay(rows: DataFrame, path: str) -> None:
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id", "pos").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")

    def updated(self, changed: DataFrame, gone: DataFrame, path: str, key: str = "id", content: str = "content") -> Postings:
        """Postings at a new path, with the documents of `changed` put in anew and those of `gone`(id) taken out."""
        new = _tokenised(changed, key, content)
        ids = changed.select(F.col(key).alias("id")).unionByName(gone.select("id")).distinct()
        old = self.rows.join(ids, "id", "left_semi").select("id", "dl").distinct().agg(F.count("*").alias("a"), F.coalesce(F.sum("dl"), F.lit(0)).alias("b"))
        add = new.select("id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term")).select("term", "id", "pos", "dl")
        self._lay(self.rows.join(ids, "id", "left_anti").select("term", "id", "pos", "dl").unionByName(add), path)
        put = new.agg(F.count("*").alias("c"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("d"))
        stats = self.stats.crossJoin(old).crossJoin(put)  # one row each
        stats.select((F.col("n") - F.col("a") + F.col("c")).alias("n"), (F.col("tokens") - F.col("b") + F.col("d")).alias("tokens")).write.mode("overwrite").parquet(f"{path}/stats")
        return Postings(self.spark, path)

    def scores(self, query: str) -> DataFrame:
        """(id, rank) as fts_scores gives them."""
        tree = fts_query.parse(query)
        ps = list(dict.fromkeys(fts_query.phrases(tree)))
        tested = fts_query.every_phrase(tree)
        words = {w for p in tested for w in (p.words[:-1] if p.prefix else p.words)}
        ends = {p.words[-1] for p in tested if p.prefix}
        asked = reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in sorted(ends)], F.col("term").isin(sorted(words)))
        held = self.rows.filter(asked).groupBy("id").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("h"))
        # the document's tokens with blanks for all other words: positions and distances stay
        gap = lambda h, j: h["pos"] - F.coalesce(F.get("h", j - 1)["pos"], F.lit(-1)) - 1
        sparse = F.flatten(F.transform("h", lambda h, j: F.concat(F.array_repeat(F.lit(""), gap(h, j)), F.array(h["term"]))))
        t = held.select("id", "dl", F.explode(F.array(sparse)).alias("t"))
        counts = t.select("id", "dl", fts_query.matches(tree, F.col("t")).alias("hit"), *(p.count(F.col("t")).alias(f"f{i}") for i, p in enumerate(ps)))
        df = counts.agg(*(F.coalesce(F.sum((F.col(f"f{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(ps))))
        stats = self.stats.select("n", (F.col("tokens") / F.col("n")).alias("avgdl")).crossJoin(df)  # one row each
        return _bm25(counts, stats, ps, F.lit(True))


def fts_topk(docs: DataFrame, query: str, limit: int, key: str = "id", content: str = "content", where: Column | None = None, postings: Postings | None = None) -> DataFrame:
    """The best `limit`; with postings of these documents only their rows for the query's words are read."""
    if postings is None:
        scores = fts_scores(docs, query, key, content, where)
    else:
        scores = postings.scores(query)
        if where is not None:
            scores = scores.join(docs.filter(where).select(F.col(key).alias("id")), "id", "left_semi")
    return scores.orderBy("rank", "id").limit(limit)


def vector_topk(docs: DataFrame, query: list[float], limit: int, key: str = "id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """(id, sim): exact cosine top-k; zero and mismatched vectors score 0 and stay, NaN drops out."""
    rows = docs if where is None else docs.filter(where)
    sim = V.cosine(F.col(vector), V.literal(query))
    scored = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), sim.alias("sim")).filter(~F.isnan("sim"))
    return scored.orderBy(F.desc("sim"), "id").limit(limit)


def vector_batch(docs: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", most_queries: int = 4096) -> DataFrame:
    """(query_id, id, sim, rank) for a bounded set of queries(query_id, q): the queries are sent to the rows, never rows to rows."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries: search in blocks or use the index")
    rows = docs.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    scored = rows.crossJoin(F.broadcast(queries.select("query_id", "q"))).select("query_id", "id", V.cosine(F.col("v"), F.col("q")).alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return scored.filter(~F.isnan("sim")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(fts: DataFrame, vec: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of fts(id, rank) and vec(id, sim), both cut before: (id, score, fts_rank, vector_similarity)."""
    a = fts.select("id", F.col("rank").alias("fts_rank"), F.row_number().over(Window.orderBy("rank", "id")).alias("ra"))
    b = vec.select("id", F.col("sim").alias("vector_similarity"), F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("rb"))
    share = lambda r: F.coalesce(1.0 / (F.lit(RRF) + F.col(r)), F.lit(0.0))
    both = a.join(b, "id", "full_outer").select("id", (share("ra") + share("rb")).alias("score"), "fts_rank", "vector_similarity")
    return both.orderBy(F.desc("score"), "id").limit(limit)


def search(
    docs: DataFrame, query: str, limit: int = 10, vector: list[float] | None = None, kind: SearchType | str = SearchType.HYBRID,
    where: Column | None = None, include_chunks: bool = True, threshold: float | None = None, index=None, postings: Postings | None = None,
) -> DataFrame:
    """The search facade: result rows best first. Hybrid without a query vector is full text alone; limit applies last.

    index: a VectorIndex of these documents that takes the place of the exact comparison; hits that are no longer there, or that
    `where` drops, are left out, so fewer rows may come. postings: Postings of these documents, read in place of their texts."""
    kind = SearchType(kind)
    if not include_chunks:
        where = (where if where is not None else F.lit(True)) & ~F.coalesce("is_chunk", F.lit(False))
    none = F.lit(None).cast("double")

    def nearest(n: int) -> DataFrame:
        if index is None:
            return vector_topk(docs, vector, n, where=where)
        alive = docs if where is None else docs.filter(where)
        return F.broadcast(index.search(vector, n)).join(alive.select("id"), "id")  # at most n rows

    if kind is SearchType.VECTOR:
        if vector is None:
            raise ValueError("a vector search needs a vector")
        top = nearest(limit).select("id", F.col("sim").alias("score"), none.alias("fts_rank"), F.col("sim").alias("vector_similarity"))
    elif kind is SearchType.FULLTEXT or vector is None:
        top = fts_topk(docs, query, limit, where=where, postings=postings).select("id", F.col("rank").alias("score"), F.col("rank").alias("fts_rank"), none.alias("vector_similarity"))
    else:
        top = fuse(fts_topk(docs, query, 2 * limit, where=where, postings=postings), nearest(2 * limit), limit)
    if threshold is not None:
        top = top.filter(F.col("score") >= threshold)
    payload = docs.select("id", "content", "metadata", "is_chunk", "parent_id", "chunk_index")
    out = F.broadcast(top).join(payload, "id")  # at most `limit` rows
    return out.select("id", "content", "metadata", "score", "fts_rank", "vector_similarity", "is_chunk", "parent_id", "chunk_index").orderBy(F.desc("score") if kind is not SearchType.FULLTEXT and vector is not None else F.col("score"), "id")


def group_by_parent(results: DataFrame, chunks_each: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(parent, max_score, hits, best): results collapsed under their parent, or themselves where they have none.

    With `documents` also parent_metadata and chunks, the hits of each parent best first (results are at most a search's limit)."""
    parent = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.col("id"))
    order = Window.partitionBy("parent").orderBy(F.desc("score"), "id")
    r = results.withColumn("parent", parent).withColumn("r", F.row_number().over(order))
    if chunks_each is not None:
        r = r.filter(F.col("r") <= chunks_each)
    cols = [F.max("score").alias("max_score"), F.count("*").alias("hits"), F.max(F.when(F.col("r") == 1, F.col("id"))).alias("best")]
    if documents is None:
        return r.groupBy("parent").agg(*cols)
    hit = F.struct("r", "id", "chunk_index", "score", "content")
    out = r.groupBy("parent").agg(*cols, F.sort_array(F.collect_list(hit)).alias("chunks"))
    above = documents.select(F.col("id").alias("parent"), F.col("metadata").alias("parent_metadata"))
    return out.join(above, "parent", "left").orderBy(F.desc("max_score"), "parent")
