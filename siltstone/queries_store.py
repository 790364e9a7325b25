"""Queries of the store's own operators, each with its SQL for the oracle where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vector as V
from siltstone.operators import ann, cache, chunking, filters, graph, search
from siltstone.runtime import ensure_checkpoint_dir, table
from siltstone.schema import Config
from siltstone.sources import logs, wire
from siltstone.sources.embedder import HashEmbedder
from siltstone.sources.store import Store, cascade, duplicate_relations, latest, list_roots, table_info
from siltstone.streaming.worker import Worker, queue

MODEL = "text-embed-a"
QUERY = "river OR lamp OR letter"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as store rows: id, content, tags (lang, source), metadata, vector by vec_id."""
    t = table(spark, d, "documents")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    meta = F.to_json(F.struct("lang", "source", "n_chars"))
    r = t.join(e, "doc_id", "left")
    return r.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), meta.alias("metadata"), F.array_compact(F.array("lang", "source")).alias("tags"), "vector",
        F.col("uploaded_at").alias("created_at"), F.col("received_at").alias("updated_at"), F.col("vector").isNotNull().alias("is_embedded"), F.lit(True).alias("vectorize"), F.lit(False).alias("is_chunk"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("token_count"), F.col("vector").isNotNull().alias("is_vectorized"),
    )


def store_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "store_documents")


def relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_relations")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def start_node(spark: SparkSession, d: str) -> str:
    """The source with most relations, smallest id first."""
    return relations(spark, d).groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()["source_id"]


def _sim(df: DataFrame, c: str = "sim") -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] * {b}[i] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"({_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)})))"


_D = """d AS (SELECT t.doc_id, CAST(t.doc_id AS VARCHAR) AS id, t.text AS content, t.lang, t.source, t.n_chars, e.embedding AS vector, t.uploaded_at AS created_at, t.received_at AS updated_at
  FROM documents t LEFT JOIN embeddings e ON e.vec_id = t.doc_id)"""
_Q = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


# ---------------------------------------------------------------- vector search
@query(f"WITH {_Q} SELECT CAST(vec_id AS VARCHAR) AS id, round({_cos('embedding', 'q')}, 6) AS sim FROM embeddings, q ORDER BY {_cos('embedding', 'q')} DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def vec_exact_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return _sim(search.vector_topk(e, query_vector(spark, d), 10))


@query(f"WITH {_Q} SELECT CAST(vec_id AS VARCHAR) AS id, round({_cos('embedding', 'q')}, 6) AS sim FROM embeddings, q WHERE label = 3 ORDER BY {_cos('embedding', 'q')} DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def vec_topk_filtered(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    return _sim(search.vector_topk(e, query_vector(spark, d), 10, where=F.col("label") == 3))


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_cos("a.embedding", "b.embedding")} AS sim FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a, embeddings b)
SELECT query_id, id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5"""
)
def vec_batch_knn(spark, d):
    """A stated query set (ids divisible by 100) against all rows."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return _sim(search.vector_batch(e, q, 5, key="vec_id", vector="embedding"))


@query("SELECT * FROM (VALUES ('longer', 0.0), ('minus', -1.0), ('same', 1.0), ('zero', 0.0)) t(id, sim)")
def vec_edge_cases(spark, d):
    rows = spark.createDataFrame([("zero", [0.0, 0.0]), ("longer", [1.0, 2.0, 3.0]), ("minus", [-3.0, -4.0]), ("same", [6.0, 8.0])], "id string, vector array<float>")
    return _sim(search.vector_topk(rows, [3.0, 4.0], 10))


@query("SELECT count(*) AS embedded FROM store_documents WHERE is_embedded AND vector IS NOT NULL")
def embedded_count(spark, d):
    return store_docs(spark, d).filter(filters.embedded()).agg(F.count("*").alias("embedded"))


@query("SELECT id FROM store_documents WHERE NOT coalesce(is_embedded, false) AND coalesce(vectorize, true) ORDER BY created_at, id LIMIT 100")
def embed_queue(spark, d):
    return queue(store_docs(spark, d), 100).select("id")


@query(
    """SELECT count(*) AS document_count, count(*) FILTER (WHERE is_embedded) AS embedded_count, min(created_at) AS first_created, max(updated_at) AS last_updated,
CAST(sum(strlen(content)) AS BIGINT) AS content_bytes FROM store_documents"""
)
def db_info(spark, d):
    return table_info(store_docs(spark, d))


@query("SELECT id, created_at FROM store_documents ORDER BY created_at, id LIMIT 1000")
def list_documents(spark, d):
    return store_docs(spark, d).orderBy("created_at", "id").limit(1000).select("id", "created_at")


@query("SELECT id, content FROM store_documents WHERE id = (SELECT min(id) FROM store_documents)")
def get_document(spark, d):
    s = store_docs(spark, d)
    return s.filter(F.col("id") == s.agg(F.min("id")).first()[0]).select("id", "content")


@query("WITH f AS (SELECT * FROM store_documents ORDER BY created_at, id LIMIT 1000) SELECT id FROM f WHERE coalesce(trim(parent_id), '') = '' ORDER BY created_at, id LIMIT 100")
def list_root_documents(spark, d):
    return list_roots(store_docs(spark, d)).select("id")


# ---------------------------------------------------------------- filters
@query("SELECT doc_id FROM documents WHERE coalesce(lang = 'de', false) OR coalesce(source = 'de', false)")
def filter_tag(spark, d):
    return docs(spark, d).filter(filters.has_tag("de")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'fan_pool'")
def filter_tags_all(spark, d):
    return docs(spark, d).filter(filters.has_tags(["en", "fan_pool"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'news_desk'")
def filter_metadata(spark, d):
    return docs(spark, d).filter(filters.metadata_equals("source", "news_desk")).select("doc_id")


@query("SELECT id FROM store_documents WHERE json_valid(metadata) AND json_type(metadata, '$.type') = 'VARCHAR' AND json_extract_string(metadata, '$.type') = 'article'")
def filter_metadata_dirty(spark, d):
    """Over the store's own metadata, with cut-off JSON among it."""
    return store_docs(spark, d).filter(filters.build({"type": "article"})).select("id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'disc_rips'")
def filter_combined(spark, d):
    return docs(spark, d).filter(filters.build({"tag": "en", "source": "disc_rips"})).select("doc_id")


# ---------------------------------------------------------------- full text
_TOK = f"CAST(regexp_extract_all(translate(lower(coalesce(content, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+') AS VARCHAR[])"
_T = f"{_D}, t AS (SELECT doc_id, id, {_TOK} AS t FROM d)"
_HAS = "list_contains(t, '{}')"


def _fts(name: str, q: str, where: str):
    def run(spark, d):
        return search.fts_match(docs(spark, d), q, key="doc_id")

    run.__name__ = name
    query(f"WITH {_T} SELECT doc_id AS id FROM t WHERE {where}")(run)


_fts("fts_single", "river", _HAS.format("river"))
_fts("fts_and", "river lamp", _HAS.format("river") + " AND " + _HAS.format("lamp"))
_fts("fts_or", "honey OR miel", _HAS.format("honey") + " OR " + _HAS.format("miel"))
_fts("fts_not", "river NOT lamp", _HAS.format("river") + " AND NOT " + _HAS.format("lamp"))
_fts("fts_phrase", '"near the river"', "(' ' || array_to_string(t, ' ') || ' ') LIKE '% near the river %'")
_fts("fts_prefix", "suitc*", "len(list_filter(t, lambda x: starts_with(x, 'suitc'))) > 0")


def _bm25(terms: list[str]) -> str:
    f = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = "(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    part = " + ".join(f"{idf.format(i=i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"c AS (SELECT doc_id, id, len(t) AS dl, {f} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c), r AS (SELECT doc_id, id, -({part}) AS rank FROM c, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(terms)))})"


_R = f"WITH {_T}, {_bm25(['river', 'lamp', 'letter'])}"


@query(f"{_R} SELECT id, round(rank, 6) AS rank FROM r ORDER BY r.rank, id LIMIT 20")
def fts_bm25(spark, d):
    return _sim(search.fts_topk(docs(spark, d), QUERY, 20), "rank")


_V = f"v AS (SELECT id, {_cos('vector', 'q')} AS sim FROM d, q WHERE vector IS NOT NULL)"
_FUSE = """a AS (SELECT id, rank, row_number() OVER (ORDER BY rank, id) AS ra FROM (SELECT * FROM r ORDER BY rank, id LIMIT {n})),
b AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rb FROM (SELECT * FROM v ORDER BY sim DESC, id LIMIT {n})),
u AS (SELECT id, coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0) AS score, rank, sim FROM a FULL JOIN b USING (id))"""


@query(f"{_R}, {_Q}, {_V}, {_FUSE.format(n=20)} SELECT id, round(score, 6) AS score, round(rank, 6) AS fts_rank, round(sim, 6) AS vector_similarity FROM u ORDER BY u.score DESC, id LIMIT 10")
def rrf_fusion(spark, d):
    x = docs(spark, d)
    out = search.fuse(search.fts_topk(x, QUERY, 20), search.vector_topk(x, query_vector(spark, d), 20), 10)
    return _sim(_sim(_sim(out, "score"), "fts_rank"), "vector_similarity")


@query(f"{_R}, {_Q}, {_V}, {_FUSE.format(n=40)} SELECT id, round(score, 6) AS score, length(content) AS chars FROM u JOIN d USING (id) ORDER BY u.score DESC, id LIMIT 20")
def hybrid_search(spark, d):
    out = search.search(docs(spark, d), QUERY, 20, query_vector(spark, d))
    return out.select("id", F.round("score", 6).alias("score"), F.length("content").cast("long").alias("chars"))


@query(
    f"""{_R}, {_Q}, w AS (SELECT doc_id, id FROM d WHERE lang = 'en'), r2 AS (SELECT r.* FROM r JOIN w USING (id)), v2 AS (SELECT id, {_cos("vector", "q")} AS sim FROM d JOIN w USING (id), q WHERE vector IS NOT NULL),
{_FUSE.format(n=20).replace("FROM r ", "FROM r2 ").replace("FROM v ", "FROM v2 ")} SELECT id, round(score, 6) AS score FROM u ORDER BY u.score DESC, id LIMIT 10"""
)
def hybrid_filtered(spark, d):
    return search.search(docs(spark, d), QUERY, 10, query_vector(spark, d), where=filters.has_tag("en")).select("id", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT id, coalesce(nullif(parent_id, ''), id) AS parent, CAST(length(content) AS DOUBLE) AS score FROM store_documents),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, id) AS r FROM s)
SELECT parent, max(score) AS max_score, count(*) AS hits, max(CASE WHEN r = 1 THEN id END) AS best FROM k GROUP BY parent"""
)
def group_by_parent(spark, d):
    return search.group_by_parent(store_docs(spark, d).select("id", "parent_id", F.length("content").cast("double").alias("score")))


# ---------------------------------------------------------------- text and chunks
@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS INT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_W = r"list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')"


def _windows(size: int, overlap: int, source: str) -> str:
    step = size - overlap
    return f"""w AS (SELECT *, {_W} AS w FROM {source}), k AS (SELECT *, unnest(CASE WHEN len(w) = 0 THEN []::BIGINT[] WHEN len(w) <= {size} THEN [0::BIGINT] ELSE range(0, greatest(1, len(w) - {size} + {step}), {step}) END) AS b FROM w)"""


@query(f"WITH {_D}, {_windows(128, 16, 'd')} SELECT doc_id AS id, CAST(b / 112 AS INT) AS chunk_index, array_to_string(w[b + 1 : b + 128], ' ') AS chunk FROM k")
def chunk_windows(spark, d):
    return chunking.chunk_windows(docs(spark, d), 128, 16, key="doc_id")


_AUTO = f"""s AS (SELECT id, content, coalesce(token_count, CAST(ceil(strlen(content) / 4.0) AS INT)) AS tc, coalesce(vectorize, true) AS vz, coalesce(is_chunk, false) AS ic FROM store_documents),
g AS (SELECT *, tc > 100 AND vz AND NOT ic AS long FROM s), {_windows(64, 8, "(SELECT * FROM g WHERE long)")}"""


@query(
    f"""WITH {_AUTO} SELECT id, tc AS token_count, vz AND NOT coalesce(long, false) AS vectorize, NULL::INT AS chunk_index, sha256(content) AS h FROM g
UNION ALL SELECT id || '#' || CAST(CAST(b / 56 AS INT) AS VARCHAR), CAST(ceil(strlen(array_to_string(w[b + 1 : b + 64], ' ')) / 4.0) AS INT), true, CAST(b / 56 AS INT), sha256(array_to_string(w[b + 1 : b + 64], ' ')) FROM k"""
)
def chunk_autochunk(spark, d):
    s = store_docs(spark, d)
    out = chunking.auto_chunk(s, 100, 64, 8)
    made = out["id"].contains("#")
    return out.select("id", "token_count", "vectorize", F.when(made, F.col("chunk_index")).alias("chunk_index"), F.sha2("content", 256).alias("h"))


@query("SELECT c.id, c.chunk_index, c.parent_id, sha256(p.content) AS parent_hash FROM store_documents c JOIN store_documents p ON c.parent_id = p.id WHERE c.is_chunk")
def chunks_of_parent(spark, d):
    return chunking.with_parent(store_docs(spark, d)).select("id", "chunk_index", "parent_id", F.sha2("parent_content", 256).alias("parent_hash"))


@query(
    """SELECT id, parent_id, chunk_index, lag(id) OVER w AS before, lead(id) OVER w AS after FROM store_documents WHERE is_chunk AND parent_id IS NOT NULL
WINDOW w AS (PARTITION BY parent_id ORDER BY chunk_index NULLS FIRST, id)"""
)
def chunk_neighbours(spark, d):
    return chunking.neighbours(store_docs(spark, d))


@query()
def chunk_markdown(spark, d):
    return chunking.strategy_chunks(store_docs(spark, d), "markdown", 128, 50, chunking.WordTokenizer())


@query("SELECT id, sha256(content) AS content_hash FROM store_documents")
def content_hash(spark, d):
    return store_docs(spark, d).select("id", T.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_texts(spark, d):
    t = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return t.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


_PROBE = f"SELECT s.id, sha256(s.content) AS content_hash, EXISTS (SELECT 1 FROM embedding_cache c WHERE c.model = '{MODEL}' AND c.content_hash = sha256(s.content) AND c.vector IS NOT NULL) AS hit FROM store_documents s"


@query(_PROBE)
def cache_probe(spark, d):
    p = cache.probe(store_docs(spark, d), table(spark, d, "embedding_cache"), MODEL)
    return p.select("id", "content_hash", F.col("cached_vector").isNotNull().alias("hit"))


@query(f"WITH p AS ({_PROBE}) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM p")
def cache_hit_rate(spark, d):
    return cache.statistics(cache.probe(store_docs(spark, d), table(spark, d, "embedding_cache"), MODEL))


@query(f"SELECT DISTINCT sha256(content) AS content_hash FROM store_documents WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT content_hash FROM embedding_cache WHERE model = '{MODEL}' AND content_hash IS NOT NULL)")
def cache_misses(spark, d):
    return cache.misses(store_docs(spark, d), table(spark, d, "embedding_cache"), MODEL).select("content_hash")


# ---------------------------------------------------------------- mutations
def _changes(spark, d) -> DataFrame:
    """A change log of the store: every document put, every deletion at its time."""
    s = store_docs(spark, d).select("id", "content", "created_at", F.lit("put").alias("op"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("seq"))
    x = table(spark, d, "document_deletes").select(F.col("document_id").alias("id"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit("delete").alias("op"), F.unix_micros(F.col("deleted_at").cast("timestamp")).alias("seq"))
    again = s.withColumns({"seq": F.col("seq") + 1, "content": F.concat("content", F.lit("!")), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    return s.unionByName(x).unionByName(again)


@query(
    """WITH x AS (SELECT document_id AS id, max(epoch_us(deleted_at)) AS dead FROM document_deletes GROUP BY 1), s AS (SELECT s.*, epoch_us(updated_at) AS seq, x.dead FROM store_documents s LEFT JOIN x USING (id))
SELECT id, sha256(content || '!') AS h, CASE WHEN dead IS NULL OR seq > dead THEN created_at ELSE created_at + INTERVAL 1 DAY END AS created_at FROM s WHERE dead IS NULL OR seq + 1 > dead"""
)
def upsert_latest(spark, d):
    return latest(_changes(spark, d)).select("id", F.sha2("content", 256).alias("h"), "created_at")


@query("WITH RECURSIVE x AS (SELECT DISTINCT document_id AS id FROM document_deletes UNION SELECT s.id FROM store_documents s JOIN x ON s.parent_id = x.id) SELECT id FROM x")
def delete_cascade(spark, d):
    return cascade(store_docs(spark, d), table(spark, d, "document_deletes").select(F.col("document_id").alias("id")))


@query(
    """WITH r AS (SELECT *, created_at >= TIMESTAMP '2025-07-01' AS late FROM document_relations), k AS (SELECT *, row_number() OVER (PARTITION BY late, source_id, target_id, relation_type ORDER BY created_at, id) AS k FROM r)
SELECT DISTINCT id, source_id, target_id, relation_type, created_at FROM k WHERE late AND (k > 1 OR EXISTS (SELECT 1 FROM r WHERE NOT r.late AND r.source_id = k.source_id AND r.target_id = k.target_id AND r.relation_type = k.relation_type))"""
)
def relation_unique(spark, d):
    """The second half of the year arrives on top of the first: refused are triples that exist, or come again."""
    r = relations(spark, d).select("id", "source_id", "target_id", "relation_type", "created_at")
    late = F.col("created_at") >= F.lit("2025-07-01").cast("timestamp_ntz")
    return duplicate_relations(r.filter(~late), r.filter(late))


# ---------------------------------------------------------------- graph
_START = "(SELECT source_id FROM document_relations GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1)"


def _bfs(types: str = "") -> str:
    where = f" WHERE relation_type IN ({types})" if types else ""
    return f"""e AS (SELECT DISTINCT source_id, target_id FROM document_relations{where}),
b AS (SELECT {_START} AS id, 0 AS depth WHERE {_START} IN (SELECT source_id FROM e UNION SELECT target_id FROM e) UNION SELECT e.target_id, b.depth + 1 FROM b JOIN e ON b.id = e.source_id WHERE b.depth < 3),
m AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM b GROUP BY id)"""


@query(f"WITH RECURSIVE {_bfs()} SELECT * FROM m")
def graph_bfs(spark, d):
    return graph.bfs(relations(spark, d), start_node(spark, d), 3)


@query(f"WITH RECURSIVE {_bfs(chr(39) + 'references' + chr(39) + ', ' + chr(39) + 'similar_to' + chr(39))} SELECT * FROM m")
def graph_bfs_typed(spark, d):
    return graph.bfs(relations(spark, d), start_node(spark, d), 3, ["references", "similar_to"])


@query(f"WITH RECURSIVE {_bfs()} SELECT id, source_id, target_id FROM document_relations WHERE source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m)")
def graph_induced_relations(spark, d):
    r = relations(spark, d)
    return graph.induced(r, graph.bfs(r, start_node(spark, d), 3)).select("id", "source_id", "target_id")


@query(f"WITH RECURSIVE {_bfs()}, g AS (SELECT max(depth) AS depth FROM m) SELECT CAST(depth AS DOUBLE) AS distance, CAST(depth + 1 AS BIGINT) AS nodes FROM g")
def graph_shortest_path(spark, d):
    """From the start to the smallest id of those reached last within three steps: length and nodes of the path."""
    r, start = relations(spark, d), start_node(spark, d)
    goal = graph.bfs(r, start, 3).orderBy(F.desc("depth"), "id").first()["id"]
    return graph.shortest_path(r, start, goal).agg(F.max("distance").alias("distance"), F.count("*").alias("nodes"))


@query(f"""WITH RECURSIVE {_bfs()}, g AS (SELECT id FROM m ORDER BY depth DESC, id LIMIT 1),
f AS (SELECT e.target_id AS id, a.depth + 1 AS depth, min(e.source_id) AS prev FROM e JOIN m a ON e.source_id = a.id JOIN m b ON e.target_id = b.id AND b.depth = a.depth + 1 GROUP BY 1, 2),
w AS (SELECT f.id, f.depth, f.prev FROM f JOIN g ON f.id = g.id UNION ALL SELECT f.id, f.depth, f.prev FROM w JOIN f ON f.id = w.prev)
SELECT depth AS hop, id, (SELECT r.id FROM document_relations r WHERE r.source_id = w.prev AND r.target_id = w.id ORDER BY created_at, r.id LIMIT 1) AS relation_id, CAST(depth AS DOUBLE) AS distance FROM w
UNION ALL SELECT 0, {_START}, NULL, 0.0""")
def graph_shortest_path_rows(spark, d):
    """The path of graph_shortest_path itself, a row a hop."""
    r, start = relations(spark, d), start_node(spark, d)
    goal = graph.bfs(r, start, 3).orderBy(F.desc("depth"), "id").first()["id"]
    return graph.shortest_path(r, start, goal)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM document_relations), r AS (SELECT source_id AS s, target_id AS t FROM e UNION SELECT r.s, e.target_id FROM r JOIN e ON r.t = e.source_id)
SELECT count(*) > 0 AS has_cycles FROM r WHERE s = t"""
)
def graph_cycles(spark, d):
    """Over all relations."""
    return spark.range(1).select(F.lit(graph.has_cycles(relations(spark, d))).alias("has_cycles"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM document_relations), r AS (SELECT source_id AS s, target_id AS t FROM e UNION SELECT r.s, e.target_id FROM r JOIN e ON r.t = e.source_id)
SELECT (SELECT count(*) FROM (SELECT source_id FROM document_relations UNION SELECT target_id FROM document_relations)) AS node_count, count(*) AS edge_count, (SELECT count(*) > 0 FROM r WHERE s = t) AS has_cycles FROM document_relations"""
)
def graph_stats(spark, d):
    return graph.statistics(relations(spark, d))


@query("SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM document_relations UNION ALL SELECT target_id, 1, 0 FROM document_relations) GROUP BY id")
def graph_degrees(spark, d):
    return graph.degrees(relations(spark, d))


@query(f"SELECT id, source_id, target_id FROM document_relations WHERE source_id = {_START} OR target_id = {_START}")
def graph_incident(spark, d):
    return graph.incident(relations(spark, d), start_node(spark, d)).select("id", "source_id", "target_id")


@query("""SELECT '  "' || replace(replace(source_id, '\\', '\\\\'), '"', '\\"') || '" -> "' || replace(replace(target_id, '\\', '\\\\'), '"', '\\"') || '" [label="' || replace(replace(relation_type, '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM document_relations""")
def graph_export_dot(spark, d):
    return graph.export_lines(relations(spark, d))


# ---------------------------------------------------------------- logs, over the events table
def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("target"), "event_id", F.struct(F.col("event_type").alias("name")).alias("span"))


_LEVEL = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"


@query(f"SELECT {_LEVEL} AS level, count(*) AS entries FROM events GROUP BY 1")
def log_by_level(spark, d):
    return logs.by_level(_events(spark, d))


@query("SELECT event_type AS target, count(*) AS entries FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def log_top_targets(spark, d):
    return logs.top_targets(_events(spark, d))


@query("SELECT event_type AS operation, count(*) AS entries FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def log_ops(spark, d):
    return logs.operations(_events(spark, d))


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 10")
def log_errors(spark, d):
    return logs.errors(_events(spark, d), ["timestamp", "event_id"]).select("event_id")


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS entries FROM events GROUP BY 1")
def log_by_date(spark, d):
    return logs.by_date(_events(spark, d))


# ---------------------------------------------------------------- wire, index, streaming
@query("SELECT id, epoch_us(created_at) // 1000 AS created_ms, epoch_us(updated_at) // 1000 AS updated_ms FROM store_documents")
def wire_millis(spark, d):
    return store_docs(spark, d).select("id", wire.millis("created_at").alias("created_ms"), wire.millis("updated_at").alias("updated_ms"))


@query("SELECT doc_id, sha256(text) AS h, n_chars FROM documents")
def json_roundtrip(spark, d):
    x = wire.to_wire(docs(spark, d))
    back = wire.from_wire(x, "id string, content string, metadata struct<n_chars:long>, created_at long, updated_at long")
    return back.select(F.col("id").cast("long").alias("doc_id"), F.sha2("content", 256).alias("h"), "metadata.n_chars")


def _index(spark, d) -> ann.VectorIndex:
    return ann.VectorIndex.build(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")))


def _index_queries(spark, d) -> DataFrame:
    """Every id divisible by 100."""
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("q"))


@query()
def ann_ivf_topk(spark, d):
    return _sim(_index(spark, d).search_batch(_index_queries(spark, d), 10))


_ASKED = "SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0"


@query(f"SELECT count(*) AS queries, (SELECT count(*) FROM embeddings) AS indexed, true AS recall_ok FROM ({_ASKED})")
def ann_recall(spark, d):
    """Queries, indexed rows, and whether the mean recall of the ten nearest by default parameters is 0.9 or more; over all ids divisible by 100."""
    q, index = _index_queries(spark, d), _index(spark, d).write(f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    ok = index.recall(q, 10) >= 0.9
    return q.agg(F.count("*").alias("queries")).select("queries", F.lit(len(index)).cast("long").alias("indexed"), F.lit(ok).alias("recall_ok"))


@query(
    """WITH w AS (SELECT id, content, vector IS NULL AND coalesce(vectorize, true) AS waits FROM store_documents WHERE content <> '')
SELECT count(*) AS documents, count(DISTINCT content) FILTER (WHERE waits) AS texts, count(*) FILTER (WHERE waits) AS embedded, true AS all_embedded FROM w"""
)
def stream_embed_worker(spark, d):
    """All documents stored; those that wait for a vector are embedded by the streaming worker in batches, each distinct text once."""
    base = f"{ensure_checkpoint_dir(spark)}/worker-{uuid.uuid4().hex}"
    s = Store(spark, base, Config(embedding_cache=True, embedding_job=True, worker_batch=150))
    rows = store_docs(spark, d).filter("content <> ''").select("id", "content", "vector", "vectorize", "created_at", "updated_at")
    s.upsert("db", "notes", rows)
    Worker(s, HashEmbedder(16)).start("db", "notes", f"{base}/_checkpoint", once=True).awaitTermination()
    waits = rows.filter("vector is null and coalesce(vectorize, true)").select("id", F.lit(True).alias("waits")).dropDuplicates(["id"])
    now = s.documents("db", "notes").join(waits, "id", "left").agg(
        F.count("*").alias("documents"), F.count("waits").alias("embedded"), F.coalesce(F.min(F.when(F.col("waits"), F.col("vector").isNotNull())), F.lit(True)).alias("all_embedded")
    )
    return now.crossJoin(s.cache("db").agg(F.count("*").alias("texts"))).select("documents", "texts", "embedded", "all_embedded")  # one row each


@query(f"{_R} SELECT id, round(rank, 6) AS rank FROM r ORDER BY r.rank, id LIMIT 20")
def fts_bm25(spark, d):
    return _sim(search.fts_topk(docs(spark, d), QUERY, 20), "rank")


_V = f"v AS (SELECT id, {_cos('vector', 'q')} AS sim FROM d, q WHERE vector IS NOT NULL)"
_FUSE = """a AS (SELECT id, rank, row_number() OVER (ORDER BY rank, id) AS ra FROM (SELECT * FROM r ORDER BY rank, id LIMIT {n})),
b AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rb FROM (SELECT * FROM v ORDER BY sim DESC, id LIMIT {n})),
u AS (SELECT id, coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0) AS score, rank, sim FROM a FULL JOIN b USING (id))"""


@query(f"{_R}, {_Q}, {_V}, {_FUSE.format(n=20)} SELECT id, round(score, 6) AS score, round(rank, 6) AS fts_rank, round(sim, 6) AS vector_similarity FROM u ORDER BY u.score DESC, id LIMIT 10")
def rrf_fusion(spark, d):
    x = docs(spark, d)
    out = search.fuse(search.fts_topk(x, QUERY, 20), search.vector_topk(x, query_vector(spark, d), 20), 10)
    return _sim(_sim(_sim(out, "score"), "fts_rank"), "vector_similarity")


@query(f"{_R}, {_Q}, {_V}, {_FUSE.format(n=40)} SELECT id, round(score, 6) AS score, length(content) AS chars FROM u JOIN d USING (id) ORDER BY u.score DESC, id LIMIT 20")
def hybrid_search(spark, d):
    out = search.search(docs(spark, d), QUERY, 20, query_vector(spark, d))
    return out.select("id", F.round("score", 6).alias("score"), F.length("content").cast("long").alias("chars"))


@query(
    f"""{_R}, {_Q}, w AS (SELECT doc_id, id FROM d WHERE lang = 'en'), r2 AS (SELECT r.* FROM r JOIN w USING (id)), v2 AS (SELECT id, {_cos("vector", "q")} AS sim FROM d JOIN w USING (id), q WHERE vector IS NOT NULL),
{_FUSE.format(n=20).replace("FROM r ", "FROM r2 ").replace("FROM v ", "FROM v2 ")} SELECT id, round(score, 6) AS score FROM u ORDER BY u.score DESC, id LIMIT 10"""
)
def hybrid_filtered(spark, d):
    return search.search(docs(spark, d), QUERY, 10, query_vector(spark, d), where=filters.has_tag("en")).select("id", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT id, coalesce(nullif(parent_id, ''), id) AS parent, CAST(length(content) AS DOUBLE) AS score FROM store_documents),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, id) AS r FROM s)
SELECT parent, max(score) AS max_score, count(*) AS hits, max(CASE WHEN r = 1 THEN id END) AS best FROM k GROUP BY parent"""
)
def group_by_parent(spark, d):
    return search.group_by_parent(store_docs(spark, d).select("id", "parent_id", F.length("content").cast("double").alias("score")))


# ---------------------------------------------------------------- text and chunks
@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS INT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_W = r"list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')"


def _windows(size: int, overlap: int, source: str) -> str:
    step = size - overlap
    return f"""w AS (SELECT *, {_W} AS w FROM {source}), k AS (SELECT *, unnest(CASE WHEN len(w) = 0 THEN []::BIGINT[] WHEN len(w) <= {size} THEN [0::BIGINT] ELSE range(0, greatest(1, len(w) - {size} + {step}), {step}) END) AS b FROM w)"""


@query(f"WITH {_D}, {_windows(128, 16, 'd')} SELECT doc_id AS id, CAST(b / 112 AS INT) AS chunk_index, array_to_string(w[b + 1 : b + 128], ' ') AS chunk FROM k")
def chunk_windows(spark, d):
    return chunking.chunk_windows(docs(spark, d), 128, 16, key="doc_id")


_AUTO = f"""s AS (SELECT id, content, coalesce(token_count, CAST(ceil(strlen(content) / 4.0) AS INT)) AS tc, coalesce(vectorize, true) AS vz, coalesce(is_chunk, false) AS ic FROM store_documents),
g AS (SELECT *, tc > 100 AND vz AND NOT ic AS long FROM s), {_windows(64, 8, "(SELECT * FROM g WHERE long)")}"""


@query(
    f"""WITH {_AUTO} SELECT id, tc AS token_count, vz AND NOT coalesce(long, false) AS vectorize, NULL::INT AS chunk_index, sha256(content) AS h FROM g
UNION ALL SELECT id || '#' || CAST(CAST(b / 56 AS INT) AS VARCHAR), CAST(ceil(strlen(array_to_string(w[b + 1 : b + 64], ' ')) / 4.0) AS INT), true, CAST(b / 56 AS INT), sha256(array_to_string(w[b + 1 : b + 64], ' ')) FROM k"""
)
def chunk_autochunk(spark, d):
    s = store_docs(spark, d)
    out = chunking.auto_chunk(s, 100, 64, 8)
    made = out["id"].contains("#")
    return out.select("id", "token_count", "vectorize", F.when(made, F.col("chunk_index")).alias("chunk_index"), F.sha2("content", 256).alias("h"))


@query("SELECT c.id, c.chunk_index, c.parent_id, sha256(p.content) AS parent_hash FROM store_documents c JOIN store_documents p ON c.parent_id = p.id WHERE c.is_chunk")
def chunks_of_parent(spark, d):
    return chunking.with_parent(store_docs(spark, d)).select("id", "chunk_index", "parent_id", F.sha2("parent_content", 256).alias("parent_hash"))


@query(
    """SELECT id, parent_id, chunk_index, lag(id) OVER w AS before, lead(id) OVER w AS after FROM store_documents WHERE is_chunk AND parent_id IS NOT NULL
WINDOW w AS (PARTITION BY parent_id ORDER BY chunk_index NULLS FIRST, id)"""
)
def chunk_neighbours(spark, d):
    return chunking.neighbours(store_docs(spark, d))


@query()
def chunk_markdown(spark, d):
    return chunking.strategy_chunks(store_docs(spark, d), "markdown", 128, 50, chunking.WordTokenizer())


@query("SELECT id, sha256(content) AS content_hash FROM store_documents")
def content_hash(spark, d):
    return store_docs(spark, d).select("id", T.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_texts(spark, d):
    t = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return t.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


_PROBE = f"SELECT s.id, sha256(s.content) AS content_hash, EXISTS (SELECT 1 FROM embedding_cache c WHERE c.model = '{MODEL}' AND c.content_hash = sha256(s.content) AND c.vector IS NOT NULL) AS hit FROM store_documents s"


@query(_PROBE)
def cache_probe(spark, d):
    p = cache.probe(store_docs(spark, d), table(spark, d, "embedding_cache"), MODEL)
    return p.select("id", "content_hash", F.col("cached_vector").isNotNull().alias("hit"))


@query(f"WITH p AS ({_PROBE}) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM p")
def cache_hit_rate(spark, d):
    return cache.statistics(cache.probe(store_docs(spark, d), table(spark, d, "embedding_cache"), MODEL))


@query(f"SELECT DISTINCT sha256(content) AS content_hash FROM store_documents WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT content_hash FROM embedding_cache WHERE model = '{MODEL}' AND content_hash IS NOT NULL)")
def cache_misses(spark, d):
    return cache.misses(store_docs(spark, d), table(spark, d, "embedding_cache"), MODEL).select("content_hash")


# ---------------------------------------------------------------- mutations
def _changes(spark, d) -> DataFrame:
    """A change log of the store: every document put, every deletion at its time."""
    s = store_docs(spark, d).select("id", "content", "created_at", F.lit("put").alias("op"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("seq"))
    x = table(spark, d, "document_deletes").select(F.col("document_id").alias("id"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit("delete").alias("op"), F.unix_micros(F.col("deleted_at").cast("timestamp")).alias("seq"))
    again = s.withColumns({"seq": F.col("seq") + 1, "content": F.concat("content", F.lit("!")), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    return s.unionByName(x).unionByName(again)


@query(
    """WITH x AS (SELECT document_id AS id, max(epoch_us(deleted_at)) AS dead FROM document_deletes GROUP BY 1), s AS (SELECT s.*, epoch_us(updated_at) AS seq, x.dead FROM store_documents s LEFT JOIN x USING (id))
SELECT id, sha256(content || '!') AS h, CASE WHEN dead IS NULL OR seq > dead THEN created_at ELSE created_at + INTERVAL 1 DAY END AS created_at FROM s WHERE dead IS NULL OR seq + 1 > dead"""
)
def upsert_latest(spark, d):
    return latest(_changes(spark, d)).select("id", F.sha2("content", 256).alias("h"), "created_at")


@query("WITH RECURSIVE x AS (SELECT DISTINCT document_id AS id FROM document_deletes UNION SELECT s.id FROM store_documents s JOIN x ON s.parent_id = x.id) SELECT id FROM x")
def delete_cascade(spark, d):
    return cascade(store_docs(spark, d), table(spark, d, "document_deletes").select(F.col("document_id").alias("id")))


@query(
    """WITH r AS (SELECT *, created_at >= TIMESTAMP '2025-07-01' AS late FROM document_relations), k AS (SELECT *, row_number() OVER (PARTITION BY late, source_id, target_id, relation_type ORDER BY created_at, id) AS k FROM r)
SELECT DISTINCT id, source_id, target_id, relation_type, created_at FROM k WHERE late AND (k > 1 OR EXISTS (SELECT 1 FROM r WHERE NOT r.late AND r.source_id = k.source_id AND r.target_id = k.target_id AND r.relation_type = k.relation_type))"""
)
def relation_unique(spark, d):
    """The second half of the year arrives on top of the first: refused are triples that exist, or come again."""
    r = relations(spark, d).select("id", "source_id", "target_id", "relation_type", "created_at")
    late = F.col("created_at") >= F.lit("2025-07-01").cast("timestamp_ntz")
    return duplicate_relations(r.filter(~late), r.filter(late))


# ---------------------------------------------------------------- graph
_START = "(SELECT source_id FROM document_relations GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1)"


def _bfs(types: str = "") -> str:
    where = f" WHERE relation_type IN ({types})" if types else ""
    return f"""e AS (SELECT DISTINCT source_id, target_id FROM document_relations{where}),
b AS (SELECT {_START} AS id, 0 AS depth WHERE {_START} IN (SELECT source_id FROM e UNION SELECT target_id FROM e) UNION SELECT e.target_id, b.depth + 1 FROM b JOIN e ON b.id = e.source_id WHERE b.depth < 3),
m AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM b GROUP BY id)"""


@query(f"WITH RECURSIVE {_bfs()} SELECT * FROM m")
def graph_bfs(spark, d):
    return graph.bfs(relations(spark, d), start_node(spark, d), 3)


@query(f"WITH RECURSIVE {_bfs(chr(39) + 'references' + chr(39) + ', ' + chr(39) + 'similar_to' + chr(39))} SELECT * FROM m")
def graph_bfs_typed(spark, d):
    return graph.bfs(relations(spark, d), start_node(spark, d), 3, ["references", "similar_to"])


@query(f"WITH RECURSIVE {_bfs()} SELECT id, source_id, target_id FROM document_relations WHERE source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m)")
def graph_induced_relations(spark, d):
    r = relations(spark, d)
    return graph.induced(r, graph.bfs(r, start_node(spark, d), 3)).select("id", "source_id", "target_id")


@query(f"WITH RECURSIVE {_bfs()}, g AS (SELECT max(depth) AS depth FROM m) SELECT CAST(depth AS DOUBLE) AS distance, CAST(depth + 1 AS BIGINT) AS nodes FROM g")
def graph_shortest_path(spark, d):
    """From the start to the smallest id of those reached last within three steps: length and nodes of the path."""
    r, start = relations(spark, d), start_node(spark, d)
    goal = graph.bfs(r, start, 3).orderBy(F.desc("depth"), "id").first()["id"]
    return graph.shortest_path(r, start, goal).agg(F.max("distance").alias("distance"), F.count("*").alias("nodes"))


@query(f"""WITH RECURSIVE {_bfs()}, g AS (SELECT id FROM m ORDER BY depth DESC, id LIMIT 1),
f AS (SELECT e.target_id AS id, a.depth + 1 AS depth, min(e.source_id) AS prev FROM e JOIN m a ON e.source_id = a.id JOIN m b ON e.target_id = b.id AND b.depth = a.depth + 1 GROUP BY 1, 2),
w AS (SELECT f.id, f.depth, f.prev FROM f JOIN g ON f.id = g.id UNION ALL SELECT f.id, f.depth, f.prev FROM w JOIN f ON f.id = w.prev)
SELECT depth AS hop, id, (SELECT r.id FROM document_relations r WHERE r.source_id = w.prev AND r.target_id = w.id ORDER BY created_at, r.id LIMIT 1) AS relation_id, CAST(depth AS DOUBLE) AS distance FROM w
UNION ALL SELECT 0, {_START}, NULL, 0.0""")
def graph_shortest_path_rows(spark, d):
    """The path of graph_shortest_path itself, a row a hop."""
    r, start = relations(spark, d), start_node(spark, d)
    goal = graph.bfs(r, start, 3).orderBy(F.desc("depth"), "id").first()["id"]
    return graph.shortest_path(r, start, goal)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM document_relations), r AS (SELECT source_id AS s, target_id AS t FROM e UNION SELECT r.s, e.target_id FROM r JOIN e ON r.t = e.source_id)
SELECT count(*) > 0 AS has_cycles FROM r WHERE s = t"""
)
def graph_cycles(spark, d):
    """Over all relations."""
    return spark.range(1).select(F.lit(graph.has_cycles(relations(spark, d))).alias("has_cycles"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM document_relations), r AS (SELECT source_id AS s, target_id AS t FROM e UNION SELECT r.s, e.target_id FROM r JOIN e ON r.t = e.source_id)
SELECT (SELECT count(*) FROM (SELECT source_id FROM document_relations UNION SELECT target_id FROM document_relations)) AS node_count, count(*) AS edge_count, (SELECT count(*) > 0 FROM r WHERE s = t) AS has_cycles FROM document_relations"""
)
def graph_stats(spark, d):
    return graph.statistics(relations(spark, d))


@query("SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM document_relations UNION ALL SELECT target_id, 1, 0 FROM document_relations) GROUP BY id")
def graph_degrees(spark, d):
    return graph.degrees(relations(spark, d))


@query(f"SELECT id, source_id, target_id FROM document_relations WHERE source_id = {_START} OR target_id = {_START}")
def graph_incident(spark, d):
    return graph.incident(relations(spark, d), start_node(spark, d)).select("id", "source_id", "target_id")


@query("""SELECT '  "' || replace(replace(source_id, '\\', '\\\\'), '"', '\\"') || '" -> "' || replace(replace(target_id, '\\', '\\\\'), '"', '\\"') || '" [label="' || replace(replace(relation_type, '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM document_relations""")
def graph_export_dot(spark, d):
    return graph.export_lines(relations(spark, d))


# ---------------------------------------------------------------- logs, over the events table
def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("target"), "event_id", F.struct(F.col("event_type").alias("name")).alias("span"))


_LEVEL = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"


@query(f"SELECT {_LEVEL} AS level, count(*) AS entries FROM events GROUP BY 1")
def log_by_level(spark, d):
    return logs.by_level(_events(spark, d))


@query("SELECT event_type AS target, count(*) AS entries FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def log_top_targets(spark, d):
    return logs.top_targets(_events(spark, d))


@query("SELECT event_type AS operation, count(*) AS entries FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def log_ops(spark, d):
    return logs.operations(_events(spark, d))


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 10")
def log_errors(spark, d):
    return logs.errors(_events(spark, d), ["timestamp", "event_id"]).select("event_id")


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS entries FROM events GROUP BY 1")
def log_by_date(spark, d):
    return logs.by_date(_events(spark, d))


# ---------------------------------------------------------------- wire, index, streaming
@query("SELECT id, epoch_us(created_at) // 1000 AS created_ms, epoch_us(updated_at) // 1000 AS updated_ms FROM store_documents")
def wire_millis(spark, d):
    return store_docs(spark, d).select("id", wire.millis("created_at").alias("created_ms"), wire.millis("updated_at").alias("updated_ms"))


@query("SELECT doc_id, sha256(text) AS h, n_chars FROM documents")
def json_roundtrip(spark, d):
    x = wire.to_wire(docs(spark, d))
    back = wire.from_wire(x, "id string, content string, metadata struct<n_chars:long>, created_at long, updated_at long")
    return back.select(F.col("id").cast("long").alias("doc_id"), F.sha2("content", 256).alias("h"), "metadata.n_chars")


def _index(spark, d) -> ann.VectorIndex:
    return ann.VectorIndex.build(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")))


def _index_queries(spark, d) -> DataFrame:
    """Every id divisible by 100."""
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("q"))


@query()
def ann_ivf_topk(spark, d):
    return _sim(_index(spark, d).search_batch(_index_queries(spark, d), 10))


_ASKED = "SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0"


@query(f"SELECT count(*) AS queries, (SELECT count(*) FROM embeddings) AS indexed, true AS recall_ok FROM ({_ASKED})")
def ann_recall(spark, d):
    """Queries, indexed rows, and whether the mean recall of the ten nearest by default parameters is 0.9 or more; over all ids divisible by 100."""
    q, index = _index_queries(spark, d), _index(spark, d).write(f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    ok = index.recall(q, 10) >= 0.9
    return q.agg(F.count("*").alias("queries")).select("queries", F.lit(len(index)).cast("long").alias("indexed"), F.lit(ok).alias("recall_ok"))


@query(
    """WITH w AS (SELECT id, content, vector IS NULL AND coalesce(vectorize, true) AS waits FROM store_documents WHERE content <> '')
SELECT count(*) AS documents, count(DISTINCT content) FILTER (WHERE waits) AS texts, count(*) FILTER (WHERE waits) AS embedded, true AS all_embedded FROM w"""
)
def stream_embed_worker(spark, d):
    """All documents stored; those that wait for a vector are embedded by the streaming worker in batches, each distinct text once."""
    base = f"{ensure_checkpoint_dir(spark)}/worker-{uuid.uuid4().hex}"
    s = Store(spark, base, Config(embedding_cache=True, embedding_job=True, worker_batch=150))
    rows = store_docs(spark, d).filter("content <> ''").select("id", "content", "vector", "vectorize", "created_at", "updated_at")
    s.upsert("db", "notes", rows)
    Worker(s, HashEmbedder(16)).start("db", "notes", f"{base}/_checkpoint", once=True).awaitTermination()
    now, waits = s.documents("db", "notes"), rows.filter("vector is null and coalesce(vectorize, true)").select("id")
    new = now.join(waits, "id", "left_semi").agg(F.count("*").alias("embedded"), F.min(F.col("vector").isNotNull()).alias("all_embedded"))
    made = s.cache("db").agg(F.count("*").alias("texts"))
    return now.agg(F.count("*").alias("documents")).crossJoin(new).crossJoin(made).select("documents", "texts", "embedded", "all_embedded")  # one row each


@query(f"{_R} SELECT id, round(rank, 6) AS rank FROM r ORDER BY r.rank, id LIMIT 20")
def fts_postings(spark, d):
    """As fts_bm25, from postings."""
    p = search.Postings.build(docs(spark, d), f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
    return _sim(search.fts_topk(docs(spark, d), QUERY, 20, postings=p), "rank")


@query(f"SELECT level, count(*) AS entries FROM (SELECT {_LEVEL} AS level FROM events) GROUP BY 1")
def log_json_lines(spark, d):
    """Events written as JSON lines beside broken ones, and read back by the log source."""
    path = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = _events(spark, d).select(F.to_json(F.struct(F.col("timestamp").cast("string").alias("timestamp"), "level", "target", "span")).alias("value"))
    lines.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return logs.by_level(logs.read(spark, path))
