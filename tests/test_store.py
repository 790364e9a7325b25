import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import queries_store
from siltstone.functions import text as T
from siltstone.functions import vector as V
from siltstone.operators import ann, chunking, filters, graph, search
from siltstone.plans import fts_query
from siltstone.schema import DOCUMENT, Config, StoreError
from siltstone.sources.embedder import HashEmbedder, HttpEmbedder, embed
from siltstone.sources.store import Store
from siltstone.streaming.worker import Worker, rounds

EDGE = "id string, source_id string, target_id string, relation_type string, created_at timestamp"


def edges(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(f"e{k}", *r, datetime(2025, 1, 1)) for k, r in enumerate(rows)], EDGE)


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "base"), Config(chunking=True, chunk_threshold=5, chunk_size=4, chunk_overlap=1, worker_batch=10, embedding_job=True))
    mk = lambda rows: spark.createDataFrame(rows, "id string, content string")
    s.ingest("db", "notes", mk([("a", "one two three four five six seven eight"), ("b", "short")]))
    rows = {r["id"]: r for r in s.documents("db", "notes").collect()}
    assert rows["a"]["vectorize"] is False and rows["b"]["vectorize"] and {i for i in rows if i.startswith("a#")} == {"a#0", "a#1", "a#2"}
    born = rows["b"]["created_at"]
    s.upsert("db", "notes", mk([("b", "changed")]))
    again = s.get("db", "notes", "b")
    assert again["content"] == "changed" and again["created_at"] == born
    with pytest.raises(StoreError):
        s.upsert("db", "notes", mk([("x", "")]))
    with pytest.raises(StoreError):
        s.delete("db", "notes", ["a#1"])
    Worker(s, HashEmbedder(8)).start("db", "notes", str(tmp_path / "cp"), once=True).awaitTermination()
    done = {r["id"]: r["vector"] for r in s.documents("db", "notes").collect()}
    assert done["a"] is None and all(len(v) == 8 for k, v in done.items() if k != "a")
    s.delete("db", "notes", ["a", "never"])
    assert [r["id"] for r in s.documents("db", "notes").collect()] == ["b"]
    with pytest.raises(KeyError):
        s.get("db", "notes", "a")
    assert s.tables("db") == ["notes"] and s.databases() == ["db"]
    s.snapshot("db", str(tmp_path / "snap"))
    s.compact("db", "notes")
    s.restore("db", str(tmp_path / "snap"))
    assert s.get("db", "notes", "b")["content"] == "changed"
    with pytest.raises(StoreError):
        s.tables("../etc")


def test_relations_are_unique(spark, tmp_path):
    s = Store(spark, str(tmp_path / "base"), Config(document_relations=True))
    one = spark.createDataFrame([("r1", "a", "b", "references")], "id string, source_id string, target_id string, relation_type string")
    s.relate("db", one)
    with pytest.raises(StoreError):
        s.relate("db", one)
    s.delete_relation("db", "r1")
    s.relate("db", one)
    assert s.get_relation("db", "r1")["target_id"] == "b"


def test_graph_cases(spark):
    party = edges(spark, [("T", "Z", "P"), ("T", "G", "P"), ("Z", "G", "P"), ("Z", "T", "M")])
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(party).collect()} == {"T": (1, 2), "Z": (1, 2), "G": (2, 0)}
    assert graph.has_cycles(party) and not graph.has_cycles(party.filter("relation_type = 'P'")) and not graph.has_cycles(party.limit(0))
    chain = edges(spark, [("A", "B", "r"), ("B", "C", "r"), ("A", "D", "s")])
    assert {(r["id"], r["depth"]) for r in graph.bfs(chain, "A", 10, ["r"]).collect()} == {("A", 0), ("B", 1), ("C", 2)}
    assert graph.bfs(chain, "nobody").count() == 0 and graph.bfs(chain, "A", 0).count() == 1
    assert [r["id"] for r in graph.shortest_path(chain, "A", "C").orderBy("hop").collect()] == ["A", "B", "C"]
    assert graph.shortest_path(chain, "C", "A").count() == 0 and graph.shortest_path(chain, "A", "A").count() == 1


@pytest.mark.parametrize(("last", "cyclic"), [("e", False), ("a", True)])
def test_cycles_over_all_types(spark, tmp_path, last, cyclic):
    rows = [("a", "b", "child_of"), ("b", "c", "references"), ("c", last, "similar_to")]
    edges(spark, rows).write.parquet(str(tmp_path / "document_relations.parquet"))
    up = {s: t for s, t, _ in rows}
    walk = lambda n, left: left > 0 and n in up and (up[n] == "a" or walk(up[n], left - 1))
    got = queries_store.QUERIES["graph_stats"](spark, str(tmp_path)).first()
    assert walk("a", 3) == cyclic and got.asDict() == {"node_count": 3 if cyclic else 4, "edge_count": 3, "has_cycles": cyclic}


def test_path_bounds(spark):
    chain = edges(spark, [("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")])
    with pytest.raises(RuntimeError):
        graph.shortest_path(chain, "a", "d", max_steps=2)
    assert [r["id"] for r in graph.shortest_path(chain, "a", "d", max_steps=3).orderBy("hop").collect()] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        graph.shortest_path(chain, "a", "d", weight=F.lit(-1.0))


@pytest.mark.parametrize(
    ("q", "want"),
    [("fox", {1, 2}), ("quick fox", {1}), ("fox NOT quick", {2}), ("quick OR lazy", {1, 3}), ('"brown fox"', {1}), ("la*", {3}), ("fox AND (quick OR lazy)", {1}), ("NEAR(quick fox, 1)", {1}), ("^the", {1, 3}), ("CAFÉ", {3})],
)
def test_query_language(spark, q, want):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, "a fox"), (3, "the lazy dog in a café"), (4, None), (5, "")], "id int, content string")
    assert {r["id"] for r in search.fts_match(df, q).collect()} == want


def test_index_recall_by_default(spark):
    x = np.random.default_rng(4).standard_normal((600, 32)).astype(np.float32)
    df = spark.createDataFrame([(f"{k}", v.tolist()) for k, v in enumerate(x)], "id string, vector array<float>")
    index, q = ann.VectorIndex.build(df), df.filter("int(id) % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    pairs = lambda t: {(r["query_id"], r["id"]) for r in t.collect()}
    want, got = pairs(search.vector_batch(df, q, 10)), pairs(index.search_batch(q, 10))
    assert len(want) == len(got) == 300 and len(got & want) >= 270
    assert {r["id"] for r in index.search(x[0].tolist(), 10).collect()} == {i for k, i in got if k == "0"}


def test_query_errors():
    for q in ("what's new?", "", "a AND", '"open', "(a"):
        with pytest.raises(fts_query.QueryError):
            fts_query.parse(q)
    assert isinstance(fts_query.parse(fts_query.quote("what's new?")), fts_query.Node)


def test_filters_and_search(spark):
    rows = [("1", "red lamp", '{"year": 2024, "author": "Al"}', ["x", "y"], [1.0, 0.0]), ("2", "red door", '{"year": "2024"}', ["x"], [0.0, 1.0]), ("3", "blue lamp", '{"ye', None, None), ("4", "red red", None, [], [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id string, content string, metadata string, tags array<string>, vector array<float>").withColumns(
        {"is_chunk": F.lit(False), "parent_id": F.lit(None).cast("string"), "chunk_index": F.lit(None).cast("int")}
    )
    ids = lambda f: {r["id"] for r in df.filter(filters.build(f)).collect()}
    assert ids({"tag": "x"}) == {"1", "2"} and ids({"tags": ["x", "y"]}) == {"1"} and ids({"year": 2024}) == {"1"} and ids({"year": "2024"}) == {"2"} and ids({}) == {"1", "2", "3", "4"}
    out = search.search(df, "red", 3, [1.0, 0.0]).collect()
    assert out[0]["id"] in {"1", "4"} and len(out) == 3
    assert [r["id"] for r in search.search(df, "red", 5, [1.0, 0.0], "vector").collect()] == ["1", "2"]
    assert {r["id"] for r in search.search(df, "red", 5, kind="fulltext", where=filters.has_tag("x")).collect()} == {"1", "2"}


def test_chunkers():
    w = chunking.WordTokenizer()
    text = " ".join(f"w{i}" for i in range(1000))
    for size, overlap in ((512, 50), (100, 0), (10, 20), (7, 3)):
        parts = [p.split() for p in chunking.windows(text, size, overlap, w)]
        step = size - min(overlap, size - 1)
        assert parts[0][0] == "w0" and parts[-1][-1] == "w999"
        assert all(int(b[0][1:]) - int(a[0][1:]) == step for a, b in zip(parts, parts[1:], strict=False))
    assert chunking.windows("", 5, 1, w) == [] and chunking.windows("a b", 5, 1, w) == ["a b"]
    assert "".join(chunking.byte_slices("aé" * 3000, 512)) == "aé" * 3000


def test_postings_give_the_scores_of_the_texts(spark, tmp_path):
    texts = ["the red fox saw the river", "River bank, red river!", "", None, "a lamp by the river bank at night", "foxes and lamps", "red", "the the the the", "night night"]
    df = spark.createDataFrame([(f"d{k}", t, 1, "x") for k, t in enumerate(texts)], "id string, content string, pos int, term string")
    p = search.Postings.build(df, str(tmp_path / "p"))
    later = df.withColumn("content", F.when(F.col("id") == "d6", F.lit("river of red light")).otherwise(F.col("content"))).filter("id <> 'd1'")
    q = p.updated(later.filter("id = 'd6'"), spark.createDataFrame([("d1",)], "id string"), str(tmp_path / "q"))
    for query in ["river", "red river", '"red river"', "fox*", "river NOT lamp", "red OR lamp", "^the", "NEAR(red river, 3)", '"river ba"*', "absent", "the"]:
        for docs, post in ((df, p), (later, q)):
            want = {r["id"]: round(r["rank"], 9) for r in search.fts_scores(docs, query).collect()}
            assert {r["id"]: round(r["rank"], 9) for r in post.scores(query).collect()} == want, query
    some = F.col("id") != "d6"
    assert [r["id"] for r in search.fts_topk(df, "red", 5, where=some, postings=p).collect()] == [r["id"] for r in search.fts_topk(df, "red", 5, where=some).collect()]
    assert search.Postings.build(df.limit(0), str(tmp_path / "e")).scores("river").count() == 0


def test_index_is_stored_by_cell(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((8, 1, 12)) + 0.2 * rng.standard_normal((8, 60, 12))).reshape(-1, 12)
    df = spark.createDataFrame([(f"v{k:03}", [float(y) for y in x]) for k, x in enumerate(v)], "id string, vector array<float>")
    ix = ann.VectorIndex.build(df).write(str(tmp_path / "ix"))
    assert len(ix) == 480 and ix.is_built() and len(ix.centroids) == 22 and len(ix.clear()) == 0
    asked = df.filter("substr(id, 3) = '00' or substr(id, 3) = '50'").selectExpr("id as query_id", "vector as q")
    few = ix.probes_for(asked, 5)
    assert few < 22 and ix.recall(asked, 5, few) >= 0.95 and ix.recall(asked, 5, 22) == 1.0
    plan = ix.search([float(x) for x in v[0]], 5, few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters:")[1][:80]
    found = search.search(df.withColumns({"content": F.lit("x"), "metadata": F.lit("{}"), "is_chunk": F.lit(False), "parent_id": F.lit(None).cast("string"), "chunk_index": F.lit(0)}), "", 3, [float(x) for x in v[0]], "vector", index=ix)
    assert found.first()["id"] == "v000"


def test_store_facade(spark, tmp_path):
    st = Store(spark, str(tmp_path / "f"), Config.load('{"document_relations": true, "chunking": true, "chunk_strategy": "markdown", "chunk_size": 4, "chunk_threshold": 3}'))
    a = st.add("db", "t", "red apple pie", metadata='{"k": 1}')
    b = st.add("db", "t", "green apple", id="b", parent_id=a)
    assert b == "b" and st.get("db", "t", a)["metadata"] == '{"k": 1}'
    with pytest.raises(StoreError):
        st.delete("db", "t", ["b"])
    before = st._parts("db", "t")
    st.compact("db", "t")
    assert st._parts("db", "t") == (before[1][-1], []) and st.documents("db", "t").count() == 2
    st.upsert("db", "t", spark.createDataFrame([("b", "blue apple")], "id string, content string"))
    st.compact("db", "t")
    assert st.get("db", "t", "b")["content"] == "blue apple" and len(st._log("db", "t")) == 1
    found = st.search("db", "t", "apple", 5, kind="fulltext", group=True).collect()
    assert {r["parent"] for r in found} == {a, "b"} and all(len(r["chunks"]) == r["hits"] == 1 for r in found)
    st.relate("db", spark.createDataFrame([("x", "y", "cites"), ("y", "z", "cites")], "source_id string, target_id string, relation_type string"))
    assert {(r["id"], r["depth"]) for r in st.traverse("db", "x", 2).collect()} == {("x", 0), ("y", 1), ("z", 2)}
    assert [r["id"] for r in st.path("db", "x", "z").orderBy("hop").collect()] == ["x", "y", "z"]
    assert st.graph_statistics("db").first()["has_cycles"] is False
    st.ingest("db", "c", spark.createDataFrame([("m", "one two three\n\nfour five")], "id string, content string"))
    assert [r["content"] for r in st.documents("db", "c").filter("is_chunk").orderBy("chunk_index").collect()] == ["one two three", "four five"]
    st.snapshot("db", str(tmp_path / "s"))
    st.restore("db", str(tmp_path / "s"))
    assert st.documents("db", "c").count() == 3 and st.relations("db").count() == 2


def test_switches(spark, tmp_path):
    """Everything is off by default, and what is off does nothing or is refused."""
    df = spark.createDataFrame([("a", "same text"), ("b", "same text"), ("c", "other")], "id string, content string")
    off, on = Store(spark, str(tmp_path / "off")), Store(spark, str(tmp_path / "on"), Config(embedding=True, embedding_cache=True))
    for st, vectors, cached in ((off, 0, 0), (on, 3, 2)):
        st.ingest("db", "t", df, HashEmbedder(4))
        assert st.documents("db", "t").filter("vector is not null").count() == vectors and st.cache("db").count() == cached
    on.ingest("db", "t", df, HashEmbedder(4))
    assert on.cache("db").count() == 2
    rel = spark.createDataFrame([("a", "b", "cites")], "source_id string, target_id string, relation_type string")
    for refused in (lambda: off.relate("db", rel), lambda: off.traverse("db", "a", 1), lambda: Worker(off, HashEmbedder(4)).start("db", "t", str(tmp_path / "cp"))):
        with pytest.raises(StoreError):
            refused()


def test_worker_isn_t_held_up(spark, tmp_path):
    """Documents whose embedding fails don't starve those behind them."""

    class Picky(HashEmbedder):
        def embed(self, texts):
            return [None if t.startswith("bad") else v for t, v in zip(texts, super().embed(texts), strict=True)]

    st = Store(spark, str(tmp_path / "w"), Config(worker_batch=2))
    st.upsert("db", "t", spark.createDataFrame([(f"d{k}", ("bad" if k < 3 else "good") + f" {k}") for k in range(7)], "id string, content string"))
    assert Worker(st, Picky(8)).drain("db", "t") == 4


def test_embedding_service(spark):
    """The wire form of the embedding service, against a local stand-in."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            data = [{"embedding": [float(len(t)), 1.0]} for t in asked["input"]]
            body = json.dumps({"data": data[: -1 if "short" in asked["input"] else None]}).encode()
            self.send_response(200 if self.path == "/v1/embeddings" and asked["model"] == "m" else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/", "m", 2)
        df = spark.createDataFrame([("a", "xyz"), ("b", "")], "content_hash string, content string")
        assert {r[0]: list(r[1]) for r in embed(df, e).collect()} == {"a": [3.0, 1.0], "b": [0.0, 1.0]}
        with pytest.raises(ValueError):
            e.embed(["short"])
        with pytest.raises(OSError):
            HttpEmbedder(f"http://127.0.0.1:{server.server_port}", "other", 2).embed(["x"])
    finally:
        server.shutdown()


MARKDOWN = {
    "# A\ntext\n---\n\n***\nB": ["# A\ntext", "", "B"],
    "x y\n---\nz": ["x y", "z"],
    "- - -\nT\n===": ["- - -\nT\n==="],
    "a\n ___ \n****\nb\n--": ["a", "b\n--"],
    "a b c\n\nd e\n\nf g h\n\ni\n\nj k l m n o p q": ["a b c\n\nd e", "f g h\n\n\n\ni", "j k l m n", "k l m n o", "l m n o p", "m n o p q"],
    "---": [], "": [], "\n---\nq": ["", "q"],
}


def test_markdown_chunker(spark, monkeypatch):
    monkeypatch.setattr(chunking, "MARKDOWN_OVERLAP", 4)
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate([*MARKDOWN, None])], "id string, content string")
    got = {int(r["id"]): r["parts"] for r in chunking.markdown_chunks(df, 5, chunking.WordTokenizer()).collect()}
    assert [got[k] for k in range(len(got))] == [*MARKDOWN.values(), []]
    flat = chunking.strategy_chunks(df, "markdown", 5, 0, chunking.WordTokenizer())
    assert flat.filter("id = 4").orderBy("chunk_index").first()["chunk"] == "a b c\n\nd e" and flat.count() == sum(map(len, MARKDOWN.values()))
    assert [r["chunk"] for r in chunking.strategy_chunks(df.filter("id = 1"), "custom", 1, 0, chunking.WordTokenizer()).orderBy("chunk_index").collect()] == ["x y\n", "---\n", "z"]
    assert chunking.strategy_chunks(df.filter("id = 1"), "fixed", 2, 0, chunking.WordTokenizer()).count() == 2


def test_chunks_by_a_vocabulary(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"  # one token a byte
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    tok = chunking.BpeTokenizer(str(path), r"\S+|\s+")
    df = spark.createDataFrame([("a", "abcd\n\nef\n\nghijklm"), ("b", None)], "id string, content string")
    assert [r["chunk"] for r in chunking.strategy_chunks(df, "markdown", 6, 2, tok).orderBy("chunk_index").collect()] == ["abcd\n\nef", "ghijkl", "hijklm"]
    got = [r["chunk"] for r in chunking.strategy_chunks(df, "fixed", 8, 3, tok).filter("id = 'a'").orderBy("chunk_index").collect()]
    assert got == ["abcd\n\nef", "\nef\n\nghi", "ghijklm"]


def test_small_functions(spark):
    df = spark.createDataFrame([(bytes([0, 0, 128, 63, 0, 0, 0, 192, 9]), "é" * 5, "# Title \nbody", "a=1; b ;c = 2")], "b binary, t string, c string, h string")
    r = df.select(V.from_bytes("b").alias("v"), V.to_bytes(V.from_bytes("b")).alias("back"), T.estimate_tokens(F.col("t")).alias("up"), T.estimate_tokens(F.col("t"), False).alias("down"), T.heading(F.col("c")).alias("h1"), T.feature_header(F.col("h")).alias("m")).first()
    assert r["v"] == [1.0, -2.0] and len(r["back"]) == 8 and (r["up"], r["down"]) == (3, 2) and r["h1"] == "Title" and r["m"]["a"] == "1" and r["m"]["c"] == "2"
    assert Config.load("{not json").chunking is False and Config.load('{"chunking": true, "odd": 1}').extra == {"odd": 1}


def test_plan_shapes(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<float>")
    plan = search.vector_topk(df, [1.0, 0.0], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def _places(spark, n):
    """n documents, the oldest first, that wait for a vector."""
    from datetime import datetime, timedelta

    rows = [(f"d{k:02}", f"text {k}", datetime(2025, 1, 1) + timedelta(hours=k // 2)) for k in range(n)]
    return spark.createDataFrame(rows, "id string, content string, created_at timestamp")


def test_worker_drains_in_few_rounds(spark, tmp_path):
    """The queue is read once and written in rounds that double, oldest first; places of equal age go by id."""
    st = Store(spark, str(tmp_path / "w"), Config(worker_batch=2, embedding_cache=True))
    st.upsert("db", "t", _places(spark, 21))
    assert Worker(st, HashEmbedder(8)).drain("db", "t") == 21
    changes = st._changes("db", "t", DOCUMENT).filter("seq > 1").groupBy("seq").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("seq").collect()
    ids = [f"d{k:02}" for k in range(21)]
    assert [r["ids"] for r in changes] == [ids[:2], ids[2:6], ids[6:14], ids[14:]]
    docs = st.documents("db", "t")
    assert docs.count() == 21 and docs.filter("vector is null or not is_embedded").count() == 0 and st.cache("db").count() == 21
    assert Worker(st, HashEmbedder(8)).drain("db", "t") == 0


def test_rounds_over_runs():
    place = [*range(10, 13), *range(100, 101), *range(200, 207)]
    for first in (1, 2, 3, 4, 11, 12):
        got = [[p for p in place if (a is None or p >= a) and (b is None or p < b)] for a, b in rounds([(10, 3), (100, 1), (200, 7)], first)]
        assert sum(got, []) == place and all(got)
        assert [len(g) for g in got[:-1]] == [first << k for k in range(len(got) - 1)] and len(got[-1]) <= first << (len(got) - 1)
    assert rounds([], 3) == []


def test_worker_beside_other_writers(spark, tmp_path):
    """What others change, delete or add while the worker embeds: no old text's vector, no document back from the dead, other columns kept."""
    st = Store(spark, str(tmp_path / "w"), Config(worker_batch=2))
    st.upsert("db", "t", _places(spark, 6))
    plain, calls = st.embedded, []

    def embedded(*a):
        if not calls:
            mk = lambda rows: spark.createDataFrame(rows, "id string, content string, tags array<string>")
            st.upsert("db", "t", mk([("d00", "other words here", None), ("d01", "text 1", ["new"]), ("z", "late", None)]))
            st.delete("db", "t", ["d04"])
            st.compact("db", "t")
        calls.append(1)
        return plain(*a)

    st.embedded = embedded
    assert Worker(st, HashEmbedder(8)).drain("db", "t") == 5
    got = {r["id"]: r for r in st.documents("db", "t").collect()}
    assert set(got) == {"d00", "d01", "d02", "d03", "d05", "z"} and got["d01"]["tags"] == ["new"]
    assert [k for k, r in got.items() if r["vector"] is None] == ["d00"] and not got["d00"]["is_embedded"]
    assert Worker(st, HashEmbedder(8)).drain("db", "t") == 1


def test_worker_without_vectors_writes_nothing(spark, tmp_path):
    class Down(HashEmbedder):
        def embed(self, texts):
            return [None] * len(texts)

    st = Store(spark, str(tmp_path / "w"), Config(worker_batch=2, embedding_cache=True))
    st.upsert("db", "t", _places(spark, 3))
    assert Worker(st, Down(8)).drain("db", "t") == 0
    assert st._log("db", "t") == [1] and st.cache("db").count() == 0


def test_stream_drains_once_for_all_its_files(spark, tmp_path):
    """Files that were there when the last drain read the table ask for no further one; what others write later does."""
    st = Store(spark, str(tmp_path / "w"), Config(worker_batch=2, embedding_job=True))
    st.upsert("db", "t", spark.createDataFrame([("bad", "bad"), ("good", "good")], "id string, content string"))
    plain, reads = st.waiting, []
    st.waiting = lambda *a: reads.append(1) or plain(*a)

    class Picky(HashEmbedder):
        def embed(self, texts):
            return [None if t == "bad" else v for t, v in zip(texts, super().embed(texts), strict=True)]

    w = Worker(st, Picky(8))
    for k in range(3):
        w.start("db", "t", str(tmp_path / f"cp{k}"), once=True).awaitTermination()
        if k == 1:
            assert len(reads) == 1
            st.upsert("db", "t", spark.createDataFrame([("late", "late")], "id string, content string"))
    assert len(reads) == 2 and {r["id"] for r in st.documents("db", "t").filter("vector is null").collect()} == {"bad"}


def test_upsert_of_one_id_twice(spark, tmp_path):
    """Of rows with one id in a batch the last by updated_at stays."""
    st = Store(spark, str(tmp_path / "w"))
    rows = [("a", "old", "2025-01-01"), ("a", "new", "2025-01-02"), ("b", "only", "2025-01-01")]
    st.upsert("db", "t", spark.createDataFrame(rows, "id string, content string, day string").withColumn("updated_at", F.to_timestamp("day")))
    assert st._changes("db", "t", DOCUMENT).count() == 2 and st.get("db", "t", "a")["content"] == "new"
