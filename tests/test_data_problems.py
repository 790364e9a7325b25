import random
from datetime import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import hierarchy, incremental, multivalue, orphans

DOC = "id string, parent_id string, created_at timestamp, tags string, extra int, key string, band int"
REL = "id string, source_id string, target_id string, relation_type string, created_at timestamp, salt int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) if len(r) == 3 else (r[0], r[1], r[2], r[3], None, None, None) for r in rows], DOC)


def rels(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], REL)


T1, T2, T3 = dt(2025, 1, 5), dt(2025, 2, 5), dt(2025, 3, 5)


# ------------------------------------------------------------------ p1
@pytest.fixture
def orphan_tables(spark):
    d = docs(spark, [("A", None, T1), ("b", " a ", T2), ("c", "gone", T2), ("d", "later", T1), ("later", "", T3), ("e", "dead", None)])
    r = rels(
        spark,
        [("r1", "a", "B ", "x", T2), ("r1", "a", "B ", "x", T2), ("r2", "nowhere", "a", "x", T2), ("r3", None, "", "x", T2), ("r4", "later", "later", "x", T2), ("r5", "dead", "a", "x", None)],
    )
    x = spark.createDataFrame([("DEAD", T1), ("dead", T1), (None, T1)], "document_id string, deleted_at timestamp")
    return r, d, x


@pytest.mark.parametrize("kw", [{}, {"range_keys": 1, "batch_rows": 1}, {"batch_rows": 2}])
def test_orphans(orphan_tables, kw):
    got = {tuple(r) for r in orphans.orphan_rows(*orphan_tables, **kw).collect()}
    assert got == {
        ("document_relations", "r2", "source_id"), ("document_relations", "r4", "source_id"), ("document_relations", "r4", "target_id"), ("document_relations", "r5", "source_id"),
        ("store_documents", "c", "parent_id"), ("store_documents", "d", "parent_id"), ("store_documents", "e", "parent_id"),
    }


def test_orphan_report(orphan_tables):
    got = {(r["ref_field"], r["kind"], r["month"]): r["orphans"] for r in orphans.orphan_report(*orphan_tables).collect()}
    assert got == {
        ("source_id", "missing", "2025-02"): 1, ("source_id", "created_later", "2025-02"): 1, ("target_id", "created_later", "2025-02"): 1, ("source_id", "deleted", None): 1,
        ("parent_id", "missing", "2025-02"): 1, ("parent_id", "created_later", "2025-01"): 1, ("parent_id", "deleted", None): 1,
    }


def test_orphans_empty(spark):
    assert orphans.orphan_rows(rels(spark, []), docs(spark, [])).count() == 0
    assert orphans.orphan_rows(rels(spark, [("r", "a", "b", "x", T1)]), docs(spark, [])).count() == 2


def test_orphans_hot_key_against_brute_force(spark):
    rng = random.Random(1)
    ids = [f"d{k}" for k in range(300)]
    d = docs(spark, [(i, rng.choice([None, "hot", *ids, "x1"]), T1) for i in ids] + [("hot", None, T2)])
    rows = [(f"r{k}", rng.choice(ids), "hot" if k % 3 else rng.choice([*ids, "missing"]), "x", T1) for k in range(900)]
    got = {(r["row_id"], r["ref_field"]) for r in orphans.orphan_rows(rels(spark, rows), d, range_keys=50, batch_rows=40).collect()}
    want = {(r[0], f) for r in rows for f, v in (("source_id", r[1]), ("target_id", r[2])) if v in ("hot", "missing")}
    want |= {(x["id"], "parent_id") for x in d.collect() if x["parent_id"] in ("hot", "x1")}
    assert got == want


# ------------------------------------------------------------------ p2
def test_due_documents(spark):
    d = spark.createDataFrame(
        [("a", dt(2025, 1, 1, 0, 0, 0, 1999), True), ("b", T1, None), ("c", T1, False), ("D", T1, True), ("e", None, True), (None, T1, True), ("f", T2, True), ("f2", T1, True)],
        "id string, updated_at timestamp, vectorize boolean",
    )
    base, b = 1735689600001, 1736035200000
    a = spark.createDataFrame(
        [(1, "A ", base, "done"), (1, "A ", base, "done"), (2, "b", b, "done"), (1, "d", b, "error"), (1, "f", b, "done"), (None, "f2", b, "done"), (1, None, b, "done")],
        "run_id long, document_id string, version_ms long, outcome string",
    )
    runs = spark.createDataFrame([(1, "success"), (1, "success"), (2, "failed"), (3, "running")], "run_id long, status string")
    assert {r[0] for r in incremental.due_documents(d, a, runs).collect()} == {"b", "D", "f", "f2"}
    assert {r[0] for r in incremental.due_documents(d, a.limit(0), runs.limit(0)).collect()} == {"a", "b", "D", "f", "f2"}
    assert incremental.due_documents(d.limit(0), a, runs).count() == 0


def test_incremental_runs_survive_crashes(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "key string, version long, at long")
    keys = lambda df: sorted((r["key"], r["version"]) for r in df.select("key", "version").distinct().collect())
    runs = incremental.IncrementalRuns(spark, str(tmp_path / "ledger"))
    day1 = mk([("a", 10, 10), ("b", 20, 20), ("b", 20, 20), (None, 1, 1), ("n", None, 1)])
    todo = runs.pending(day1, "at")
    assert keys(todo) == [("a", 10), ("b", 20)]
    # a crash before the commit leaves nothing behind, an empty commit file is none
    todo.select("key", "version").write.parquet(str(tmp_path / "ledger/done-1-crashed"))
    (tmp_path / "ledger/1.commit").write_text("")
    assert keys(runs.pending(day1, "at")) == [("a", 10), ("b", 20)]
    # b failed in a run that committed: it is due again, though it arrived before the bound
    runs.commit(1, todo.filter("key = 'a'"), oldest_open=25, taken=todo)
    assert keys(runs.pending(day1, "at")) == [("b", 20)]
    # c was written by a transaction open at the last run, a changed, late has an old version but arrived now
    day2 = mk([("a", 30, 30), ("b", 20, 20), ("c", 16, 26), ("late", 5, 31), ("unknown", 3, None)])
    assert keys(runs.pending(day2, "at")) == [("a", 30), ("b", 20), ("c", 16), ("late", 5), ("unknown", 3)] == keys(runs.pending(day2))
    with pytest.raises(ValueError):
        runs.commit(1, todo, 0)
    # runs 2 and 3 read at once; 3 commits first
    two = mk([(r["key"], r["version"], r["at"]) for r in runs.pending(day2, "at").collect()])
    runs.commit(3, two.filter("key in ('a', 'c')"), 40, taken=two)
    runs.commit(2, two.filter("key in ('late')"), 35, taken=two)
    assert keys(runs.pending(day2, "at")) == [("b", 20), ("unknown", 3)]
    # a commit that doesn't say what its run took: earlier bounds still hold
    runs.commit(4, mk([("b", 20, 20)]), 90)
    assert keys(runs.pending(day2, "at")) == [("unknown", 3)] and runs.pending(day2.limit(0), "at").count() == 0


# ------------------------------------------------------------------ p4
def brute_pairs(links):
    up = {}
    for n, p in links:
        up.setdefault(n, set()).add(p)
    out = set()
    for n in up:
        seen, todo = set(), list(up[n])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo.extend(up.get(p, ()))
        out |= {(a, n) for a in seen}
    return out


def pairs_of(spark, links):
    df = spark.createDataFrame(links, "node string, parent string")
    return [tuple(r) for r in hierarchy.Hierarchy(df).pairs().collect()]


GRAPHS = [
    [("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("b", "a")],
    [("a", "a"), ("b", "a")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("x", "y")],
    [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "r"), ("e", "d"), ("c", "z")],
    [("a", "b"), ("b", "c"), ("c", "x"), ("c", "a"), ("x", "y"), ("k", "c")],
    [(f"n{i + 1:02}", f"n{i:02}") for i in range(70)],
    [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("a", "d"), ("q", "a")],
    [("x", "a"), ("x", "z"), ("z", "x"), ("s", "b"), ("s", "s")],
    [(f"n{i:02}", f"n{(i + 1) % 23:02}") for i in range(23)] + [("t1", "n05"), ("t2", "t1")],
    [(f"m{i}", f"m{i + 1}") for i in range(6)] + [("m6", "m3"), ("m2", "zz")],
]
for _seed in range(3):
    _rng = random.Random(_seed)
    GRAPHS.append([(f"n{k}", f"n{_rng.randrange(max(1, k))}") for k in range(1, 60)] + [(f"n{_rng.randrange(60)}", f"n{_rng.randrange(60)}") for _ in range(4)])


def test_hierarchy(spark):
    """All graphs at once, each with its own names."""
    links = [(f"{g}.{a}", f"{g}.{b}") for g, graph in enumerate(GRAPHS) for a, b in graph]
    got = pairs_of(spark, links)
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(links)


def test_hierarchy_cycles_over_further_links(spark):
    links = [("x", "a"), ("x", "z"), ("z", "x"), ("s", "b"), ("s", "s"), ("k", "x")]
    h = hierarchy.Hierarchy(spark.createDataFrame(links, "node string, parent string"))
    n = {r["node"]: r for r in h.nodes().collect()}
    assert {k for k, r in n.items() if r["on_cycle"]} == {"x", "z", "s"} == {r["node"] for r in h.cycle_members().collect()}
    assert n["k"]["path"] == "a/x/k" and n["a"]["descendants"] == 3 and n["z"]["descendants"] == 3 and n["s"]["descendants"] == 1


def test_hierarchy_wide_parent(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS", 7)
    links = [(f"c{k}", "p") for k in range(60)] + [(f"g{k}", f"c{k}") for k in range(30)] + [("p", "r")]
    h = hierarchy.Hierarchy(spark.createDataFrame(links, "node string, parent string"))
    assert {tuple(r) for r in h.pairs().collect()} == brute_pairs(links)
    s = {r["node"]: r for r in h.sets.collect()}
    assert sorted(r["pre"] for r in s.values()) == list(range(92)) and s["r"]["size"] == 92 and s["g3"]["depth"] == 3


def test_hierarchy_nodes_and_documents(spark):
    d = docs(spark, [("A", None, T1), ("b", " a", T1), ("c", "b", T1), ("d", "missing", T1), ("e", "", T1), (None, "a", T1)])
    r = rels(spark, [("1", "e", "b", "child_of", T1), ("2", "D", "e", " Parent_Of", T1), ("3", "e", "zzz", "child_of", T1), ("4", "a", "c", "references", T1), ("5", None, "a", "child_of", T1)])
    assert {tuple(x) for x in hierarchy.ancestor_pairs(d, r).collect()} == {("A", "b"), ("A", "c"), ("b", "c"), ("b", "e"), ("A", "e"), ("d", "e")}
    n = {x["node"]: x for x in hierarchy.Hierarchy(hierarchy.parent_links(d)).nodes().collect()}
    assert n["c"]["path"] == "a/b/c" and n["c"]["depth"] == 2 and n["a"]["descendants"] == 2 and n["c"]["root"] == "a"
    ring = {x["node"]: x for x in hierarchy.Hierarchy(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "node string, parent string")).nodes().collect()}
    assert ring["a"]["on_cycle"] and ring["b"]["on_cycle"] and not ring["c"]["on_cycle"]
    assert hierarchy.ancestor_pairs(docs(spark, []), rels(spark, [])).count() == 0


def test_hierarchy_nodes_without_links_and_other_parents(spark):
    d = docs(spark, [("a", None, T1), ("b", "a", T1), ("c", "b", T1), (" Alone", "", T1), ("x", "y", T1), ("y", "x", T1), ("lost", "gone", T1), (None, None, T1)])
    r = rels(spark, [("1", "b", "c", "child_of", T1)])
    n = {x["node"]: x for x in hierarchy.Hierarchy(hierarchy.parent_links(d, r), hierarchy.node_keys(d)).nodes().collect()}
    assert set(n) == {"a", "b", "c", "alone", "x", "y", "lost"}
    for k in ("alone", "lost"):
        assert tuple(n[k][c] for c in ("root", "depth", "path", "descendants", "on_cycle")) == (k, 0, k, 0, False)
    assert {k for k, x in n.items() if x["on_cycle"]} == {"b", "c", "x", "y"}
    alone = hierarchy.Hierarchy(hierarchy.parent_links(docs(spark, [("q", None, T1)])), hierarchy.node_keys(docs(spark, [("q", None, T1)]))).nodes().collect()
    assert [x["path"] for x in alone] == ["q"]


# ------------------------------------------------------------------ p7
def brute_tags(text):
    """Hand-written scanner."""
    import json

    if text is None:
        return []
    t = text.strip(" \t\r\n ")
    if len(t) >= 2 and t[0] + t[-1] in ("[]", "{}"):
        if t[0] == "[":
            try:
                got = json.loads(t)
                return [s for s in ((x if isinstance(x, str) else json.dumps(x)).strip(" \t\r\n ") for x in got if x is not None) if s]
            except ValueError:
                pass
        t = t[1:-1]
    out, i = [], 0
    while i <= len(t):
        j = i
        while j < len(t) and t[j] in "  ":
            j += 1
        value, rest = "", i
        if j < len(t) and t[j] in "\"'":
            q, k, v = t[j], j + 1, ""
            while k < len(t):
                if t[k] == q and t[k : k + 2] == q + q:
                    v += q
                    k += 2
                elif t[k] == q:
                    break
                else:
                    v += t[k]
                    k += 1
            if k < len(t):
                value, rest = v, k + 1
        e = rest
        while e < len(t) and t[e] not in ",;|\t\r\n":
            e += 1
        value = (value + t[rest:e]).strip(" \t\r\n ")
        if value:
            out.append(value)
        i = e + 1
    return out


CASES = [
    None, "", "  ", "a, b;c|d\te\nf", '"x, y", \'p; q\' , plain', '"3.5"" disk", the "old" way', "[\"a, b\", \"c\", null, \"\"]", "[not json, x]", "{a,'b c',\"d\"\"e\"}", '"unclosed, a', "a,,;b", "[]", "{}", ",",
    "0,\"q, r\"", "'it''s',it's", "a \"b, c\" d", "  \"a\"  ,b ", "[\"na\\u00efve\"]", "a, a, a", "a,",
]


def test_tags(spark):
    df = docs(spark, [(str(k), None, T1, c) for k, c in enumerate(CASES)])
    got = {}
    for r in multivalue.explode_values(df).collect():
        got.setdefault(int(r["id"]), {})[r["pos"]] = r["tag"]
    for k, c in enumerate(CASES):
        assert [got.get(k, {})[i] for i in range(len(got.get(k, {})))] == brute_tags(c), c


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;|\"'\t\n{}0", max_size=14), min_size=30, max_size=60))
def test_tags_random(spark, texts):
    df = docs(spark, [(str(k), None, T1, c) for k, c in enumerate(texts)])
    got = {}
    for r in multivalue.explode_values(df).collect():
        got.setdefault(int(r["id"]), {})[r["pos"]] = r["tag"]
    for k, c in enumerate(texts):
        assert list(got.get(k, {}).values()) == brute_tags(c), repr(c)


def test_tags_long_and_empty(spark):
    long = ",".join(f'"v {i}, x"' for i in range(20_000))
    assert multivalue.explode_values(docs(spark, [("a", None, T1, long)])).count() == 20_000
    assert multivalue.explode_values(docs(spark, [])).count() == 0
