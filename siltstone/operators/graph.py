"""Graph operators over relations(source_id, target_id, relation_type, ...): a directed multigraph whose nodes are the ids on its edges.

Loops run on the driver level by level: each is one join of the newest level with the edges, written to a folder that holds all levels and is
read as one table, and counted while it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import Levels, cut, cut_counting, discard


def of_types(relations: DataFrame, types: list[str] | None) -> DataFrame:
    """An empty list is no filter."""
    return relations.filter(F.col("relation_type").isin(types)) if types else relations


def node_set(relations: DataFrame) -> DataFrame:
    return relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def bfs(relations: DataFrame, start: str, max_depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """(id, depth) reached within max_depth steps along edges. A start without any edge left gives nothing."""
    rel = of_types(relations, types)
    edges = rel.select("source_id", "target_id").distinct()
    first = rel.filter((F.col("source_id") == start) | (F.col("target_id") == start)).limit(1).select(F.lit(start).alias("id"), F.lit(0).alias("depth"))
    levels = Levels(relations.sparkSession)
    levels.add(first)
    for d in range(1, max_depth + 1):
        newest = levels.rows(-1).select(F.col("id").alias("source_id"))
        step = edges.join(newest, "source_id").select(F.col("target_id").alias("id")).distinct()
        if not levels.add(step.join(levels.rows().select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))["rows"]:
            break
    return levels.rows().select("id", "depth")


def induced(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends in ids(id), followed or not."""
    return relations.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def shortest_path(relations: DataFrame, start: str, goal: str, max_steps: int | None = None, weight: Column | None = None) -> DataFrame:
    """(hop, id, relation_id, distance) from start at hop 0; no row if there is no path.

    Among equal predecessors the smallest id counts, among parallel edges the earliest (created_at, id). With a positive
    `weight` the cheapest path by rounds of relaxation, else the one with fewest hops. Rounds go on until the goal is
    settled or nothing new is reached; a RuntimeError says that `max_steps` rounds weren't enough."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    pick = Window.partitionBy("source_id", "target_id").orderBy("w", "created_at", "id")
    edges = cut(relations.select("source_id", "target_id", "id", "created_at", w.alias("w")).withColumn("k", F.row_number().over(pick)).filter("k = 1").drop("k"))
    if not relations.filter((F.col("source_id") == start) | (F.col("target_id") == start)).limit(1).count():
        return relations.sparkSession.createDataFrame([], "hop int, id string, relation_id string, distance double")
    if weight is not None and edges.filter("w is null or isnan(w) or w < 0").limit(1).count():
        raise ValueError("a weight is null, not a number or negative")
    levels, steps = Levels(relations.sparkSession), 0
    found = F.count_if(F.col("id") == goal)
    new = levels.add(relations.sparkSession.createDataFrame([(start, 0.0, None, None)], "id string, dist double, prev string, edge string"), goal=found)
    while new["rows"] and not (weight is None and new["goal"]):
        if steps == max_steps:
            raise RuntimeError(f"no path settled within {max_steps} steps")
        steps += 1
        newest = levels.rows(-1).select(F.col("id").alias("source_id"), "dist")
        order = Window.partitionBy("node").orderBy("d", "source_id")
        reach = (
            edges.join(newest, "source_id")
            .select(F.col("target_id").alias("node"), (F.col("dist") + F.col("w")).alias("d"), "source_id", F.col("id").alias("e"))
            .withColumn("k", F.row_number().over(order))
            .filter("k = 1")
        )
        best = levels.rows().groupBy(F.col("id").alias("node")).agg(F.min("dist").alias("old"))
        better = reach.join(best, "node", "left").filter("old is null or d < old")
        new = levels.add(better.select(F.col("node").alias("id"), F.col("d").alias("dist"), F.col("source_id").alias("prev"), F.col("e").alias("edge")), goal=found)
    trail, at = [], goal
    while at is not None:  # one row a hop: the cheapest of the node, the latest level where it was reached so cheaply
        row = levels.rows().filter(F.col("id") == at).orderBy("dist", "level").select("edge", "dist", "prev").first()
        if row is None:
            trail = []
            break
        trail.append((at, row["edge"], row["dist"]))
        at = row["prev"]
    rows = [(k, i, e, d) for k, (i, e, d) in enumerate(reversed(trail))]
    return relations.sparkSession.createDataFrame(rows, "hop int, id string, relation_id string, distance double")


def has_cycles(relations: DataFrame) -> bool:
    """Peels edges that can't lie on a cycle from both ends until none is left or none goes."""
    every = F.count(F.lit(1))
    edges, n = cut_counting(relations.select("source_id", "target_id").distinct(), left=every)
    left = n["left"]
    while left:
        into = edges.select(F.col("target_id").alias("source_id")).distinct()
        out = edges.select(F.col("source_id").alias("target_id")).distinct()
        fewer, n = cut_counting(edges.join(into, "source_id", "left_semi").join(out, "target_id", "left_semi"), left=every)
        discard(edges)
        edges = fewer
        if n["left"] == left:
            return True
        left = n["left"]
    return False


def degrees(relations: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node; parallel edges count each."""
    ends = relations.select(
        F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")
    ).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def statistics(relations: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, has_cycles."""
    cyclic = has_cycles(relations)
    nodes = node_set(relations).agg(F.count("*").alias("node_count"))
    return relations.agg(F.count("*").alias("edge_count")).crossJoin(nodes).select("node_count", "edge_count", F.lit(cyclic).alias("has_cycles"))  # one row each


def incident(relations: DataFrame, id: str) -> DataFrame:
    """Relations of a document in both directions; a loop once."""
    return relations.filter((F.col("source_id") == id) | (F.col("target_id") == id))


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def export_lines(relations: DataFrame, form: str = "dot") -> DataFrame:
    """(line) of the edges as DOT, GraphML or JSON lines; headers are the writer's."""
    if form == "dot":
        line = F.concat(F.lit("  "), _quoted("source_id"), F.lit(" -> "), _quoted("target_id"), F.lit(" [label="), _quoted("relation_type"), F.lit("];"))
    elif form == "graphml":
        esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        line = F.concat(F.lit('<edge source="'), esc("source_id"), F.lit('" target="'), esc("target_id"), F.lit('"><data key="type">'), esc("relation_type"), F.lit("</data></edge>"))
    elif form == "json":
        line = F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type")))
    else:
        raise ValueError(f"unknown form {form!r}")
    return relations.select(line.alias("line"))


def ui_graph(relations: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label by first heading) and edges without repeated relation ids."""
    from siltstone.functions.text import heading

    nodes = node_set(relations).join(docs.select("id", "content"), "id", "left").select("id", F.coalesce(heading(F.col("content")), F.lit("Unknown")).alias("label"))
    return nodes, relations.dropDuplicates(["id"]).select("id", "source_id", "target_id", "relation_type")
