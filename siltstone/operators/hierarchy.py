"""Parent-child links to full hierarchies.

Every node hangs below the smallest of its parents; these first links make a forest, and what is left are further links. Subtree
sizes go up the forest and preorder ranges come down it, both by doubling: after round k a node's jump reaches 2^k steps up,
its size counts the descendants nearer than 2^k, and its preorder number sums the offsets of 2^k ancestors. So a
forest of depth d takes log2(d) rounds of one join each, not d. Offsets among siblings are prefix sums of subtree sizes, in
two levels, so a parent of very many children isn't one task. A node's range (pre, pre + size - 1) then holds
its descendants: ancestors and descendants come from a join of ranges, cut into blocks of `BLOCK` numbers so that a huge tree
spreads over tasks.

Nodes whose jumps never end are what the upward pass can't process: they lie on a cycle of first links or below one. Each jump
carries the smallest node it has passed; once a round changes none of these, the one node of each cycle that is smallest on
its own way is known. Its first link is set apart as a further link, which cuts the cycle, and only these nodes
climb again. Further links are then followed on top of the ranges: the nodes with a further link form a small graph, closed
by squaring, and nested-set ranges give what is above and below it.

Each round writes one table and counts what it left meanwhile (an observation, no second pass). Rows whose jump has ended don't
enter a round's join by jump, so roots gather no null keys; the many nodes whose jump is one root are the large side of
an inner join with one row a key, which adaptive execution splits (`spark.sql.adaptive.skewJoin`).

Defined cases: references compare trimmed and in lower case; links with an end that is no node, null and empty ones
are dropped; repeated links count once; a node that is its own parent is a cycle of one; a node without any link is a
root of its own if `nodes` names it; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut, cut_counting, discard, ref_key

BLOCK = 64
SIBLINGS = 20_000


def node_keys(documents: DataFrame) -> DataFrame:
    """Distinct (node, name) of the documents, linked or not: the key and the id it is written as."""
    return documents.select(ref_key("id").alias("node"), F.col("id").alias("name")).filter("node is not null").groupBy("node").agg(F.min("name").alias("name"))


def parent_links(documents: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Distinct (node, parent) keys: parent_id, child_of (source to target) and parent_of (target to source)."""
    links = documents.select(ref_key("id").alias("node"), ref_key("parent_id").alias("parent"))
    if relations is not None:
        kind = F.lower(F.trim("relation_type"))
        up = kind == "child_of"
        links = links.unionByName(
            relations.filter(kind.isin("child_of", "parent_of")).select(
                ref_key(F.when(up, F.col("source_id")).otherwise(F.col("target_id"))).alias("node"),
                ref_key(F.when(up, F.col("target_id")).otherwise(F.col("source_id"))).alias("parent"),
            )
        )
    nodes = documents.select(ref_key("id").alias("k")).filter("k is not null").distinct()
    return (
        links.filter("node is not null and parent is not null")
        .distinct()
        .join(nodes, F.col("node") == F.col("k"), "left_semi")
        .join(nodes.withColumnRenamed("k", "k2"), F.col("parent") == F.col("k2"), "left_semi")
    )


def climb(tree: DataFrame) -> tuple[DataFrame, int, int]:
    """Sizes upward over (node, parent, ...) with one row a node and a null parent at roots.

    Gives (node, parent, ..., jump, low, depth, size), the number of rounds and the number of rows whose jump never ends. For
    the rest depth and size are right; of those that never end, the smallest of each cycle has low = node."""
    own = tree.columns
    s = tree.withColumns({"jump": F.col("parent"), "low": F.col("parent"), "depth": F.col("parent").isNotNull().cast("int"), "size": F.lit(1).cast("long")})
    rounds, left, last = 0, None, None
    while True:
        act = s.filter("jump is not null")
        add = act.groupBy("jump").agg(F.sum("size").alias("add")).withColumnRenamed("jump", "node")
        far = s.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("low").alias("low2"), F.col("depth").alias("more"))
        moved = act.join(far, "jump").select(
            *own, F.col("next").alias("jump"), F.least("low", "low2").alias("low"), (F.col("depth") + F.col("more")).alias("depth"), "size",
            (F.col("next").isNotNull() & (F.col("low2") < F.col("low"))).alias("lower"),
        )
        still = s.filter("jump is null").withColumn("lower", F.lit(False))
        s = moved.unionByName(still).join(add, "node", "left").withColumn("size", F.col("size") + F.coalesce("add", F.lit(0))).drop("add")
        table, n = cut_counting(s, active=F.count_if(F.col("jump").isNotNull()), lower=F.count_if("lower"))
        if last is not None:
            discard(last)
        s, last, rounds = table.drop("lower"), table, rounds + 1
        if not n["active"] or (n["active"] == left and not n["lower"]):
            return s, rounds, n["active"]
        left = n["active"]


def _offsets(s: DataFrame) -> DataFrame:
    """Adds `pre`, a child's place below its parent: 1 and the sizes of its smaller siblings; 0 at roots."""
    kids = s.filter("parent is not null")
    slices = kids.groupBy("parent").agg(F.ceil(F.count("*") / SIBLINGS).cast("int").alias("slices")).filter("slices > 1")
    kids = kids.join(slices, "parent", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"), F.lit(0)))
    sums = kids.filter("slices is not null").groupBy("parent", "slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("parent", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("parent", "slice").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = kids.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)) + 1).join(sums, ["parent", "slice"], "left")
    placed = placed.select(*s.columns, (F.col("offset") + F.coalesce("base", F.lit(0))).alias("pre"))
    return placed.unionByName(s.filter("parent is null").withColumn("pre", F.lit(0).cast("long")))


def nested_sets(tree: DataFrame) -> DataFrame:
    """(node, parent, ..., root, depth, pre, size) of a table (node, parent, ...), one row a node, parent null at roots.

    pre counts from 0 within the root's tree; the descendants of a node are those with pre in (pre, pre + size - 1]. On a cycle
    the smallest node becomes a root: its parent is null here."""
    s, rounds, endless = climb(tree)
    if endless:
        caught = s.filter("jump is not null").withColumn("parent", F.when(F.col("low") != F.col("node"), F.col("parent")))
        again, more, _ = climb(caught.select(*tree.columns))
        s, rounds = s.filter("jump is null").unionByName(again), max(rounds, more)
    keep = [*tree.columns, "depth", "size"]
    top = F.when(F.col("parent").isNull(), F.col("node"))
    p = cut(_offsets(s.select(*keep)).withColumns({"jump": F.col("parent"), "root": top}))
    for _ in range(rounds):  # as many as the way up took
        far = p.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("top"), F.col("pre").alias("more"))
        moved = p.filter("jump is not null").join(far, "jump").select(
            *keep, (F.col("pre") + F.col("more")).alias("pre"), F.col("next").alias("jump"), F.col("top").alias("root")
        )
        last, p = p, cut(moved.unionByName(p.filter("jump is null")))
        discard(last)
    return p.select(*keep, "pre", "root")


def _block(c: Column) -> Column:
    return F.shiftright(c, BLOCK.bit_length() - 1)


def range_pairs(above: DataFrame, below: DataFrame) -> DataFrame:
    """(ancestor, ancestor_name, node, name, steps) for the nodes of `below` and their proper ancestors in `above`, both nested sets."""
    hi = F.col("pre") + F.col("size") - 1
    above = above.filter("size > 1").select(
        "root", F.col("node").alias("ancestor"), F.col("name").alias("ancestor_name"), F.col("pre").alias("lo"), hi.alias("hi"), F.col("depth").alias("at"),
        F.explode(F.sequence(_block(F.col("pre") + 1), _block(hi))).alias("block"),
    )
    below = below.select("root", "node", "name", "pre", "depth", _block(F.col("pre")).alias("block"))
    return below.join(above, ["root", "block"]).filter("pre > lo and pre <= hi").select("ancestor", "ancestor_name", "node", "name", (F.col("depth") - F.col("at")).alias("steps"))


class Hierarchy:
    """Nested sets of a graph of (node, parent) links, with its further links set apart."""

    def __init__(self, links: DataFrame, nodes: DataFrame | None = None, linked_only: bool = False):
        """nodes: (node[, name]) keys that stand in the hierarchy even where no link names them, unless linked_only."""
        links = cut(links.select("node", "parent").distinct())
        none, yes = F.lit(None).cast("string"), F.lit(True)
        first = F.when(F.col("parent") != F.col("node"), F.col("parent"))
        rows = links.select("node", first.alias("parent"), none.alias("name"), yes.alias("linked")).unionByName(
            links.select(F.col("parent").alias("node"), none.alias("parent"), none.alias("name"), yes.alias("linked"))
        )
        if nodes is not None:
            name = F.col("name") if "name" in nodes.columns else F.col("node")
            rows = rows.unionByName(nodes.select("node", none.alias("parent"), name.alias("name"), F.lit(not linked_only).alias("linked")))
        tree = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("name").alias("name"), F.max("linked").alias("linked"))
        tree = tree.filter("linked").select("node", "parent", F.coalesce("name", "node").alias("name"))
        self.sets = nested_sets(cut(tree))
        self.extras, n = cut_counting(
            links.join(self.sets.select("node", "parent"), ["node", "parent"], "left_anti").select(F.col("node").alias("foot"), F.col("parent").alias("over")),
            n=F.count(F.lit(1)),
        )
        self._any_extras = n["n"] > 0

    def _extra_pairs(self) -> DataFrame:
        """Distinct (ancestor, ancestor_name, node, name) that only further links bring about, a cycle's nodes with themselves among them."""
        rows = lambda keys: self.sets.join(keys, "node", "left_semi")
        over = rows(self.extras.select(F.col("over").alias("node")))
        up = range_pairs(self.sets, over).select("ancestor", F.col("node").alias("over")).unionByName(over.select(F.col("node").alias("ancestor"), F.col("node").alias("over")))
        step = cut(self.extras.join(up, "over").select("foot", "ancestor").distinct())
        feet = step.select("foot").distinct()
        hops, n = cut_counting(step.join(feet.withColumnRenamed("foot", "ancestor"), "ancestor", "left_semi").select("foot", F.col("ancestor").alias("next")), n=F.count(F.lit(1)))
        count = 0
        while n["n"] != count:  # squaring closes the graph of the feet
            count = n["n"]
            far = hops.select(F.col("foot").alias("next"), F.col("next").alias("last"))
            hops, n = cut_counting(hops.unionByName(hops.join(far, "next").select("foot", F.col("last").alias("next"))).distinct(), n=F.count(F.lit(1)))
        reach = step
        if count:
            reach = step.unionByName(hops.join(step.select(F.col("foot").alias("next"), "ancestor"), "next").select("foot", "ancestor")).distinct()
        reach = reach.join(
            self.sets.select(F.col("node").alias("ancestor"), F.col("name").alias("ancestor_name"), F.col("root").alias("aroot"), F.col("pre").alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi")),
            "ancestor",
        )
        own = rows(feet.withColumnRenamed("foot", "node"))
        down = range_pairs(own, self.sets).select(F.col("ancestor").alias("foot"), "node").unionByName(own.select(F.col("node").alias("foot"), "node"))
        down = down.join(self.sets.select("node", "name", "root", "pre"), "node")
        new = ~((F.col("aroot") == F.col("root")) & (F.col("pre") > F.col("lo")) & (F.col("pre") <= F.col("hi")))  # the rest stand in the forest
        return down.join(reach, "foot").filter(new).select("ancestor", "ancestor_name", "node", "name").distinct()

    def named_pairs(self) -> DataFrame:
        """Distinct (ancestor, ancestor_name, node, name): the node reaches the ancestor by one or more steps; nodes on a cycle reach themselves."""
        tree = range_pairs(self.sets, self.sets).drop("steps")
        return tree.unionByName(self._extra_pairs()) if self._any_extras else tree

    def pairs(self) -> DataFrame:
        return self.named_pairs().select("ancestor", "node")

    def cycle_members(self) -> DataFrame:
        """(node) on any cycle."""
        found = self._extra_pairs() if self._any_extras else self.named_pairs().limit(0)
        return found.filter("ancestor = node").select("node")

    def nodes(self) -> DataFrame:
        """One row a node: name, root, depth, path (root first, joined by '/'), descendants, on_cycle.

        Root, depth and path follow the smallest parent other than the node itself; a cycle of such links begins at its smallest
        node. Descendants count every node that reaches this one over any link, a cycle's node itself included;
        on_cycle is true for a node that reaches itself over any links."""
        trail = range_pairs(self.sets, self.sets).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("steps", "ancestor")), asc=False).alias("above"))
        above = F.array_join(F.transform("above", lambda x: x["ancestor"]), "/")
        rows = self.sets.join(trail, "node", "left").select("node", "name", "root", "depth", F.concat_ws("/", above, "node").alias("path"), (F.col("size") - 1).alias("below"))
        if not self._any_extras:
            return rows.select("node", "name", "root", "depth", "path", F.lit(False).alias("on_cycle"), F.col("below").alias("descendants"))
        more = self._extra_pairs().groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("more"), F.max(F.col("ancestor") == F.col("node")).alias("on_cycle"))
        return rows.join(more, "node", "left").select(
            "node", "name", "root", "depth", "path", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("descendants")
        )


def ancestor_pairs(documents: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, node_id) under the documents' own ids."""
    h = Hierarchy(parent_links(documents, relations), node_keys(documents), linked_only=True)
    return h.named_pairs().select(F.col("ancestor_name").alias("ancestor_id"), F.col("name").alias("node_id"))
