"""Document trees: nodes with node, parent, pos. Walks double their reach with each round, so a tree of any depth takes as many rounds as its depth has binary digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Levels that headings may have: one for each number of a numbering of 80 characters.
DEEPEST = 40


def _climbed(nodes: DataFrame, flag: Column | None = None) -> DataFrame:
    """node, top (the highest known node above it, or itself), depth, open, and whether a node above is flagged; open ones go round in a cycle."""
    marked = nodes.select("node", "parent", (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("own"))
    up = marked.select(F.col("node").alias("parent"), F.col("own").alias("above"), F.lit(True).alias("known"))
    first = marked.join(up, "parent", "left")
    known = F.col("known").isNotNull()
    state = first.select("node", F.when(known, F.col("parent")).otherwise(F.col("node")).alias("top"), F.when(known, 1).otherwise(0).cast("long").alias("depth"), known.alias("open"), F.coalesce("above", F.lit(False)).alias("flagged"))
    state = staged(state, "tree")
    for _ in range(state.count().bit_length() + 1):
        if state.where("open").isEmpty():
            break
        ahead = state.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("open").alias("_open"), F.col("flagged").alias("_flagged"))
        jumped = state.where("open").join(ahead, "top").select("node", F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_open").alias("open"), (F.col("flagged") | F.col("_flagged")).alias("flagged"))
        state = staged(state.where("NOT open").union(jumped), "tree")
    return state


def preorder(nodes: DataFrame, root: str) -> DataFrame:
    """node, depth and path (positions from the root) of all nodes that the root reaches. Ordered by path they are the preorder walk."""
    reached = _climbed(nodes).where((F.col("top") == root) & ~F.col("open")).select("node", "depth")
    rows = nodes.join(reached, "node").select("node", "parent", "depth", F.array("pos").alias("path"))
    state = staged(rows.select("node", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("top"), "path"), "paths")
    while not state.where("top IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        joined = state.join(above, "top", "left").select("node", "depth", F.col("_top").alias("top"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
        state = staged(joined, "paths")
    return state.drop("top")


def orphans(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes that the root does not reach."""
    reached = _climbed(nodes).where((F.col("top") == root) & ~F.col("open")).select("node")
    return nodes.join(reached, "node", "left_anti")


def cycles(nodes: DataFrame) -> DataFrame:
    """Nodes that are above themselves: where walks end that go on for as many steps as there are nodes."""
    return _climbed(nodes).where("open").select(F.col("top").alias("node")).distinct()


def below(nodes: DataFrame, flag: Column) -> DataFrame:
    """node, below: whether a node above is flagged."""
    return _climbed(nodes, flag).select("node", F.col("flagged").alias("below"))


def level_jumps(ordered: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Headings over one level below the heading before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return ordered.withColumn("before", F.lag("level").over(w)).where("level > before + 1")


def section_parents(headings: DataFrame, by: list[str], order: str, deepest: int = DEEPEST) -> DataFrame:
    """The nearest heading before of a lower level; the root (null) if there is none. The last place of each level is a running maximum of one window."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > n, F.max(F.when(F.col("level") == n, F.col(order))).over(w)) for n in range(1, deepest)]
    return headings.withColumn("parent", F.greatest(*last))


def sections(flow: DataFrame, by: list[str], order: str) -> DataFrame:
    """flow with section: the place of the heading that a row stands under (null above the first), and for a heading that of its parent section."""
    heads = section_parents(flow.where("level IS NOT NULL"), by, order).select(*by, order, F.col("parent").alias("_parent"))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    under = F.last(F.when(F.col("level").isNotNull(), F.col(order)), ignorenulls=True).over(w)
    return flow.withColumn("_under", under).join(heads, [*by, order], "left").withColumn("section", F.when(F.col("level").isNotNull(), F.col("_parent")).otherwise(F.col("_under"))).drop("_under", "_parent")


def children(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The nodes of each parent, in order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"])
    return nodes.where("parent IS NOT NULL").groupBy(*by, "parent").agg(own.alias("children"))
