"""Operators on rooted trees held as node tables.

A tree is ``(node_id, parent_id, branch_length, is_leaf)``.  Context comes from
its ancestor closure ``(node_id, ancestor_id, dist, hops)``, whose size is nodes
times depth, never leaves squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isolark.session import cut_lineage


def closure(nodes: DataFrame) -> DataFrame:
    """Every (node, ancestor-or-self) with path length and hops, by pointer doubling.

    Each step doubles the reach, so the number of joins is log2 of the depth.
    Blank or negative branch lengths count as zero.
    """
    length = F.greatest(F.coalesce("branch_length", F.lit(0.0)), F.lit(0.0))
    edges = nodes.filter(F.col("parent_id").isNotNull()).select(
        "node_id", F.col("parent_id").alias("ancestor_id"), length.alias("dist"), F.lit(1).alias("hops")
    )
    known, reach = cut_lineage(edges), 1
    while True:
        frontier = known.filter(F.col("hops") == reach)
        # Only inner nodes can continue a path, which keeps the right side small.
        upper = known.join(nodes.filter("not is_leaf").select("node_id"), "node_id", "left_semi").select(
            F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("_top"), F.col("dist").alias("_d"), F.col("hops").alias("_h")
        )
        longer = frontier.join(upper, "ancestor_id").select(
            "node_id", F.col("_top").alias("ancestor_id"), (F.col("dist") + F.col("_d")).alias("dist"), (F.col("hops") + F.col("_h")).alias("hops")
        )
        longer = cut_lineage(longer)
        if longer.isEmpty():
            break
        known, reach = cut_lineage(known.unionByName(longer)), reach * 2
    self_rows = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"))
    return known.unionByName(self_rows)


def root_depth(closed: DataFrame) -> DataFrame:
    """Distance of every node to its root."""
    return closed.groupBy("node_id").agg(F.max_by("dist", "hops").alias("root_dist"), F.max("hops").alias("depth"))


def leaf_counts(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    leaves = nodes.filter("is_leaf").select("node_id")
    return closed.join(leaves, "node_id", "left_semi").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("leaf_count"))


def patristic(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Tree distance and MRCA of the given (left_leaf, right_leaf) pairs; unknown leaves drop out."""
    a = closed.select(F.col("node_id").alias("left_leaf"), "ancestor_id", F.col("dist").alias("_a"), F.col("hops").alias("_h"))
    b = closed.select(F.col("node_id").alias("right_leaf"), "ancestor_id", F.col("dist").alias("_b"))
    met = pairs.join(a, "left_leaf").join(b, ["right_leaf", "ancestor_id"])
    return met.groupBy("left_leaf", "right_leaf").agg(
        F.min_by("ancestor_id", "_h").alias("mrca"), F.round(F.min_by(F.col("_a") + F.col("_b"), "_h"), 6).alias("distance")
    )


def leaf_isolation(nodes: DataFrame) -> DataFrame:
    """Own branch of each leaf scaled by the longest one."""
    leaves = nodes.filter("is_leaf").select("node_id", F.coalesce("branch_length", F.lit(0.0)).alias("_b"))
    longest = leaves.agg(F.max("_b")).scalar()
    scale = F.when(longest == 0, F.lit(1.0)).otherwise(longest)
    return leaves.select("node_id", F.round(F.col("_b") / scale, 6).alias("isolation"))


def _counted_ancestors(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = leaf_counts(closed, nodes).withColumnRenamed("node_id", "ancestor_id")
    leaves = nodes.filter("is_leaf").select("node_id")
    return closed.filter("hops > 0").join(leaves, "node_id", "left_semi").join(counts, "ancestor_id")


def context_root(closed: DataFrame, nodes: DataFrame, minimum: int = 8, maximum: int = 30) -> DataFrame:
    """Smallest surrounding clade with at least ``minimum`` leaves, not above ``maximum``."""
    up = _counted_ancestors(closed, nodes)
    n = F.col("leaf_count")
    picked = up.groupBy("node_id").agg(
        F.min_by("ancestor_id", F.when((n >= minimum) & (n <= maximum), F.col("hops"))).alias("_enough"),
        F.max_by("ancestor_id", F.when(n <= maximum, F.col("hops"))).alias("_widest"),
        F.min_by("ancestor_id", "hops").alias("_parent"),
        F.min_by("leaf_count", "hops").alias("_parent_count"),
    )
    root = F.when(F.col("_parent_count") > maximum, F.col("_parent")).otherwise(F.coalesce("_enough", "_widest", "_parent"))
    return picked.select("node_id", root.alias("context_root"))


def local_clades(closed: DataFrame, nodes: DataFrame, maximum: int = 30) -> DataFrame:
    """Clade shared by overlapping contexts: highest ancestor within ``maximum`` leaves.

    Leaf counts only grow toward the root, so merging contexts until nothing
    changes ends at that ancestor (or at the parent when it is already larger).
    """
    up = _counted_ancestors(closed, nodes)
    picked = up.groupBy("node_id").agg(
        F.max_by("ancestor_id", F.when(F.col("leaf_count") <= maximum, F.col("hops"))).alias("_top"),
        F.min_by("ancestor_id", "hops").alias("_parent"),
    )
    return picked.select("node_id", F.coalesce("_top", "_parent").alias("clade"))


def nearest_marked(queries: DataFrame, marks: DataFrame, closed: DataFrame, group: str, exclude_self: bool = False) -> DataFrame:
    """Tree distance from each (group, leaf) to the nearest marked leaf of its group.

    For every ancestor the closest mark below it is aggregated once; a query
    then looks at its own ancestors only.  No pair of leaves is ever formed.
    """
    up = closed.select(F.col("node_id").alias("leaf"), F.col("ancestor_id").alias("v"), "dist")
    marked = marks.select(group, "leaf").distinct().join(up, "leaf")
    near = marked.groupBy(group, "v").agg(F.min(F.struct("dist", "leaf")).alias("m"))
    second = (
        marked.join(near.select(group, "v", F.col("m.leaf").alias("_first")), [group, "v"])
        .filter(F.col("leaf") != F.col("_first"))
        .groupBy(group, "v")
        .agg(F.min("dist").alias("second"))
    ) if exclude_self else None
    best = near.join(second, [group, "v"], "left") if exclude_self else near
    best = best.withColumnRenamed("leaf", "mark")
    reach = queries.select(group, "leaf").distinct().join(up, "leaf").join(best, [group, "v"])
    to_mark = F.col("m.dist")
    if exclude_self:
        to_mark = F.when(F.col("m.leaf") == F.col("leaf"), F.col("second")).otherwise(to_mark)
    return reach.groupBy(group, "leaf").agg(F.min(F.col("dist") + to_mark).alias("distance"))


def clade_members(targets: DataFrame, forced: DataFrame, closed: DataFrame, nodes: DataFrame, maximum: int = 30) -> DataFrame:
    """Leaves shown with each clade: targets and forced leaves, then the nearest others.

    ``targets`` is (clade, leaf).  Others fill up to ``maximum`` by distance to a
    target and name.
    """
    from pyspark.sql import Window

    clades = targets.select("clade").distinct()
    leaves = nodes.filter("is_leaf").select("node_id")
    below = (
        closed.join(leaves, "node_id", "left_semi")
        .join(clades, closed.ancestor_id == clades.clade)
        .select("clade", F.col("node_id").alias("leaf"))
    )
    near = nearest_marked(below, targets, closed, "clade")
    role = (
        targets.select("clade", "leaf", F.lit(0).alias("_class"))
        .unionByName(forced.select("clade", "leaf", F.lit(1).alias("_class")))
        .groupBy("clade", "leaf")
        .agg(F.min("_class").alias("_class"))
    )
    ranked = near.join(role, ["clade", "leaf"], "left").withColumn("_class", F.coalesce("_class", F.lit(2)))
    kept = ranked.groupBy("clade").agg(F.count_if(F.col("_class") < 2).alias("_fixed"))
    others = ranked.filter("_class = 2").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("clade").orderBy("distance", "leaf"))
    )
    filled = others.filter(F.col("_rank") <= maximum).join(kept, "clade").filter(F.col("_rank") + F.col("_fixed") <= maximum)
    cols = ["clade", "leaf", F.round("distance", 6).alias("distance"), (F.col("_class") < 2).alias("fixed")]
    return ranked.filter("_class < 2").select(*cols).unionByName(filled.select(*cols))


def induced_subtree(nodes: DataFrame, closed: DataFrame, keep: DataFrame) -> DataFrame:
    """Tree restricted to ``keep`` leaves; inner nodes left with one child are spliced out."""
    kept_leaves = keep.select("node_id").distinct()
    up = closed.join(kept_leaves, "node_id", "left_semi")
    alive = up.select(F.col("ancestor_id").alias("node_id")).distinct()
    children = (
        nodes.filter(F.col("parent_id").isNotNull())
        .join(alive, "node_id", "left_semi")
        .groupBy(F.col("parent_id").alias("node_id"))
        .agg(F.count(F.lit(1)).alias("_kids"))
    )
    solid = children.filter("_kids > 1").select("node_id").unionByName(kept_leaves).distinct()
    paths = closed.join(solid, "node_id", "left_semi").filter("hops > 0")
    above = paths.join(solid.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left_semi")
    nearest = above.groupBy("node_id").agg(F.min_by("ancestor_id", "hops").alias("parent_id"), F.min_by("dist", "hops").alias("branch_length"))
    return solid.join(nearest, "node_id", "left").join(kept_leaves.withColumn("is_leaf", F.lit(True)), "node_id", "left").select(
        "node_id", "parent_id", F.round(F.coalesce("branch_length", F.lit(0.0)), 6).alias("branch_length"), F.coalesce("is_leaf", F.lit(False)).alias("is_leaf")
    )
