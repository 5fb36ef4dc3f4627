"""Parent-child links of unknown depth: roots, depths, paths and descendants by pointer doubling.

Each round joins every node's pointer with the pointer of the node it points at and puts their path segments
together, so that jumps double in length and a forest of depth d is resolved in about log2(d) rounds over one row a
node. Ancestors are unfolded from the paths at the end, once. Nodes that are still open when a round resolves nothing
new have several parents above them or run in circles; only those go through the doubling of whole pair sets.

Defined results for odd input: rows with a null or empty node are no nodes; links to a parent that isn't a
node are ignored; repeated links count once; a node with several parents reaches the ancestors of all of them
(the closure) while its path follows the smallest parent; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize


def clean_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (node, parent) between existing nodes. nodes: column node; links: columns node, parent."""
    known = nodes.select("node").where(F.col("node").isNotNull()).distinct()
    return (
        links.select("node", "parent")
        .where(F.col("node").isNotNull() & F.col("parent").isNotNull())
        .distinct()
        .join(known.withColumnRenamed("node", "parent"), "parent", "left_semi")
        .join(known, "node", "left_semi")
        .select("node", "parent")
    )


@dataclass
class Climbed:
    """What pointer doubling resolved: done has (node, parent, above), above being the ancestors, nearest first; open is (node, pointer, above)."""

    done: DataFrame
    open: DataFrame | None


def _double(done: DataFrame, open_: DataFrame) -> Climbed:
    """Rounds over (node, parent, pointer, above) until none is open or a round resolves nothing. On a tree the nodes of
    the next power of two are resolved in every round."""
    left = open_.count()
    while left:
        resolved = done.select(F.col("node").alias("pointer"), F.lit(None).cast("string").alias("__next"), F.col("above").alias("__more"), F.lit(True).alias("__done"))
        on = open_.select(F.col("node").alias("pointer"), F.col("pointer").alias("__next"), F.col("above").alias("__more"), F.lit(False).alias("__done"))
        walked = materialize(open_.join(resolved.unionByName(on), "pointer").select("node", "parent", F.col("__next").alias("pointer"), F.concat("above", "__more").alias("above"), F.col("__done").alias("done")), "walk")
        done = done.unionByName(walked.where("done").select("node", "parent", "above"))
        open_ = walked.where("not done").select("node", "parent", "pointer", "above")
        before, left = left, open_.count()
        if left == before:
            return Climbed(done, open_.select("node", "pointer", "above"))
    return Climbed(done, None)


def climb(nodes: DataFrame, links: DataFrame) -> Climbed:
    """The ancestors of all nodes that have one parent at most, and so have all above them. links must come from clean_links."""
    one = links.groupBy("node").agg(F.min("parent").alias("parent"), F.max("parent").alias("__other"))
    start = nodes.select("node").where(F.col("node").isNotNull()).distinct().join(one, "node", "left")
    several = F.col("parent") != F.col("__other")
    # a node of several parents points at itself and stays open, as does all below it
    pointer = F.when(several, F.col("node")).otherwise(F.col("parent"))
    above = F.when(F.col("parent").isNull() | several, F.array().cast("array<string>")).otherwise(F.array("parent"))
    start = materialize(start.select("node", "parent", pointer.alias("pointer"), above.alias("above")), "climb")
    return _double(start.where(F.col("parent").isNull()).select("node", "parent", "above"), start.where(F.col("parent").isNotNull()))


def _closure(links: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of any graph by doubling the set of pairs; distance is the shortest.

    The work of a round is in proportion to the output; a hot ancestor only meets its own few jumps.
    """
    jumps = materialize(links.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "jumps")
    pairs, known = jumps, jumps.count()
    while known:
        # pairs within 2^k, joined with the jumps of exactly 2^k, give the pairs within 2^(k+1)
        step = jumps.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__far"), F.col("distance").alias("__more"))
        longer = pairs.join(step, "ancestor").select("node", F.col("__far").alias("ancestor"), (F.col("distance") + F.col("__more")).alias("distance"))
        grown = materialize(pairs.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "pairs")
        now = grown.count()
        if now == known:
            return grown
        jumps = materialize(
            jumps.join(step, "ancestor").select("node", F.col("__far").alias("ancestor"), (F.col("distance") + F.col("__more")).alias("distance")).distinct(),
            "jumps",
        )
        pairs, known = grown, now
    return pairs


def _around(ring: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of nodes of one parent that run in circles: doubled on until no walk meets a new node.
    A walk only meets new nodes until it is round, so a node's place among the different ones is its distance."""
    total = lambda df: df.agg(F.sum(F.size("above"))).first()[0]
    ring = ring.select("node", "pointer", F.array_distinct("above").alias("above"))
    now, before = total(ring), -1
    while now != before:
        on = ring.select(F.col("node").alias("pointer"), F.col("pointer").alias("__next"), F.col("above").alias("__more"))
        ring = materialize(ring.join(on, "pointer").select("node", F.col("__next").alias("pointer"), F.array_distinct(F.concat("above", "__more")).alias("above")), "ring")
        now, before = total(ring), now
    return ring.select("node", F.posexplode("above").alias("__at", "ancestor")).select("node", "ancestor", (F.col("__at") + 1).alias("distance"))


def ancestor_pairs(links: DataFrame, climbed: Climbed | None = None) -> DataFrame:
    """(node, ancestor, distance): every pair reached by following links one or more times; distance is the shortest.

    links must come from clean_links; climbed is climb() of them, where it is there already. A node on a circle is
    paired with itself.
    """
    c = climbed or climb(links.select("node").unionByName(links.select(F.col("parent").alias("node"))), links)
    above = c.done.select("node", F.posexplode("above").alias("__at", "ancestor")).select("node", "ancestor", (F.col("__at") + 1).alias("distance"))
    if c.open is None:
        return above
    if c.open.where(F.size("above") == 0).isEmpty():  # no node of several parents: what is open runs in circles
        return above.unionByName(_around(c.open))
    open_ = materialize(c.open.select("node"), "open")
    own = links.join(open_, "node", "left_semi")
    inner = own.join(open_.withColumnRenamed("node", "parent"), "parent", "left_semi")
    exits = own.join(open_.withColumnRenamed("node", "parent"), "parent", "left_anti")
    pairs = materialize(_closure(inner), "inner")
    # out of the open nodes into the resolved ones, and up from there
    there = pairs.unionByName(open_.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))
    out = there.join(exits.select(F.col("node").alias("ancestor"), "parent"), "ancestor").select("node", F.col("parent").alias("__exit"), "distance")
    up = c.done.select(F.col("node").alias("__exit"), F.concat(F.array("node"), "above").alias("__up"))
    far = out.join(up, "__exit").select("node", F.posexplode("__up").alias("__at", "ancestor"), "distance").select("node", "ancestor", (F.col("distance") + F.col("__at") + 1).alias("distance"))
    return above.unionByName(pairs.unionByName(far).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))


def hierarchy(nodes: DataFrame, links: DataFrame, separator: str = "/", climbed: Climbed | None = None) -> DataFrame:
    """(node, parent, root, depth, path, above, state), one row a node.

    state is 'tree', 'on_cycle' (the node reaches itself) or 'leads_to_cycle'; the last two have no root, depth
    or path. path runs from the root to the node, above is the array of the ancestors, nearest first. links must come
    from clean_links. Ties between parents go to the smallest.
    """
    c = climbed or climb(nodes, links)
    if c.open is not None:
        open_ = materialize(links.join(c.open.select("node"), "node", "left_semi").groupBy("node").agg(F.min("parent").alias("parent")), "open")
        c = _double(c.done, open_.select("node", "parent", F.col("parent").alias("pointer"), F.array("parent").alias("above")))
    up = F.size("above")
    trees = c.done.select(
        "node", "parent", F.when(up > 0, F.element_at("above", -1)).otherwise(F.col("node")).alias("root"), up.alias("depth"),
        F.array_join(F.concat(F.reverse("above"), F.array("node")), separator).alias("path"), "above", F.lit("tree").alias("state"),
    )
    if c.open is None:
        return trees
    circling = open_.join(c.open.select("node"), "node", "left_semi")
    on = _closure(circling).where(F.col("node") == F.col("ancestor")).select("node", F.lit(True).alias("__on"))
    lost = circling.join(on, "node", "left").select(
        "node", "parent", F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<string>").alias("above"),
        F.when(F.col("__on"), "on_cycle").otherwise("leads_to_cycle").alias("state"),
    )
    return trees.unionByName(lost)
