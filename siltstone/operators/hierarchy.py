"""Parent-child rows of unknown depth turned into full hierarchies by heavy-path decomposition.

Pointer doubling finds every node's root in a logarithmic number of joins; what still moves when a round ends no new chain
lies on, or hangs below, a cycle and is set apart. The same rounds sum subtree sizes. Each parent's child with the largest
subtree continues its parent's chain; all others start chains of their own, so a path crosses at most log2(n) chains.
Paths are concatenated chain segments, and the positions along chains number each tree so that the descendants of a node
are one interval of positions.

Defined results: a null or blank name is no node; a node with several parents keeps the smallest; copies count once; a node
that is its own parent is a cycle; nodes on or below a cycle have status 'cycle' and null root, depth, path and positions;
an empty table gives an empty result. Work tables are cut with ``checkpoint()``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.materialise import broadcast_if_small, cut

#: Unicode white space, as a regular-expression class body
WHITE = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SEPARATOR = " > "
#: siblings ranked in one task, and positions in one block of an interval
SIBLINGS, SPAN = 50_000, 4_096


def name_key(name: Column) -> Column:
    """Names are equal if they agree after trimming, collapsing white space and ignoring case; blank is null."""
    key = F.lower(F.trim(F.regexp_replace(name, f"[{WHITE}]+", " ")))
    return F.when(key != "", key)


def links(rows: DataFrame, child: Column, parent: Column) -> DataFrame:
    """One row (node, parent) per name; names seen only as a parent are included as roots."""
    pairs = rows.select(child.alias("node"), parent.alias("parent"))
    both = pairs.unionByName(pairs.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    return both.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))


def _climb(df: DataFrame, sizes: bool) -> DataFrame:
    """Pointer doubling over (node, link): top, steps and ended for each node; with ``sizes`` also its subtree size."""
    state = df.select("node", F.coalesce("link", "node").alias("top"), F.when(F.col("link").isNull(), 0).otherwise(1).alias("steps"), F.col("link").isNull().alias("ended"), F.lit(1).cast("long").alias("size"))
    state = cut(state)
    moving = state.where(~F.col("ended")).count()
    while moving:
        ahead = state.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), F.col("ended").alias("ended2"))
        going, done = state.where(~F.col("ended")), state.where("ended")
        step = going.join(ahead, "top").select("node", F.col("top2").alias("top"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("ended2").alias("ended"), "size")
        step = step.unionByName(done)
        if sizes:  # the nodes still moving are those with a 2^k-th ancestor, and it is their top
            below = going.groupBy(F.col("top").alias("node")).agg(F.sum("size").alias("more"))
            step = step.join(below, "node", "left").select("node", "top", "steps", "ended", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        state = cut(step)
        left = state.where(~F.col("ended")).count()
        if left == moving:
            break
        moving = left
    return state


def _sibling_offsets(children: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, parent, offset) of light children: 1 + size of the heavy child + sizes of the light ones before.

    Siblings are ranked in shards by hash, as many as keep ``SIBLINGS`` of the widest parent in one, so that the children of one
    parent are spread over tasks; shards of a parent add up in a window of one row each.
    """
    light = children.join(heavy.select("node", "heavy"), "node", "left").where(F.col("heavy").isNull())
    light = light.join(heavy.select(F.col("of").alias("parent"), "heavy_size"), "parent")
    widest = light.groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    light = light.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(1 + widest // SIBLINGS)))
    sums = light.groupBy("parent", "shard").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("parent").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("parent", "shard", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("parent", "shard").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    ranked = light.withColumn("up", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["parent", "shard"])
    return ranked.select("node", "parent", (1 + F.col("heavy_size") + F.col("base") + F.col("up")).alias("offset"))


def decompose(edges: DataFrame, paths: bool = True) -> DataFrame:
    """Hierarchy of (node, parent) rows, see ``links``.

    Result: node, parent, status ('tree' or 'cycle'), root, depth (root is 1), path (array from the root, with ``paths``),
    subtree_size, chain_head, first_pos and last_pos (descendants of a node are the nodes of its root with positions in
    between). Positions need no row that holds a chain; paths are as long in all as the sum of depths, so leave them out
    where trees are very deep.
    """
    edges = cut(edges)
    climbed = _climb(edges.withColumnRenamed("parent", "link"), sizes=True)
    tree = climbed.where("ended").join(edges, "node").select("node", "parent", F.col("top").alias("root"), (F.col("steps") + 1).alias("depth"), "size")
    tree = cut(tree)
    children = tree.where(F.col("parent").isNotNull())
    heavy = children.groupBy("parent").agg(F.max(F.struct("size", "node")).alias("h")).select(F.col("h.node").alias("node"), F.lit(True).alias("heavy"), F.col("h.size").alias("heavy_size"), F.col("parent").alias("of"))
    heavy = cut(heavy)
    on_chain = _climb(tree.join(heavy.select("node", "heavy"), "node", "left").select("node", F.when(F.col("heavy"), F.col("parent")).alias("link")), sizes=False)
    on_chain = cut(on_chain.select("node", F.col("top").alias("head"), F.col("steps").alias("at")))

    # every chain but a root's hangs from a node of another: its first position is that node's plus the offset
    hangs = _sibling_offsets(children, heavy).join(on_chain.select(F.col("node").alias("parent"), F.col("head").alias("above"), F.col("at").alias("above_at")), "parent")
    waiting = cut(hangs.select(F.col("node").alias("head"), F.col("parent").alias("hook"), "above", (F.col("above_at") + F.col("offset")).alias("add")))
    level = cut(tree.where(F.col("parent").isNull()).select(F.col("node").alias("head"), F.lit(None).cast("string").alias("hook"), F.lit(0).cast("long").alias("base")))
    levels = [level]
    while True:  # one round for each crossing of chains, at most log2 of the number of nodes
        up = level.select(F.col("head").alias("above"), F.col("base").alias("above_base"))
        level = cut(waiting.join(broadcast_if_small(up), "above").select("head", "hook", (F.col("above_base") + F.col("add")).alias("base")))
        if level.isEmpty():
            break
        levels.append(level)
    placed = reduce(DataFrame.unionByName, levels)
    at = on_chain.join(placed.select("head", "base"), "head").select("node", F.col("head").alias("chain_head"), (F.col("base") + F.col("at")).alias("first_pos"))
    if paths:
        at = at.join(_paths(on_chain, levels), "node")
    whole = edges.join(tree.drop("parent"), "node", "left").join(at, "node", "left")
    return whole.select(
        "node", "parent", F.when(F.col("root").isNull(), "cycle").otherwise("tree").alias("status"), "root", "depth", *(["path"] if paths else []), F.col("size").alias("subtree_size"), "chain_head",
        "first_pos", (F.col("first_pos") + F.col("size") - 1).alias("last_pos"),
    )


def _paths(on_chain: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(node, path): a chain's prefix is the path of the node it hangs from, its own part a segment of the chain."""
    segments = cut(on_chain.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("s")).select("head", F.transform("s", lambda x: x["node"]).alias("segment")))
    done, found = None, []
    for level in levels:
        heads = level.select("head", "hook").join(segments, "head")
        if done is None:
            heads = heads.withColumn("prefix", F.array().cast("array<string>"))
        else:
            heads = heads.join(done.select(F.col("node").alias("hook"), F.col("path").alias("prefix")), "hook")
        each = heads.select("prefix", "segment", F.posexplode("segment").alias("at", "node"))
        done = cut(each.select("node", F.concat("prefix", F.slice("segment", F.lit(1), F.col("at") + 1)).alias("path")))
        found.append(done)
    return reduce(DataFrame.unionByName, found)


def descendants(nodes: DataFrame) -> DataFrame:
    """(node, descendant) for all nodes below each node, read off the position intervals; as much work as result.

    Intervals are cut into blocks of ``SPAN`` positions, spread over tasks, before they are written out, so that no row or task
    holds a whole tree.
    """
    spans = nodes.where("last_pos > first_pos").select("node", "root", (F.col("first_pos") + 1).alias("low"), F.col("last_pos").alias("high"))
    blocks = spans.select("node", "root", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / SPAN), F.floor(F.col("high") / SPAN))).alias("block")).repartition("root", "block", "node")
    own = F.sequence(F.greatest("low", F.col("block") * SPAN), F.least("high", F.col("block") * SPAN + SPAN - 1))
    places = nodes.where("status = 'tree'").select("root", F.col("first_pos").alias("pos"), F.col("node").alias("descendant"))
    return blocks.select("node", "root", F.explode(own).alias("pos")).join(places, ["root", "pos"]).select("node", "descendant")


def contradicting_rows(rows: DataFrame, nodes: DataFrame, name: str, path: str, depth: str, keep: list[str]) -> DataFrame:
    """Rows (``keep``, distinct) whose chain of parents never ends, or whose stored path or depth differs from the tree."""
    facts = nodes.select(F.col("node").alias("__key"), "status", F.col("path").alias("__path"), F.col("depth").alias("__depth"))
    keyed = rows.select(*keep, name_key(F.col(name)).alias("__key"), F.col(path).alias("__stored"), F.col(depth).alias("__stored_depth"))
    joined = keyed.where(F.col("__key").isNotNull()).join(broadcast_if_small(cut(facts)), "__key")
    stored = F.transform(F.split("__stored", SEPARATOR), lambda x: F.coalesce(name_key(x), F.lit("")))
    wrong = F.col("__stored").isNotNull() & ((stored != F.col("__path")) | F.coalesce(F.col("__stored_depth") != F.col("__depth"), F.lit(True)))
    return joined.where((F.col("status") == "cycle") | wrong).select(*keep).distinct()
