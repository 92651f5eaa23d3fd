"""A Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups, and each row's proof.

Ranks of a tree's rows are written in digits to base 8. A block holds the rows that agree in all but their last digits.
Within a block the digits are grouped away one after another, the last first: nodes become an array in the struct of their
parent, until the block is one struct with all its nodes and leaves nested in it. Blocks are sorted out by one shuffle, so
none of these groupings moves a row. A tree's blocks are the leaves of another roll-up, and so on up to one block. Proofs
come down the same way: a block's struct is put beside the siblings above it, walked through by ``transform``, and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes under one parent, and digits of a rank that a block rolls up: a block holds at most FAN ** HEIGHT nodes.
FAN, HEIGHT = 8, 4
#: Rows of a table of starting places that may be broadcast.
SMALL = 1 << 16
SIBLINGS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """A value as text after its number of bytes; a null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(encoded, values)))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with their ``rank`` from 0 in each ``tree``, nulls first, and the tree's number of rows ``n``.

    Rows are sorted into ranges, so no tree is gathered; only the number of rows of each range and tree is summed up.
    """
    at = rows.repartitionByRange(F.col(tree).asc_nulls_first(), *order).sortWithinPartitions(F.col(tree).asc_nulls_first(), *order)
    at = written(at.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    starts = at.groupBy(part.alias("__part"), F.col(tree).alias("__tree")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(starts.select("__part", "__tree", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy("__tree")).alias("n")), "starts")
    starts = F.broadcast(starts) if starts.count() <= SMALL else starts
    both = (part == F.col("__part")) & F.col(tree).eqNullSafe(F.col("__tree"))
    return at.join(starts, both).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__tree", "__shift")


def depth(n: Column) -> Column:
    """How often ``n`` nodes become their parents until one remains."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(21)), F.lit(0))


def blocks(nodes: DataFrame, done: int) -> DataFrame:
    """(tree, depth, block, node): each block of ``nodes`` (tree, depth, rank, hash, item) as one nested struct.

    ``done`` levels lie below the nodes; a level from a tree's depth up passes its only node on.
    """
    digits = [F.expr(f"rank div {FAN**k} % {FAN}").alias(f"d{k}") for k in range(HEIGHT)]
    rows = nodes.select("tree", "depth", F.expr(f"rank div {FAN**HEIGHT}").alias("block"), *digits, F.struct("hash", "item").alias("node"))
    rows = rows.repartition("tree", "block")
    for k in range(HEIGHT):
        keys = ["tree", "depth", "block", *[f"d{j}" for j in range(k + 1, HEIGHT)]]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(f"d{k}", "node"))).alias("run"))
        nodes_ = F.transform("run", lambda x: x.node)
        joined = F.array_join(F.transform("run", lambda x: x.node.hash), "")
        up = F.when(F.col("depth") > done + k, digest(joined)).otherwise(F.get("run", F.lit(0)).node.hash)
        rows = rows.select(*keys, F.struct(up.alias("hash"), nodes_.alias("item")).alias("node"))
    return rows


def rolled_up(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of ``nodes``, the blocks of these, and so on until every tree is one block."""
    tiers = []
    while True:
        tiers.append(written(blocks(nodes, HEIGHT * len(tiers)), "blocks"))
        if not tiers[-1].where("block > 0").limit(1).count():
            return tiers
        nodes = tiers[-1].select("tree", "depth", F.col("block").alias("rank"), F.col("node.hash").alias("hash"), F.lit(None).cast("boolean").alias("item"))


def siblings(nodes: Column, i: Column) -> Column:
    told = lambda part: F.array_join(F.transform(part, lambda x: x.hash), "")
    return F.struct(told(F.slice(nodes, F.lit(1), i)).alias("left"), told(F.slice(nodes, i + 2, F.lit(FAN))).alias("right"))


def explored(tier: DataFrame, above: DataFrame, done: int, told) -> DataFrame:
    """(tree, row): ``told(node, rank, levels, known)`` of each node of the blocks, exploded.

    ``above`` has, for each block, the siblings above it and ``known``, which is passed on. Blocks and what is above them
    meet in one group each; no table is joined.
    """
    none, kinds = F.lit(None), {f.name: f.dataType for f in above.schema.fields}
    down = above.select("tree", "block", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(tier.schema["node"].dataType).alias("node"), F.struct("above", "known").alias("upper"))
    up = tier.select("tree", "block", "depth", "node", none.cast(down.schema["upper"].dataType).alias("upper"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    met = up.unionByName(down).groupBy("tree", "block").agg(first("depth"), first("node"), first("upper"))
    assert kinds["above"].simpleString() == SIBLINGS, kinds["above"]

    def walk(nodes: Column, k: int, levels: list[Column], rank: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            here = [F.when(F.col("depth") > done + k, siblings(nodes, i)), *levels]
            at = rank * FAN + i
            if k:
                return walk(x.item, k - 1, here, at)
            return told(x, at, F.concat(F.array_compact(F.array(*here)), F.col("upper.above")), F.col("upper.known"))

        found = F.transform(nodes, each)
        return F.flatten(found) if k else found

    return met.select("tree", F.explode(walk(F.col("node.item"), HEIGHT - 1, [], F.col("block"))).alias("row"))


def placed(tiers: list[DataFrame], above: DataFrame, told) -> DataFrame:
    """``told`` of every leaf; ``above``: (tree, above, known) of each tree."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(1, len(tiers))):
        below = explored(tiers[k], above, HEIGHT * k, lambda node, rank, levels, known: F.struct(rank.alias("block"), levels.alias("above"), known.alias("known")))
        above = below.select("tree", "row.*")
    return explored(tiers[0], above, 0, told)


def fold(start: Column, levels: Column) -> Column:
    return F.aggregate(levels, start, lambda h, x: digest(F.concat(x.left, h, x.right)))


def manifest(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) for each of ``leaves`` (tree, id, leaf, altered).

    ``subroot`` is the root of the row's tree, whose leaves go by id, and ``root`` that of the tree over the subroots, which
    go by the trees' names in the order of their bytes, a null first. ``proof`` is the digest of the row's siblings on all
    levels, and ``folded`` the root that follows from ``altered`` and these siblings. Null ids come first; rows of the same
    tree and id go by their leaf, and repeated rows, whose leaves are equal, are leaves each. One row is a tree without a
    level, and an empty table gives an empty table.
    """
    leaves = written(leaves.select("tree", "id", "leaf", "altered", F.monotonically_increasing_id().alias("row")), "leaves")
    ranked = numbered(leaves, "tree", "id", "leaf", "row")
    tiers = rolled_up(ranked.select("tree", depth(F.col("n")).alias("depth"), "rank", F.col("leaf").alias("hash"), F.struct("id", "altered").alias("item")))
    trees = tiers[-1].select(F.col("tree").alias("name"), F.col("node.hash").alias("hash"), F.lit(0).alias("tree"))
    over = numbered(trees, "tree", "name")
    upper = rolled_up(over.select("tree", depth(F.col("n")).alias("depth"), "rank", "hash", F.struct("name").alias("item")))
    top = upper[-1].select("tree", F.array().cast(SIBLINGS).alias("above"), F.col("node.hash").alias("known"))
    of_trees = placed(upper, top, lambda node, rank, levels, root: F.struct(node.item["name"].alias("tree"), levels.alias("above"), F.struct(node.hash.alias("subroot"), root.alias("root")).alias("known")))
    told = lambda node, rank, levels, known: F.struct(
        node.item["id"].alias("id"), node.hash.alias("leaf"), known.subroot.alias("subroot"), known.root.alias("root"),
        digest(F.array_join(F.transform(levels, lambda x: F.concat(x.left, x.right)), "")).alias("proof"), fold(node.item.altered, levels).alias("folded"),
    )
    return placed(tiers, of_trees.select("row.*"), told).select("row.*")
