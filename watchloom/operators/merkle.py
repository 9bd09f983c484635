"""Resynchronisation of tables by checksum trees: only what differs is found, named as ranges and sent.

A row's place is the SHA-1 of its key; a tree's leaf is a range of places with a common prefix, and its nodes are the shorter prefixes. A node's checksum is
made from its children's, a leaf's from its rows' in the order of their places. Trees are built level by level, with a
bounded number of entries in each group, and written by level. The comparison goes down from the roots: of each level it reads
only the children of nodes that differ, on both sides. It ends with the leaves that differ: ranges that one side must send, and ranges that the other must clear.

Defined results: null keys and checksums are values like any other; repeated rows count, and a leaf with more copies of a row differs. A table (by) that only one side
has differs at its root, and all its ranges are sent or cleared. Empty tables have no nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import stored

#: Hex digits that a level adds: 256 children.
DIGITS = 2
#: Levels below the root at most: 2 ** 40 leaves.
DEEPEST = 5


@dataclass
class Tree:
    """levels[k]: by, node (a prefix of k * DIGITS digits), sum, n. rows: by, leaf, place and the columns of the table."""

    by: list[str]
    levels: list[DataFrame]
    rows: DataFrame


def place(*keys: str) -> Column:
    """The SHA-1 of a row's key."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.sha1(F.concat_ws("|", *parts))


def depth_for(rows: int, leaf_rows: int) -> int:
    """Levels below the root with which leaves of a table of so many rows have at most leaf_rows on the average."""
    depth = 0
    while rows > leaf_rows and depth < DEEPEST:
        rows, depth = rows / 16**DIGITS, depth + 1
    return depth


def build(rows: DataFrame, by: list[str], keys: list[str], checksum: str = "checksum", depth: int = 2) -> Tree:
    """The tree of each table in by. Both sides of a comparison must be built with one depth, as depth_for gives it for the larger one."""
    placed = rows.withColumn("place", place(*keys)).withColumn("leaf", F.substring("place", 1, DIGITS * depth))
    item = F.concat_ws(":", F.coalesce(F.col(checksum).cast("string"), F.lit("-")), F.col("k").cast("string"))
    each = placed.groupBy(*by, "leaf", "place", checksum).agg(F.count(F.lit(1)).alias("k"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))), lambda x: F.concat_ws("=", x["place"], x["item"]))
    level = each.groupBy(*by, F.col("leaf").alias("node")).agg(F.sha1(F.array_join(ordered, ",")).alias("sum"), F.sum("k").alias("n"))
    levels = [stored(level, f"tree-{depth}")]
    for k in range(depth - 1, -1, -1):
        children = F.array_join(F.sort_array(F.collect_list(F.concat("node", "sum"))), "")
        upper = levels[0].groupBy(*by, F.substring("node", 1, DIGITS * k).alias("node")).agg(F.sha1(children).alias("sum"), F.sum("n").alias("n"))
        levels.insert(0, stored(upper, f"tree-{k}"))
    return Tree(by, levels, placed)


def descend(mine: Tree, theirs: Tree) -> DataFrame:
    """by, leaf, mine, theirs (rows on each side, 0 if it has none) of the leaves that differ."""
    by, differ = mine.by, None
    for k, (a, b) in enumerate(zip(mine.levels, theirs.levels, strict=True)):
        if differ is not None:  # children of nodes that differ, of both sides
            parent = F.substring("node", 1, DIGITS * (k - 1))
            a, b = (x.withColumn("parent", parent).join(differ, _same(by, ("parent",), "up_"), "left_semi").drop("parent") for x in (a, b))
        left = a.select(*by, "node", F.col("sum").alias("a_sum"), F.col("n").alias("mine"))
        right = b.select(*(F.col(c).alias(f"b_{c}") for c in (*by, "node")), F.col("sum").alias("b_sum"), F.col("n").alias("theirs"))
        both = left.join(right, _same(by, ("node",), "b_"), "full_outer").filter(~F.col("a_sum").eqNullSafe(F.col("b_sum")))
        here = F.col("a_sum").isNotNull()
        named = [F.when(here, F.col(c)).otherwise(F.col(f"b_{c}")).alias(c) for c in (*by, "node")]
        found = stored(both.select(*named, F.coalesce("mine", F.lit(0)).alias("mine"), F.coalesce("theirs", F.lit(0)).alias("theirs")), "tree-differs")
        differ = found.select(*(F.col(c).alias(f"up_{c}") for c in by), F.col("node").alias("up_parent"))
    return found.withColumnRenamed("node", "leaf")


def _same(by: list[str], more: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in (*by, *more)]


def ranges(differ: DataFrame) -> DataFrame:
    """by, leaf, first, last (places, inclusive), action: send for a leaf that mine has, clear for one that only they have."""
    edge = lambda digit: F.rpad("leaf", 40, digit)
    return differ.withColumns({"first": edge("0"), "last": edge("f"), "action": F.when(F.col("mine") > 0, "send").otherwise("clear")})


def to_send(mine: Tree, differ: DataFrame) -> DataFrame:
    """The rows of mine in the leaves that differ, with all their columns: what replaces the other side's rows there."""
    wanted = differ.filter("mine > 0").select(*(F.col(c).alias(f"to_{c}") for c in (*mine.by, "leaf")))
    return mine.rows.join(wanted, _same(mine.by, ("leaf",), "to_"), "left_semi").drop("leaf", "place")


def resync(mine: DataFrame, theirs: DataFrame, by: list[str], keys: list[str], checksum: str = "checksum", leaf_rows: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows of mine to send, ranges to send and to clear) that make theirs equal to mine.

    A changed row costs its leaf: on the average at most leaf_rows rows are sent for each row that differs.
    """
    depth = depth_for(max(mine.count(), theirs.count()), leaf_rows)
    a, b = build(mine, by, keys, checksum, depth), build(theirs, by, keys, checksum, depth)
    differ = descend(a, b)
    return to_send(a, differ), ranges(differ)


def applied(theirs: DataFrame, sent: DataFrame, spans: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """The other side's table after its ranges are cleared and the sent rows are in."""
    cut = spans.select(*(F.col(c).alias(f"to_{c}") for c in by), "leaf")
    if cut.isEmpty():
        return theirs
    width = cut.select(F.length("leaf")).first()[0]
    placed = theirs.withColumn("__leaf", F.substring(place(*keys), 1, width))
    kept = placed.join(cut, [*_same(by, (), "to_"), F.col("__leaf") == F.col("leaf")], "left_anti").drop("__leaf")
    return kept.unionByName(sent)
