"""Index of a forest: places of entering and leaving each node on a walk around it, so that "below" is a range of numbers.

The walk is a linked list of two events a node; each event's distance to the end, and sums over what lies between, come
from pointer doubling: every round an event takes over what the event it points to knows, and points as far as that one.
So a chain of n nodes takes log n rounds of 2n rows, as any other forest does.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.lineage import Written, release
from strophe.operators.numbering import number

ENTER, EXIT = 0, 1


def index(nodes: DataFrame, marks: Mapping[str, Column] | None = None) -> DataFrame:
    """id, enter, exit, depth of every node (id, parent_id; ids are unique), and for each mark how many nodes at and below it have it.

    enter and exit number the 2n events from 0; children follow in the order of their ids, and so do roots. A node is
    below another if its enter lies between the other's enter and exit. A parent that is no node makes a root; null ids
    take no part; a cycle of parents raises.
    """
    marks = dict(marks or {})
    flags = {name: F.coalesce(condition, F.lit(False)).cast("long").alias(f"m_{name}") for name, condition in marks.items()}
    own = nodes.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent"), *flags.values())
    known = own.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    placed = own.join(known, "parent", "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")
    placed = Written(number(placed, ["id"], "k", keys=["parent"], start=0), "forest")
    base = placed.df
    after = base.select(F.col("parent").alias("p"), (F.col("k") - 1).alias("kk"), F.col("id").alias("sibling"))
    first = base.filter("k = 0 and parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    linked = base.join(after, F.col("parent").eqNullSafe(F.col("p")) & (F.col("k") == F.col("kk")), "left").join(first, "id", "left")

    def event(node: Column, side: Column | int) -> Column:
        """An event's key: twice the node, and one more to leave it."""
        return node * 2 + side

    sums = ["d", "depth", *[f"m_{n}" for n in marks]]
    enters = linked.select(event(F.col("id"), F.lit(ENTER)).alias("e"), F.coalesce(event(F.col("child"), F.lit(ENTER)), event(F.col("id"), F.lit(EXIT))).alias("to"), F.lit(1).cast("long").alias("d"), F.lit(1).cast("long").alias("depth"), *[f"m_{n}" for n in marks])
    exits = linked.select(event(F.col("id"), F.lit(EXIT)).alias("e"), F.coalesce(event(F.col("sibling"), F.lit(ENTER)), event(F.col("parent"), F.lit(EXIT))).alias("to"), F.lit(1).cast("long").alias("d"), F.lit(-1).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f"m_{n}") for n in marks])
    held = Written(enters.unionByName(exits), "walk")
    n, reach = held.df.count(), 1
    while not held.df.filter("to is not null").isEmpty():
        if reach > n:
            raise ValueError("the parents form a cycle")
        there = held.df.select(F.col("e").alias("at"), F.col("to").alias("next"), *[F.col(s).alias(f"{s}_2") for s in sums])
        more = held.df.join(there, F.col("to") == F.col("at"), "left").select("e", F.col("next").alias("to"), *[(F.col(s) + F.coalesce(f"{s}_2", F.lit(0))).alias(s) for s in sums])
        further = Written(more, "walk")
        held.drop()
        release(nodes.sparkSession)
        held, reach = further, 2 * reach
    # all sums run to the end of the walk; over the whole walk the depths cancel out
    ends = held.df.select(F.shiftright("e", 1).alias("id"), (F.col("e").bitwiseAND(F.lit(1)) != ENTER).alias("leaves"), (F.lit(n) - F.col("d")).alias("at"), *sums[1:])
    a = ends.filter("not leaves").select("id", F.col("at").alias("enter"), (-F.col("depth")).alias("depth"), *[F.col(f"m_{m}").alias(f"a_{m}") for m in marks])
    b = ends.filter("leaves").select("id", F.col("at").alias("exit"), *[F.col(f"m_{m}").alias(f"b_{m}") for m in marks])
    return a.join(b, "id").select("id", "enter", "exit", "depth", *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in marks])


def below(pairs: DataFrame, indexed: DataFrame, node: str, ancestor: str) -> DataFrame:
    """The pairs with `is_below`: whether the node lies below the ancestor or is it; false where one of them is no node."""
    a = indexed.select(F.col("id").alias(ancestor), F.col("enter").alias("_lo"), F.col("exit").alias("_hi"))
    b = indexed.select(F.col("id").alias(node), F.col("enter").alias("_at"))
    met = pairs.join(a, ancestor, "left").join(b, node, "left")
    return met.select(*pairs.columns, F.coalesce(F.col("_at").between(F.col("_lo"), F.col("_hi")), F.lit(False)).alias("is_below"))
