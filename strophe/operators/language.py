"""Language hierarchy: ancestors, descendants by level, the nearest supported language and the search with a carried limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.lineage import checkpoint


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, ancestor, up for each node and each of its ancestors, itself at 0, at any depth.

    Paths double in length each round, so a tree of depth n takes log n joins. A cycle of parents raises.
    """
    n = nodes.count()
    known = checkpoint(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("up")))
    ends = checkpoint(nodes.filter("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("up")))
    known, reach = checkpoint(known.unionByName(ends)), 1
    while not ends.isEmpty():
        if reach > n:
            raise ValueError("the parents form a cycle")
        # from the nodes `reach` steps up, everything that is known to be 1 to `reach` steps above them
        further = known.filter("up > 0").select(F.col("id").alias("_id"), F.col("ancestor").alias("_ancestor"), F.col("up").alias("_up"))
        more = checkpoint(ends.join(further, F.col("ancestor") == F.col("_id")).select("id", F.col("_ancestor").alias("ancestor"), (F.col("up") + F.col("_up")).alias("up")))
        reach *= 2
        known, ends = checkpoint(known.unionByName(more)), checkpoint(more.filter(F.col("up") == reach))
    return known


def nearest_supported(nodes: DataFrame, supported: str) -> DataFrame:
    """id, found, distance: the supported language with the fewest steps up and then down, ties to fewer steps up and the smaller id."""
    up = ancestors(nodes)
    good = nodes.filter(supported).select(F.col("id").alias("found"))
    # the best supported descendants of each ancestor: two ids suffice for any node
    down = up.join(good, F.col("id") == F.col("found")).groupBy("ancestor").agg(F.min(F.struct(F.col("up").alias("down"), "found")).alias("best"))
    met = up.join(down, "ancestor").select("id", "up", "best.*")
    best = F.min(F.struct((F.col("up") + F.col("down")).alias("distance"), "up", "found"))
    return met.groupBy("id").agg(best.alias("b")).select("id", "b.found", "b.distance")


def tree_search(nodes: DataFrame, supported: str, limit: int = 1_000) -> DataFrame:
    """id, found (ids, ascending), distance, for every node as the start of a search.

    The search climbs from the start. Under each ancestor it takes the first level of descendants that has supported
    ones, if it lies within the limit; then the limit is that level less one, and nothing but a nearer level counts
    further up. It ends at the root or when the limit is used up. The distance is the steps climbed in all plus the
    last level looked at under the last ancestor. A start without any result has an empty array.
    """
    up = ancestors(nodes)
    good = nodes.filter(supported).select("id")
    levels = up.groupBy("ancestor").agg(F.max("up").alias("height"))
    first = up.join(good, "id", "left_semi").groupBy("ancestor").agg(F.min("up").alias("down"))
    steps = up.join(levels, "ancestor").join(first, "ancestor", "left").withColumn("down", F.when(F.col("down") <= limit, F.col("down")))
    climbed = Window.partitionBy("id").orderBy("up")
    before = F.coalesce(F.min("down").over(climbed.rowsBetween(Window.unboundedPreceding, -1)) - 1, F.lit(limit))
    steps = steps.withColumn("limit", before).filter("limit > 0")
    hit = F.col("down") <= F.col("limit")
    looked = F.when(hit, F.col("down")).otherwise(F.least("height", "limit"))
    last = F.max_by(F.col("up") + F.col("looked"), "up").alias("distance")
    ends = steps.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("looked", F.coalesce(looked, F.least("height", "limit")))
    found = ends.groupBy("id").agg(last, F.max_by(F.when(F.col("hit"), F.struct("ancestor", "down")), F.when(F.col("hit"), F.col("up"))).alias("at"))
    under = up.join(good, "id", "left_semi").groupBy("ancestor", F.col("up").alias("down")).agg(F.sort_array(F.collect_list("id")).alias("found"))
    met = found.select("id", "distance", "at.*").join(under, ["ancestor", "down"], "left")
    return met.select("id", F.coalesce("found", F.array().cast(under.schema["found"].dataType)).alias("found"), "distance")


def choose(requests: DataFrame, searched: DataFrame) -> DataFrame:
    """The requests with `language`: their own override, else the first language that the search found for their id, else null."""
    best = searched.select("id", F.get("found", F.lit(0)).alias("_best"))
    own = F.when(F.coalesce("override", F.lit("")) != "", F.col("override"))
    return requests.join(best, "id", "left").withColumn("language", F.coalesce(own, F.col("_best").cast("string"))).drop("_best")


def tool_codes(languages: DataFrame, tool: DataFrame, column: str) -> DataFrame:
    """The languages (iso3, iso1) with `column`: the code under which the tool (iso) knows them, the three-letter one first, else ''."""
    known = tool.select(F.col("iso").alias("_iso")).distinct()
    three = known.select(F.col("_iso").alias("_three"))
    one = known.select(F.col("_iso").alias("_one"))
    out = languages.join(three, F.col("iso3") == F.col("_three"), "left").join(one, F.col("iso1") == F.col("_one"), "left")
    return out.withColumn(column, F.coalesce("_three", "_one", F.lit(""))).drop("_three", "_one")
