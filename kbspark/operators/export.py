"""Trees as nested JSON, written in one pass over their nodes in order: no level waits for another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators import tree


def nested_json(nodes: DataFrame, fields: list[str], group: str = "doc_id", key: str = "node_id", parent: str = "parent_id", order: str = "ord") -> DataFrame:
    """(group, json): each group's roots as a JSON array; an object has ``fields`` and its ``children`` in order of ``order``, then key.

    In that order of all nodes (parents first) each object is opened, and after it as many are closed as the next node lies above; so any depth takes
    the same plan, and only the way down to each node is worked out in rounds (a logarithm of the depth). Null fields are left out, parents that aren't
    nodes count as none, and keys are unique within a group. A group without nodes has no row.
    """
    rows = nodes.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(parent).alias("p"), F.col(order).alias("o"), F.to_json(F.struct(*fields)).alias("own"))
    name = lambda c: F.when(F.col(c).isNotNull(), F.struct("g", F.col(c).alias("k")))
    above = tree.closure(rows.select(name("k").alias("n"), name("p").alias("up")), "n", "up")
    steps = rows.select(name("k").alias("ancestor"), F.struct("o", "k").alias("step"))
    places = above.join(steps, "ancestor").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "step"))), lambda x: x["step"]).alias("place"))
    placed = rows.join(places.select("node.*", "place"), ["g", "k"])
    depth, walk = F.size("place"), Window.partitionBy("g").orderBy("place")
    after = F.coalesce(F.lead(depth).over(walk), F.lit(1))
    begun = F.when(F.col("own") == "{}", F.lit("{")).otherwise(F.concat(F.expr("left(own, length(own) - 1)"), F.lit(",")))
    # after the last node all that are open close; before a sibling there's a comma
    closes = F.when(F.lead("g").over(walk).isNull(), F.repeat(F.lit("]}"), depth)).when(after <= depth, F.concat(F.repeat(F.lit("]}"), depth - after + 1), F.lit(","))).otherwise("")
    written = placed.select("g", "place", F.concat(begun, F.lit('"children":['), closes).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "")
    return written.groupBy("g").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("json")).withColumnRenamed("g", group)
