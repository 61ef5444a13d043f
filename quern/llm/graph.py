"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long); root is the least node of its component.

    Alternating large-star and small-star rounds: every round links the
    neighbours of a node to the least of them, so depth falls geometrically
    and a hub's edges are only ever rewritten, never multiplied.  It ends when
    all edges are stars.  Least nodes are reduced before they are shuffled; each
    step is written to the shared folder, so that the joins with them read plain
    exchanges, which adaptive execution can split where a node is a hub, and
    deleted after its round.  Null or empty input gives no rows.
    """
    now = saved(edges.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    while True:
        both = now.selectExpr("a", "b", "1 leaf").unionByName(now.selectExpr("b a", "a b", "0 leaf"))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("degree"), F.sum("leaf").alias("centres")), "lows")
        # stars: each leaf has one centre and is none itself
        mixed = not low.where((F.col("centres") > 1) | (F.col("centres") > 0) & (F.col("centres") < F.col("degree"))).isEmpty()
        if mixed:
            large = saved(both.where("b > a").join(low.select("a", "low"), "a").selectExpr("b a", "low b"), "large")
            down = saved(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
            small = large.join(down, "a").where("b != low").selectExpr("b a", "low b").unionByName(down.selectExpr("a", "low b"))
            before, now = now, saved(small.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
            discard(before, large, down)
        discard(low)
        if not mixed:
            break
    return now.selectExpr("a node", "b root").unionByName(now.selectExpr("b node", "b root").distinct())
