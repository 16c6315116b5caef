"""Connected components by least labels and pointer jumping, for graphs of any size."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.session import discard, written


#: Tasks that the edges of one node are spread over.
SALTS = 4


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each node's component.

    *edges* need not be symmetric; loops are allowed and keep lone nodes. Each round halves the depth of
    the label trees by pointer jumping; hot nodes cost one aggregation each, never a collected group, and
    the labels of a hot node are repeated over SALTS tasks. The state of a round is written to the shared folder, that
    of the round before removed.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), "c"), "labels")
    salted = both.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    while True:
        # The least label among the neighbours, then the label of that label.
        spread = label.select(F.col("node").alias("b"), "c", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        near = salted.join(spread, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("near", "c")).alias("c"))
        jump = step.join(label.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("c"))
        new = written(jump, "labels")
        if new.filter("old <> c").limit(1).count() == 0:
            return new.select("node", F.col("c").alias("component"))
        discard(label)
        label = new.select("node", "c")


def linked_by_keys(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(node, component): nodes joined by any equal non-empty key, through (node, key) edges; no pair of nodes is ever made."""
    rows = rows.withColumn("_node", F.concat(F.lit("0"), F.col(node)))
    edges = rows.select(F.col("_node").alias("a"), F.col("_node").alias("b"))
    for n, k in enumerate(keys):
        edges = edges.unionByName(rows.filter(F.coalesce(F.col(k), F.lit("")) != "").select(F.col("_node").alias("a"), F.concat(F.lit(f"{n + 1}"), F.col(k)).alias("b")))
    out = components(edges)
    return out.filter(F.col("node").startswith("0")).select(F.substr(F.col("node"), F.lit(2)).alias(node), F.substr(F.col("component"), F.lit(2)).alias("component"))


def linked_within(rows: DataFrame, group: str, node: str, keys: list[str]) -> DataFrame:
    """(group, node, component): like linked_by_keys, but keys of one *group* only link nodes of that group."""
    inside = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.col(group), F.lit("\x00"), F.col(c)))
    named = rows.select(group, node, inside(node).alias("_id"), *[inside(k).alias(f"_k{n}") for n, k in enumerate(keys)])
    found = linked_by_keys(named.select("_id", *[f"_k{n}" for n in range(len(keys))]), "_id", [f"_k{n}" for n in range(len(keys))])
    return named.select(group, node, "_id").distinct().join(found, "_id").drop("_id")
