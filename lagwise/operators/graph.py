"""A10 connected components, and attaching a group's aggregate to its rows when one group may be huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.plans.scratch import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``(node, component)`` for every endpoint of ``edges``; component = smallest node reachable.

    Alternating large-star and small-star rounds: each is one aggregation and one equi join, edges
    never outgrow the input, and O(log^2 n) rounds suffice whatever the diameter; they end as soon as
    every component is a star, which one aggregation tells and names. A hub's rows meet
    only in joins that adaptive execution can split. Null endpoints and self loops carry no edge; an
    endpoint that has only self loops is its own component. Repeated edges count once. No edges, no rows.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    clean = materialize(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    current = clean.where("u <> v")
    while True:
        # done when every component is a star: no node has two roots or is a root and a leaf at once
        ends = current.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))).alias("e"))
        named = materialize(ends.groupBy("e.node").agg(F.min("e.v").alias("component"), F.max("e.v").alias("other")), "named")
        if named.where("component <> other").isEmpty():
            break
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "star")
    alone = clean.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return named.select("node", "component").unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def attach_group(df: DataFrame, keys: Sequence[str], spread: Column, first: dict[str, Column], then: dict[str, Column], salts: int = 32) -> DataFrame:
    """Join each row with its group's aggregate, no task holding a whole group.

    ``first`` aggregates within (keys, salt), ``then`` merges those results by key; each has the same
    output names. The merged row goes back once for each salt that the group really has (at most
    ``salts``), so a group of a third of all rows is joined in ``salts`` tasks and a small one in few.
    Rows with a null key get no match and are dropped. Salts derive from ``spread``, so reruns agree.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[c.alias(k) for k, c in first.items()])
    whole = part.groupBy(*keys).agg(*[c.alias(k) for k, c in then.items()], F.collect_list("_salt").alias("_salts"))
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(back, [*keys, "_salt"]).drop("_salt")
