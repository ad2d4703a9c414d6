"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listing_lake.session import materialize, narrow, release


def _smallest(arcs: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours, from arcs (`at`, `to`)."""
    return arcs.groupBy("at").agg(F.min("to").alias("low")).select("at", F.least("at", "low").alias("low"))


def connected_components(links: DataFrame) -> DataFrame:
    """(`node`, `component`) for every node of `links` (`a`, `b`), the component being its smallest node.

    Large-star and small-star steps in turn: minima are aggregated per node and joined back, so no neighbourhood is ever gathered in
    one place. Each round is written to the shared folder, in tasks by the number of links, and the round before it deleted. Nulls and
    loops are left out. The links are read twice, so they should be a written step.
    """
    total = links.count()
    step = lambda arcs: materialize(narrow(arcs.distinct(), total), "links")
    links = step(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        both = links.select(F.col("a").alias("at"), F.col("b").alias("to")).unionByName(
            links.select(F.col("b").alias("at"), F.col("a").alias("to")))
        large = both.join(_smallest(both), "at").where(F.col("to") > F.col("at")).select(F.col("to").alias("a"), F.col("low").alias("b"))
        down = step(large.where("a <> b").select(F.greatest("a", "b").alias("at"), F.least("a", "b").alias("to")))
        small = down.join(_smallest(down), "at")
        small = small.select(F.col("to").alias("a"), F.col("low").alias("b")).unionByName(small.select(F.col("at").alias("a"), F.col("low").alias("b")))
        new = step(small.where("a <> b"))
        release(links, down)
        # Stars everywhere: no node points to one that itself points on, and none points to two.
        roles = new.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("met")).unionByName(
            new.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("met")))
        unsettled = roles.groupBy("node").agg(F.sum("points").alias("points"), F.max("met").alias("met")).where("points + met > 1 and points > 0")
        if not unsettled.agg(F.count("*")).first()[0]:
            break
        links = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
