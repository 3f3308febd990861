"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrame operations.

Each step is a minimum per node (combined on the map side) and a join back; steps are cut by tables in the shared folder. `components` ends
when the links no longer change: every node of a component then points at its least member. `partly` takes a few steps only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialise


def _sign(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r.n, r.h


def _step(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step on edges (u, v) with u > v; every edge of the result has u > v as well."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def components(spark: SparkSession, links: DataFrame, name: str = "links", most: int = 200) -> DataFrame:
    """(node, root) of every node in a link (a, b) but the roots; root is the least node of its component. Loops and repeated links do no harm."""
    e = materialise(spark, _edges(links), name)
    sign = _sign(e)
    for _ in range(most):
        if not sign[0]:
            break
        new = materialise(spark, _step(e), name)
        drop_table(spark, e)
        e, old = new, sign
        sign = _sign(e)
        if sign == old:
            break
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def partly(spark: SparkSession, links: DataFrame, name: str = "links", steps: int = 2) -> DataFrame:
    """(node, root) after a few steps: nodes with the same root are in one component, but a component may still have several roots."""
    e = materialise(spark, _edges(links), name)
    for _ in range(steps - 1):
        new = materialise(spark, _step(e), name)
        drop_table(spark, e)
        e = new
    out = materialise(spark, _step(e).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), name)
    drop_table(spark, e)
    return out
