"""Connected components of links, as DataFrames all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """links(a, b): two nodes of one component. Returns (a, b) with b the smallest node that a reaches, for every a that isn't it.

    Alternates the small-star and large-star steps (Kiveris et al., 2014): every round is two groupings and two joins
    whose rows never outnumber the links, and the number of rounds grows with the logarithm of a component's size.
    Each node's smallest neighbour is written before the join, so that both sides are plain shuffles and adaptive
    execution can split a hub. Self links and nulls are left out.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _signature(now)
    while sign[0]:
        # small star: a's smaller neighbours, and a, go to the smallest of them
        n = sign[0]
        low = written(now.groupBy("a").agg(F.min("b").alias("m")), n)
        met = now.join(low, "a")
        small = written(low.select("a", F.col("m").alias("b")).union(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), n)
        # large star: a node's larger neighbours go to the smallest of all its neighbours and itself
        both = small.union(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * n)
        then = written(both.join(best, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)
        after = _signature(then)
        dropped(low, small, best, now)
        now = then
        if after == sign:
            break
        sign = after
    return now
