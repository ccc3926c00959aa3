"""Matching by turns: takers choose one after the other, each the first thing on its list that is still free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.session import cut_lineage, drop_table


def first_come(offers: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(taker, taken) of offers(taker, taken, rank): takers choose in ascending order, each the free thing with its least rank.

    All takers of all groups choose at once, in rounds: each asks for the best thing left on its list, the thing goes to the earliest taker that asks, and all later takers strike it from
    their lists, since nobody after that one can ever get it. When nothing is struck any more, everybody has what it asked for, and that is what choosing by turns would have given.
    A round is two aggregates with partial steps and a join; independent groups (bins, regions) cost no extra rounds.
    """
    live = cut_lineage(offers.select("taker", "taken", "rank"))
    size = live.count()
    for _ in range(max_rounds):
        wish = live.groupBy("taker").agg(F.min_by("taken", F.struct("rank", "taken")).alias("taken"))
        held = cut_lineage(wish.groupBy("taken").agg(F.min("taker").alias("by")))
        left = cut_lineage(live.join(held, "taken", "left").filter("by is null or taker <= by").drop("by"))
        drop_table(live)
        live, before, size = left, size, left.count()
        if size == before:
            drop_table(live)
            return held.select(F.col("by").alias("taker"), "taken")
        drop_table(held)
    raise RuntimeError(f"matching not settled after {max_rounds} rounds")
