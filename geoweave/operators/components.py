"""Connected components by alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions.geo import explode_ring
from geoweave.session import cut_lineage, drop_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(node, component) with the smallest node of each component as its label.

    `edges(a, b)` are undirected; `nodes(node)` adds isolated ones. Rounds grow with the logarithm of the longest path, each
    round is written to the shared checkpoint folder, and only two numbers per round reach the driver. The per-node minimum
    is a partial aggregate joined back, so a node with very many neighbours is split by the skew-join handling.
    """
    edges = cut_lineage(edges.select("a", "b").distinct())  # read by the nodes and by the first round
    own = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    nodes = own.distinct() if nodes is None else nodes.select("node").unionByName(own).distinct()
    current, before = edges.filter("a <> b"), None
    for turn in range(max_rounds):
        last, current = current, cut_lineage(_small_star(_large_star(current)))
        if turn:
            drop_table(last)  # a superseded round
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if before == (mark["n"], mark["h"]):
            break
        before = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def pack_cell(bin_col, row, col):
    """(bin, cell) as one number whose order is bin, then row, then column."""
    return (bin_col.cast("bigint") * 181 + (row + 90)) * 361 + (col + 180)


def cell_components(cells: DataFrame) -> DataFrame:
    """(bin, row, col, component): groups of departed cells that touch, corners included, per bin."""
    keyed = cells.select("bin", "row", "col", pack_cell(F.col("bin"), F.col("row"), F.col("col")).alias("node")).distinct()
    around = explode_ring(keyed).filter((F.col("nrow") != F.col("row")) | (F.col("ncol") != F.col("col")))
    other = keyed.select("bin", F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("node").alias("b"))
    edges = around.select("bin", "nrow", "ncol", F.col("node").alias("a")).join(other, ["bin", "nrow", "ncol"]).filter("a < b").select("a", "b")
    labels = connected_components(edges, keyed.select("node"))
    return keyed.join(labels, "node").select("bin", "row", "col", "component")
