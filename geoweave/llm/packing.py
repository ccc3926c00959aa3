"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Bins are kept in the order of their residual room and carry two bitmaps: sources and duplicate clusters they hold. A piece goes to the tightest bin that fits and shares
neither with it: the search starts at the first bin with enough room and goes on to its successors. Spark deals the pieces into groups of bounded size; each
group is packed by itself, the longest pieces first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import text_of, with_copies
from geoweave.session import cut_lineage

SCHEMA = "bin_id string, slot int, doc_id bigint, piece int, start bigint, length bigint, source string, cluster bigint"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (length, source bit or -1, cluster bit or -1), in the order given; bins are numbered as they open.

    Equal residuals are told apart by age, oldest first. A length above `capacity` is refused.
    """
    rooms: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources, clusters, out = [], [], []
    for length, source, cluster in pieces:
        if length > capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (sources[rooms[at][1]] & s or clusters[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            residual, chosen = rooms.pop(at)
        else:
            residual, chosen = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[chosen] |= s
        clusters[chosen] |= c
        if residual > length:
            insort(rooms, (residual - length, chosen))
        out.append(chosen)
    return out


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs more than once; others cannot conflict."""
    codes = pd.factorize(values.where(values.duplicated(keep=False)))[0]
    return codes.tolist()


def packing_items(docs: DataFrame, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """(doc_id, source, cluster, length): what packing reads. Default length: a quarter of the UTF-8 bytes, rounded up, as an estimate of tokens; default cluster: equal
    texts after folding case and white space. A missing source column counts as null."""
    length = F.ceil(F.octet_length(text_of()) / 4) if length is None else length
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim(text_of()), "\\s+", " "))) if cluster is None else cluster
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), cluster.cast("bigint").alias("cluster"), F.coalesce(length, F.lit(0)).cast("bigint").alias("length"))


def pack(items: DataFrame, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """(bin_id, slot, doc_id, piece, start, length, source, cluster): every token of every item in exactly one bin.

    Items longer than `capacity` are cut: whole sequences are bins of their own and the rest is packed. Items of length 0 have one empty piece. No bin holds two pieces of
    one source or one cluster; null sources and clusters never conflict. Equal rows are counted before the shuffle and told apart by a number, so no group of copies lands in
    one task; groups have about `group_rows` pieces. Bins left open by a group stay open: at this size they are a few in a thousand.
    """
    items = cut_lineage(items.groupBy("doc_id", "source", "cluster", "length").agg(F.count(F.lit(1)).alias("copies")))
    total = items.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_rows))
    rows = with_copies(items, "copies")
    keys = ["doc_id", "source", "cluster", "length", "copy"]
    rows = rows.withColumn("id", F.lower(F.hex(F.xxhash64(*keys))))
    whole = (F.col("length") / capacity).cast("bigint")
    full = rows.filter(F.col("length") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))))
    full = full.select(F.concat_ws("-", F.lit("full"), "id", "piece").alias("bin_id"), F.lit(0).alias("slot"), "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"),
                       F.lit(capacity).cast("bigint").alias("length"), "source", "cluster")
    rest = rows.withColumn("piece", whole.cast("int")).withColumn("start", whole * capacity).withColumn("part", F.col("length") - F.col("start")).filter("part > 0 or length = 0")
    rest = rest.withColumn("group", F.pmod(F.xxhash64(*keys, F.lit("group")), F.lit(groups)))

    def pack_group(key, pdf):
        pdf = pdf.sort_values(["part", "id", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = best_fit(list(zip(pdf["part"].tolist(), _bits(pdf["source"]), _bits(pdf["cluster"]))), capacity)
        pdf["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        pdf["slot"] = pdf.groupby("bin_id").cumcount().astype("int32")
        pdf["length"] = pdf["part"]
        return pdf[["bin_id", "slot", "doc_id", "piece", "start", "length", "source", "cluster"]]

    packed = rest.select("group", "id", "doc_id", "piece", "start", "part", "length", "source", "cluster").groupBy("group").applyInPandas(pack_group, SCHEMA)
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    return pack(packing_items(docs), capacity)
