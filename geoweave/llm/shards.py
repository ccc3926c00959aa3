"""Sharding by a Hilbert curve over several metadata dimensions.

Each dimension is quantised by its own quantiles, rows are ordered along the curve, and the order is cut into runs whose counts differ by one at most. A run
covers a compact box of the dimensions, so the minimum and maximum of each file prune on all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import is_broadcastable, packed, text_of, unpacked, with_copies
from geoweave.session import cut_lineage

BITS = 4


def hilbert_place(cell: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a grid cell on the Hilbert curve, after Skilling, "Programming the Hilbert curve" (2004)."""
    x = list(cell)
    for b in range(bits - 1, 0, -1):
        for i in range(len(x)):
            if x[i] >> b & 1:
                x[0] ^= (1 << b) - 1
            else:
                swap = (x[0] ^ x[i]) & ((1 << b) - 1)
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            turn ^= (1 << b) - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v ^ turn) >> b & 1
    return out


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer columns in [0, 2**bits), looked up in a table of all 2**(bits * dimensions) cells."""
    n = len(coordinates)
    table = [hilbert_place(tuple(cell >> bits * (n - 1 - i) & (1 << bits) - 1 for i in range(n)), bits) for cell in range(1 << bits * n)]
    cell = F.lit(0)
    for c in coordinates:
        cell = cell * (1 << bits) + c
    return F.get(F.lit(table), cell)


def quantised(df: DataFrame, dimensions: list[str], bits: int = BITS) -> list[Column]:
    """Columns in [0, 2**bits): how many of the dimension's quantiles a value exceeds; null is 0. 2**bits - 1 numbers a dimension reach the driver."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(d, shares, 2000).alias(d) for d in dimensions]).first()
    return [sum((F.coalesce(F.col(d) > F.lit(c), F.lit(False)).cast("int") for c in cuts[d] or []), F.lit(0)) for d in dimensions]


def with_ranks(items: DataFrame, names: list[str]) -> DataFrame:
    """`items` with each string column of `names` replaced by the rank of its value among the distinct values, in the order of their UTF-8 bytes; null stays null.

    Whole strings are compared. Values are counted before the shuffle, sorted over range partitions, and numbered inside a partition from the number of values in those before.
    """
    for name in names:
        values = items.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("s_n"))
        parts = cut_lineage(values.repartitionByRange(name).withColumn("s_part", F.spark_partition_id()))
        held = parts.groupBy("s_part").agg(F.count(F.lit(1)).alias("s_held"))
        before = held.select("s_part", F.coalesce(F.sum("s_held").over(Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_before"))
        inside = F.row_number().over(Window.partitionBy("s_part").orderBy(name))
        ranks = cut_lineage(parts.withColumn("s_in", inside).join(F.broadcast(before), "s_part").select(F.col(name).alias("s_value"), (F.col("s_in") + F.col("s_before")).cast("bigint").alias("s_rank")))
        size = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("s_value")), F.lit(0))).first()
        side = F.broadcast(ranks) if is_broadcastable(size[0] * 48 + size[1], 1) else ranks
        items = items.join(side, F.col(name) == F.col("s_value"), "left").withColumn(name, F.col("s_rank")).drop("s_value", "s_rank")
    return items


def assign_shards(items: DataFrame, dimensions: list[str], shards: int = 24, most_buckets: int = 1 << 16) -> DataFrame:
    """The rows of `items` (light columns only: keys and numeric dimensions) with h, shard and slot.

    Order: curve index, then a hash of all columns, so rows of one cell spread over buckets of about N / `most_buckets` rows (1024 at least) that are numbered in
    parallel. Equal rows are counted before the shuffle and numbered together. Counts of shards differ by one at most, slots run from 0.
    The table of bucket counts has at most 4096 + `most_buckets` rows for three dimensions; it alone is summed in one task.
    """
    if (1 << BITS * len(dimensions)) + most_buckets > 1 << 20:
        raise ValueError("the bucket counts are summed in one task and broadcast: at most a million of them")
    items = cut_lineage(items)
    keys = items.columns
    placed = items.withColumn("h", hilbert_index(quantised(items, dimensions)))
    groups = cut_lineage(placed.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("copies")))
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    target = max(1024, -(-total // most_buckets))
    cells = groups.groupBy("h").agg(F.ceil(F.sum("copies") / target).alias("pieces"))
    rows = groups.join(F.broadcast(cells), "h").withColumn("tie", F.xxhash64(*keys)).withColumn("bucket", F.pmod("tie", F.col("pieces")))
    counts = rows.groupBy("h", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.orderBy("h", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("h", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("h", "bucket").orderBy("tie", *keys).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("first", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(offsets), ["h", "bucket"])
    ranked = with_copies(ranked, "copies").select(*keys, "h", (F.col("offset") + F.col("first") + F.col("copy")).alias("rank"))
    shard = F.expr(f"cast((cast(rank as decimal(20,0)) * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as decimal(20,0)) * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop("rank")


def document_items(docs: DataFrame) -> DataFrame:
    """(doc_id, size, crc, source, lang) as numbers, source and language as ranks; columns that are missing count as null. size: UTF-8 bytes plus 8."""
    def dimension(name: str) -> Column:
        return (F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")).alias(name)
    items = docs.select(F.col("doc_id"), (F.octet_length(text_of()) + 8).cast("bigint").alias("size"), F.crc32(text_of()).alias("crc"), dimension("source"), dimension("lang"))
    return with_ranks(cut_lineage(items), ["source", "lang"])


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, crc, shard, slot, h): every row of `docs` in one of `shards` runs along the curve over source, language and size.

    Null texts have size 8, null ids and null dimensions are ordinary values, repeated rows get a slot each; an empty table gives no rows.
    """
    return assign_shards(document_items(docs), ["source", "lang", "size"], shards).select("doc_id", "size", "crc", "shard", "slot", "h")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write the rows of `docs` to `path`, one folder `shard=k` and one file per shard, sorted by slot."""
    keys = [F.col("doc_id"), (F.octet_length("text") + 8).cast("bigint").alias("size"), F.crc32("text").alias("crc")]
    rows = packed(docs).select("row", *keys)
    alike = Window.partitionBy("doc_id", "size", "crc")
    rows = rows.withColumn("copy", F.row_number().over(alike.orderBy(F.xxhash64("row"))))
    placed = shard_documents(docs, shards).withColumn("copy", F.row_number().over(alike.orderBy("shard", "slot")))
    same = [rows[k].eqNullSafe(placed[k]) for k in ("doc_id", "size", "crc", "copy")]
    out = unpacked(rows.join(placed, same).select("row", "shard", "slot"), docs.columns, shard=F.col("shard"), slot=F.col("slot"))
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
