"""Evidence packs for areas of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.operators.joins import inside_regions
from geoweave.session import cut_lineage

COUNTED_KINDS = ("gdelt", "telegram", "adsb", "ais", "firms")


def evidence_pack(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct (region, kind, id) records inside each circle; of several rows for one record the newest."""
    inside = inside_regions(records, regions)
    payload = [c for c in inside.columns if c not in ("region_id", "kind", "id")]
    best = inside.groupBy("region_id", "kind", "id").agg(F.max_by(F.struct(*payload), F.struct("t", "lat", "lon")).alias("_p"))
    return best.select("region_id", "kind", "id", *[F.col(f"_p.{c}").alias(c) for c in payload])


def pack_summary(pack: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region: total, counts by kind with zeros, time span and number of independent sources. Empty regions stay."""
    counts = pack.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in COUNTED_KINDS],
        F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count_distinct("source_key").alias("n_sources"))
    out = regions.select(F.col("id").alias("region_id")).join(counts, "region_id", "left")
    return out.fillna(0, subset=["total", "n_sources", *[f"n_{k}" for k in COUNTED_KINDS]])


def _running(parts: DataFrame, keys: tuple[str, ...], **sums: str) -> DataFrame:
    """Adds running sums (the row itself left out) over a region in key order. They are taken inside range partitions (`_part`) and lifted by the totals of the partitions before, so a
    region with very many records is summed in parallel."""
    totals = parts.groupBy("region_id", "_part").agg(*[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(sums.values())])
    earlier = Window.partitionBy("region_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("region_id", "_part", *[F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_before{i}") for i in range(len(sums))])
    inside = Window.partitionBy("region_id", "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).join(totals, ["region_id", "_part"])
    return out.withColumns({name: F.col(name) + F.col(f"_before{i}") for i, name in enumerate(sums)}).drop(*[f"_before{i}" for i in range(len(sums))])


def _next_starts(placed: DataFrame, budget: int) -> DataFrame:
    """(region_id, pos, next): the first record of the batch after one that starts at pos; the number of records where the region ends before.

    It is the first record that ends beyond start + budget. Ends and limits meet in blocks one budget wide: the record before it ends at most one budget lower, so in the block of the
    limit or the one below. A block holds at most `budget` records.
    """
    ends = placed.select("region_id", F.floor((F.col("_start") + F.col("_size")) / budget).alias("block"), (F.col("_start") + F.col("_size")).alias("at"), "pos", F.lit(None).cast("bigint").alias("of"))
    limits = placed.filter(F.col("_size") <= budget).select("region_id", F.floor((F.col("_start") + budget) / budget).alias("block"), (F.col("_start") + budget).alias("at"), F.lit(None).cast("bigint").alias("pos"), F.col("pos").alias("of"))
    upto = Window.partitionBy("region_id", "block").orderBy("at", F.col("of").asc_nulls_first(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.unionByName(limits).withColumn("last", F.max("pos").over(upto)).filter("of is not null")
    below = ends.groupBy("region_id", "block").agg(F.max("pos").alias("last_below")).withColumn("block", F.col("block") + 1)
    found = met.join(below, ["region_id", "block"], "left").select("region_id", F.col("of").alias("pos"), (F.coalesce("last", "last_below") + 1).alias("next"))
    large = placed.filter(F.col("_size") > budget).select("region_id", "pos", (F.col("pos") + 1).alias("next"))
    return found.unionByName(large)


def _batch_starts(jump: DataFrame, chunk: int) -> DataFrame:
    """(region_id, pos): the records at which batches start, from jump(region_id, pos, next) of every record; the first starts at 0.

    Records of a region lie in chunks, each one row that holds `next` as an array. Inside a chunk the way out is found for every record at once: the array is read through itself, so jumps of
    1, 2, 4, ... batches are made without a shuffle. Between chunks only the records that the way out of some earlier chunk may lead to are followed, by pointer doubling: every one knows where
    it leads, jumps double by joining the table with itself, and the known ones double with each round. Then every chunk knows its first start and lists the others.
    """
    home = F.floor(F.col("pos") / chunk)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "next"))), lambda r: r["next"])
    chunks = cut_lineage(jump.groupBy("region_id", home.alias("chunk")).agg(listed.alias("nexts")))
    doors = F.array_distinct(F.filter("nexts", lambda p: p >= F.col("_base") + F.size("nexts")))
    entries = chunks.withColumn("_base", F.col("chunk") * chunk).select("region_id", F.explode(doors).alias("pos")).unionByName(chunks.filter("chunk = 0").select("region_id", F.lit(0).cast("bigint").alias("pos")))
    at = entries.distinct().groupBy("region_id", home.alias("chunk")).agg(F.collect_list("pos").alias("entries"))
    through = "transform(a, p -> if(p - _base < size(a), a[int(p - _base)], p))"
    out = F.expr(f"aggregate(sequence(1, {max(1, (chunk - 1).bit_length())}), nexts, (a, k) -> {through})")
    led = chunks.join(at, ["region_id", "chunk"]).withColumn("_base", F.col("chunk") * chunk).select("region_id", F.expr("filter(entries, e -> e - _base < size(nexts))").alias("entries"), "_base", out.alias("out"))
    jump = cut_lineage(led.select("region_id", F.explode(F.expr("transform(entries, e -> struct(e as pos, out[int(e - _base)] as next))")).alias("_e")).select("region_id", "_e.*"))
    starts = cut_lineage(jump.filter("pos = 0").select("region_id", "pos"))
    while True:
        # what leads to the end of a region leads to no entry
        more = cut_lineage(starts.join(jump, ["region_id", "pos"]).select("region_id", F.col("next").alias("pos")).join(jump.select("region_id", "pos"), ["region_id", "pos"], "left_semi"))
        if more.isEmpty():
            break
        starts = cut_lineage(starts.unionByName(more))
        onward = jump.select("region_id", F.col("pos").alias("next"), F.col("next").alias("then"))
        jump = cut_lineage(jump.join(onward, ["region_id", "next"], "left").select("region_id", "pos", F.coalesce("then", "next").alias("next")))
    begun = chunks.join(starts.select("region_id", home.alias("chunk"), F.col("pos").alias("_first")), ["region_id", "chunk"]).withColumn("_base", F.col("chunk") * chunk)
    step = "nexts[int(element_at(s, -1) - _base)]"
    all_of = F.expr(f"aggregate(sequence(1, size(nexts)), array(_first), (s, k) -> if({step} - _base < size(nexts), array_append(s, {step}), s))")
    return begun.select("region_id", F.explode(all_of).alias("pos"))


def size_batches(pack: DataFrame, budget: int = 60_000, size: Column | None = None, keys: tuple[str, ...] = ("kind", "id"), chunk: int = 4096) -> DataFrame:
    """Adds `size` and `batch`: records of a region in key order; a batch takes records while they fit the budget, and one at least.

    Where a batch starts depends on all batches before. Starts are found in chunks of `chunk` records (`_batch_starts`); rounds: the logarithm of the chunks of the largest region, over the few
    records at which a chunk may be entered. The range partitioning is written out first: all uses must see the same cut.
    """
    size = F.length(F.to_json(F.struct(*pack.columns))) if size is None else size
    # written before it is cut into ranges: the keys are read once more for the borders, and that would build the pack again
    rows = cut_lineage(pack.withColumn("_size", size.cast("bigint")).withColumn("_one", F.lit(1).cast("bigint")))
    parts = rows.repartitionByRange(*["region_id", *keys]).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(_running(cut_lineage(parts), keys, _start="_size", pos="_one"))
    starts = _batch_starts(_next_starts(placed, budget), chunk)
    marked = placed.join(starts.withColumn("_first", F.lit(1).cast("bigint")), ["region_id", "pos"], "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    out = _running(marked.drop("_start", "_one"), keys, batch="_first").withColumn("batch", F.col("batch") + F.col("_first") - 1)
    return out.drop("_part", "_first", "pos").withColumnRenamed("_size", "size")


def valid_citations(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings with the references that exist, once each and in order; findings left without any are dropped.

    findings(finding_id, text, record_ids); known(record_id).
    """
    refs = findings.select("finding_id", F.posexplode("record_ids").alias("pos", "record_id")).groupBy("finding_id", "record_id").agg(F.min("pos").alias("pos"))
    good = refs.join(known.select("record_id").distinct(), "record_id", "left_semi")
    lists = good.groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record_id"))), lambda r: r["record_id"]).alias("record_ids"))
    return findings.drop("record_ids").join(lists, "finding_id")


def cited_sources(findings: DataFrame, records: DataFrame) -> DataFrame:
    """The records any finding cites."""
    cited = findings.select(F.explode("record_ids").alias("record_id")).distinct()
    return records.join(cited, "record_id", "left_semi")
