"""Benchmark decontamination by winnowing.

Of every window of `WINDOW` consecutive k-grams the least hash is kept, on both sides, by the same rule; so two texts that share GUARANTEE = K + WINDOW - 1 consecutive
words share a kept hash. Kept hashes of documents and items meet in a join, and each meeting is extended along its diagonal by comparing words.
Items of fewer words than GUARANTEE are one window as a whole and meet by the hash of all their words, one length at a time.

Arrays are exploded with the `_outer` form: for the plain one Spark adds a filter on the array's size, whose pushdown would repeat the whole chain of array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import document_key, folded_words, is_broadcastable, packed, text_of, unpacked
from geoweave.session import cut_lineage

K, WINDOW = 7, 4
GUARANTEE = K + WINDOW - 1


def _shifted(array: Column, by: int) -> Column:
    """The array without its first `by` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def _first(array: Column, n: Column) -> Column:
    return F.slice(array, 1, F.greatest(n, F.lit(0)))


def with_windows(df: DataFrame, source: str, out: str, n: int, combine) -> DataFrame:
    """Adds the windows of `n` neighbours of an array, reduced by `combine`: powers of two by doubling, then two that overlap."""
    width, parts = 1, {1: source}
    while width * 2 <= n:
        parts[width * 2] = f"w_{out}_{width * 2}"
        df = df.withColumn(parts[width * 2], F.zip_with(parts[width], _shifted(F.col(parts[width]), width), combine))
        width *= 2
    whole = F.col(parts[width]) if width == n else F.zip_with(parts[width], _shifted(F.col(parts[width]), n - width), combine)
    return df.withColumn(out, _first(whole, F.size(source) - (n - 1))).drop(*[p for w, p in parts.items() if w > 1])


def with_grams(df: DataFrame, hashes: str, out: str, n: int) -> DataFrame:
    """Adds the hashes of all n-grams of the word hashes in column `hashes`."""
    return with_windows(df, hashes, out, n, lambda a, b: F.xxhash64(a, b))


def with_minima(df: DataFrame, grams: str, out: str) -> DataFrame:
    """Adds the distinct minima of all windows of WINDOW neighbouring grams. Texts of fewer grams cannot hold a shared span and get none."""
    return with_windows(df, grams, "w_m", WINDOW, lambda a, b: F.least(a, b)).withColumn(out, F.array_distinct("w_m")).drop("w_m")


def hashed_words(text: Column) -> Column:
    return F.transform(folded_words(text), lambda w: F.xxhash64(w))


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n): distinct items with at least one word; null texts have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), folded_words(text_of()).alias("words"))
    return items.withColumn("n", F.size("words")).filter("n > 0").distinct()


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, q, g): n-grams of the items with their places, of those that are looked up by n-grams: shorter ones by their whole length, others by K."""
    by = F.when(F.col("n") < GUARANTEE, F.col("n")).otherwise(K)
    df = items.filter(by == n).withColumn("w_h", F.transform("words", lambda w: F.xxhash64(w)))
    return with_grams(df, "w_h", "w_g", n).select("item_id", F.posexplode_outer("w_g").alias("q", "g"))


def _met(grams: DataFrame, fingerprints: DataFrame, rows: int) -> DataFrame:
    """`grams` joined with the fingerprints on g: by broadcast only where their counted size is small, else by shuffle."""
    return grams.join(F.broadcast(fingerprints) if is_broadcastable(rows, 64) else fingerprints, "g")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id): documents and items that share a kept hash."""
    lengths = [r["n"] for r in items.filter(F.col("n") < GUARANTEE).select("n").distinct().collect()]
    long_items = items.filter(F.col("n") >= GUARANTEE)
    marks = with_minima(with_grams(long_items.withColumn("w_h", F.transform("words", lambda w: F.xxhash64(w))), "w_h", "w_g", K), "w_g", "w_f")
    marks = marks.select("item_id", F.explode_outer("w_f").alias("g"))
    for n in lengths:
        marks = marks.unionByName(item_grams(items.filter(F.col("n") == n), n).select("item_id", "g"))
    marks = cut_lineage(marks.distinct())
    rows = marks.count()
    df = docs.select(document_key().alias("key"), hashed_words(text_of()).alias("w_h"))
    df = with_minima(with_grams(df, "w_h", "w_g", K), "w_g", "w_f")
    found = F.col("w_f")
    if lengths:
        for n in lengths:
            df = with_grams(df, "w_h", f"w_s{n}", n)
        found = F.concat(found, *[F.array_distinct(f"w_s{n}") for n in lengths])
    grams = df.select("key", F.explode_outer(found).alias("g"))
    return _met(grams, marks, rows).select("key", "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, pos): every document word inside an occurrence of a window of an item, once per item."""
    items = cut_lineage(prepared_items(benchmark))
    pairs = cut_lineage(candidates(docs, items))
    texts = docs.select(document_key().alias("key"), text_of().alias("text")).join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"))
    texts = cut_lineage(texts.select("key", folded_words(F.col("text")).alias("words")))
    hashed = texts.withColumn("w_h", F.transform("words", lambda w: F.xxhash64(w)))
    lengths = [r["n"] for r in items.filter(F.col("n") < GUARANTEE).select("n").distinct().collect()]
    diagonals = None
    for n in sorted({K, *lengths}):
        grams = with_grams(hashed, "w_h", "w_g", n).select("key", F.posexplode_outer("w_g").alias("p", "g"))
        met = grams.join(item_grams(items, n), "g").select("key", "item_id", (F.col("p") - F.col("q")).alias("d"))
        diagonals = met if diagonals is None else diagonals.unionByName(met)
    listed = diagonals.distinct().join(items.select("item_id", "n"), "item_id").groupBy("key").agg(F.collect_list(F.struct("item_id", "d", "n")).alias("hits"))
    sides = texts.join(listed, "key").select("key", F.explode_outer(F.transform("hits", lambda h: F.struct(
        h["item_id"].alias("item_id"), h["d"].alias("d"), F.slice("words", F.greatest(h["d"], F.lit(0)) + 1, h["n"] + F.least(h["d"], F.lit(0))).alias("own"), F.size("words").alias("size")))).alias("h"))
    sides = sides.select("key", "h.*").join(items, "item_id")
    # words of the document and the item along the diagonal; `from` is the document place of the first pair
    theirs = F.slice("words", F.greatest(-F.col("d"), F.lit(0)) + 1, F.size("own"))
    sides = sides.withColumn("same", F.zip_with("own", theirs, lambda a, b: F.coalesce(a == b, F.lit(False))))
    sides = with_windows(sides.select("key", "item_id", "d", "n", "same"), "same", "whole", GUARANTEE, lambda a, b: a & b)
    whole = F.when(F.col("n") >= GUARANTEE, F.col("whole")).otherwise(F.array((F.size("same") == F.col("n")) & F.forall("same", lambda e: e)))
    starts = sides.select("key", "item_id", F.greatest("d", F.lit(0)).alias("from"), F.least("n", F.lit(GUARANTEE)).alias("need"), F.posexplode_outer(whole).alias("i", "hit")).filter("hit")
    spots = starts.select("key", "item_id", F.explode(F.sequence(F.col("from") + F.col("i"), F.col("from") + F.col("i") + F.col("need") - 1)).alias("pos"))
    return spots.distinct()


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`packed` rows with `items` and `n_hit`, both null for clean documents."""
    found = hits(docs, benchmark)
    per_item = found.groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("n"))
    items = per_item.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    words = found.select("key", "pos").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    report = cut_lineage(items.join(words, "key"))
    return packed(docs).withColumn("key", document_key()).join(report, "key", "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` with n_words, n_hit, n_items, items (item ids as strings, sorted) and contaminated.

    Null and empty texts have no words and are clean; items without words are ignored; repeated items count once; repeated rows are judged alike; an empty
    benchmark leaves all clean.
    """
    hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return unpacked(judged(docs, benchmark), docs.columns, n_words=F.size(folded_words(F.col("text"))).cast("bigint"), n_hit=hit, n_items=F.coalesce(F.size("items"), F.lit(0)).cast("bigint"),
                    items=F.coalesce("items", F.array().cast("array<string>")), contaminated=hit > 0)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no window of an item, unchanged."""
    return unpacked(judged(docs, benchmark).filter("n_hit is null"), docs.columns)
