"""Column helpers that the text operators share. Built-in expressions only.

Conventions of the whole subpackage: a null text counts as empty; a document row is identified by (doc_id, text), so repeated
rows are one document and rows that share an id but not the text are several; null ids are ordinary values. Operators that give
documents back carry the caller's columns in one struct, so no column name of the caller can clash with an internal one; where
an output column has the name of a caller's column, the output column wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    return F.array_remove(F.split(text, "\\s+"), "")


def folded_words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased: runs of digits, letters a-z and everything beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def document_key(id_name: str = "doc_id", text_name: str = "text") -> Column:
    """What tells document rows apart, for grouping and joining; nulls inside compare as equal."""
    return F.struct(F.col(id_name).cast("bigint").alias("id"), F.xxhash64(text_of(text_name)).alias("h"), F.length(text_of(text_name)).alias("n"))


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns of the caller in `row`, beside the two that operators read."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), text_of().alias("text"))


def unpacked(df: DataFrame, own: list[str], **new: Column) -> DataFrame:
    """The caller's columns again, with `new` ones added or put in their place."""
    columns = [new.pop(c).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in own]
    return df.select(*columns, *[value.alias(name) for name, value in new.items()])


def filtered(df: DataFrame, keep: Column, columns: list[Column]) -> DataFrame:
    """`columns` of the rows where `keep` is true. A plain filter on costly columns would be pushed below the projections that compute them and repeat them all."""
    row = F.explode_outer(F.when(keep, F.array(F.struct(*columns)))).alias("row")
    return df.select(row).filter("row is not null").select("row.*")


def kept_documents(df: DataFrame, keep: Column, own: list[str], text: Column) -> DataFrame:
    """The caller's columns, from a frame with `row`, of the rows where `keep` is true; `text` is put in place, and an `n_chars` column is counted anew."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return filtered(df, keep, [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in own])


def is_broadcastable(rows: int, row_bytes: int, limit_bytes: int = 32 << 20) -> bool:
    """Whether a counted table may be broadcast; beyond the limit callers join by shuffle."""
    return rows * row_bytes <= limit_bytes


def with_copies(df: DataFrame, count: str, block: int = 1 << 14) -> DataFrame:
    """Each row `count` times with `copy` from 0, unfolded block by block, so that no array is longer than `block` however often a row repeats."""
    df = df.withColumn("copy_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / block))))
    copies = F.sequence(F.col("copy_block") * block, F.least(F.col(count), (F.col("copy_block") + 1) * block) - 1)
    return df.withColumn("copy", F.explode(copies)).drop("copy_block", count)


def spans_of(text: Column, pattern: str | Column, kind: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, kind, value>>, in code points, end exclusive.

    Splitting by the same pattern gives the gaps between the matches, so running lengths are the offsets. `guard` is a cheap test that is true
    for every text with a match; other texts skip the pattern.
    """
    kind_of = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(pair["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind_of).alias("out")), step, lambda acc: acc["out"])
    present = F.rlike(text, pattern) if guard is None else guard & F.rlike(text, pattern)
    return F.when(present, found).otherwise(F.array().cast(kind_of))


def joined_spans(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind in the order listed, comma-joined; the empty string for none."""
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
