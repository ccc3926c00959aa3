"""Quality rules: line-first cleaning, after a few whole-text rules.

Every line is judged by itself (punctuation, navigation, boilerplate). Failing lines are removed, and a text that lost too much of itself is
rejected. Blank lines are no evidence and stay. One pass over the rows without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import kept_documents, packed, space_words, unpacked

BLANKS, WORD = "\\s", "\\S"  # of ASCII: blank, \\t, \\n, \\x0B, \\f, \\r
SYMBOLS = "#*$%&|<>"
TRIGRAM = 3

#: What lines of page furniture say, in lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies", "use of cookies", "enable javascript",
               "javascript is disabled", "sign in", "sign up", "log in to", "subscribe to our", "newsletter", "click here", "read more", "share this", "follow us",
               "skip to content", "back to top", "lorem ipsum")
_SEPARATORS = "[|\\u00BB\\u2022\\u203A\\u00B7>]"
_RUNS = "[!?]{2,}|[#*$%&=~_+]{2,}|[-.,;:]{4,}"
_MARKS = "[!?#*$%&=~_+|\\u00BB\\u2022\\u203A\\u00B7>]|[-.,;:]{4}"  # in every text with a run or a separator


def with_counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of `text` (never null); helper columns start with `q_`.

    Windows of three words are compared by 64-bit hashes. To find those that repeat, (upper 44 bits of the hash, place) is sorted as one number and
    neighbours are compared; a text with 2**20 words or more, or with a neighbour that only its 44 bits make equal, sorts (hash, place) instead.
    """
    low = (1 << 20) - 1
    none = F.array().cast("array<struct<a:int,b:int>>")
    df = df.withColumn("q_w", F.transform(space_words(F.col("text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size("q_w").cast("bigint"))
    df = df.withColumn("q_g", F.zip_with(F.zip_with("q_w", _rest("q_w", 2), lambda a, b: F.xxhash64(a, b)), _rest("q_w", 3), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("q_g", F.slice("q_g", 1, F.greatest(F.size("q_w") - (TRIGRAM - 1), F.lit(0))))
    narrow = F.sort_array(F.transform("q_g", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("q_k", F.when(F.size("q_g") <= low, narrow).otherwise(F.array().cast("array<bigint>")))
    near = F.zip_with("q_k", _rest("q_k", 2), lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), 20) == 0, F.struct(a.bitwiseAND(F.lit(low)).cast("int").alias("a"), b.bitwiseAND(F.lit(low)).cast("int").alias("b"))))
    df = df.withColumn("q_n", F.filter(near, lambda e: e.isNotNull()))
    wide = (F.size("q_g") > low) | F.exists("q_n", lambda e: F.get("q_g", e["a"]) != F.get("q_g", e["b"]))
    df = df.withColumn("q_x", F.when(wide, F.array_sort(F.transform("q_g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    full = F.zip_with("q_x", _rest("q_x", 2), lambda a, b: F.when(a["g"] == b["g"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    df = df.withColumn("q_n", F.when(F.size("q_x") > 0, F.filter(full, lambda e: e.isNotNull())).otherwise(F.coalesce("q_n", none)))
    places = F.sort_array(F.array_distinct(F.concat(F.transform("q_n", lambda e: e["a"]), F.transform("q_n", lambda e: e["b"]))))
    covered = F.aggregate(places, F.struct(F.lit(-TRIGRAM).alias("last"), F.lit(0).cast("bigint").alias("n")),
                          lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(TRIGRAM), x - acc["last"])).alias("n")), lambda acc: acc["n"])
    lines = F.transform(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    return (df.withColumn("n_repeat_words", F.when(F.size("q_n") > 0, covered).otherwise(F.lit(0).cast("bigint")))
            .withColumn("q_l", lines).withColumn("n_dup_lines", (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("bigint"))
            .withColumn("word_chars", visible(F.col("text")).cast("bigint"))
            .withColumn("n_symbols", F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("bigint")))


def _rest(array: str, start: int) -> Column:
    return F.slice(array, start, F.greatest(F.size(array), F.lit(1)))


def visible(text: Column) -> Column:
    """Code points that are not ASCII white space."""
    return F.length(F.regexp_replace(text, BLANKS + "+", ""))


def has_furniture(text: Column) -> Column:
    """Whether a phrase of BOILERPLATE begins at a word, in any case; phrases are tried by first letter."""
    letters = sorted({p[0] for p in BOILERPLATE})
    branches = [f"[{x}{x.upper()}](?i:{'|'.join(p[1:] for p in BOILERPLATE if p[0] == x)})" for x in letters]
    return text.rlike(f"\\b(?:{'|'.join(branches)})")


def line_passes(line: Column, suspect: bool, max_mark_share: float = 0.3, max_runs: float = 0.25, nav_words: int = 6, furniture_words: int = 30) -> Column:
    """Whether a line with a word is prose.

    Punctuation: it fails when it has at least four ASCII marks and they are more than `max_mark_share` of its characters, when it has at least three
    runs of marks ("!!", "###") and one for every 1/`max_runs` words, or when it has neither a letter nor a digit. Navigation: it fails when it has
    three or more separators and at most `nav_words` words to each. Boilerplate: it fails when it holds a phrase of BOILERPLATE and at most
    `furniture_words` words. Without `suspect` (the whole text has neither such a phrase nor
    runs or separators) the rules on these are left out.
    """
    words = F.size(F.split(F.trim(line), BLANKS + "+"))
    marks = F.length(F.regexp_replace(line, "\\P{Punct}+", ""))
    runs = F.regexp_count(line, F.lit(_RUNS))
    bars = F.regexp_count(line, F.lit(_SEPARATORS))
    bad = ((marks >= 4) & (marks > max_mark_share * F.length(line))) | ~line.rlike("[\\p{L}\\p{N}]")
    if suspect:
        bad = (bad | ((runs >= 3) & (runs >= max_runs * words)) | ((bars >= 3) & (words <= nav_words * bars))
               | (has_furniture(line) & (words <= furniture_words)))
    return ~bad


def _keeps(suspect: bool):
    return lambda line: ~line.rlike(WORD) | line_passes(line, suspect)


def judged(docs: DataFrame, max_lost: float, min_words: int, max_repeat_percent: int, max_symbol_percent: int) -> DataFrame:
    """`packed` rows with the counts, q_lines, q_kept, q_clean, q_failed and q_good."""
    df = with_counts(packed(docs))
    df = df.withColumn("q_lines", F.split("text", "\n"))
    passing = [F.filter("q_lines", _keeps(s)) for s in (True, False)]
    df = df.withColumn("q_kept", F.when(F.col("text").rlike(_MARKS) | has_furniture(F.col("text")), passing[0]).otherwise(passing[1]))
    df = df.withColumn("q_clean", F.array_join("q_kept", "\n"))
    left = visible(F.col("q_clean"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    good = ((F.col("word_chars") - left <= max_lost * F.col("word_chars")) & (100 * F.col("n_symbols") <= max_symbol_percent * F.col("word_chars"))
            & (2 * F.col("n_dup_lines") <= F.size("q_l")))
    return df.withColumn("q_failed", failed).withColumn("q_good", ~F.col("q_failed") & good)


def clean_lines(docs: DataFrame, max_lost: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int = 10) -> DataFrame:
    """The documents with `text` cleaned line by line, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (of the text as it was),
    n_lines_removed, base_failed and kept.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent` percent of the words in windows of three words that repeat.
    kept: not base_failed, lines removed hold at most `max_lost` of the visible characters, symbols are at most `max_symbol_percent` percent of
    them, and repeated lines are at most half of the lines. Null and empty texts have no words and fail. Repeated rows are judged alike.
    """
    df = judged(docs, max_lost, min_words, max_repeat_percent, max_symbol_percent)
    counts = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return unpacked(df, docs.columns, text=F.col("q_clean"), **counts, n_lines_removed=(F.size("q_lines") - F.size("q_kept")).cast("bigint"),
                    base_failed=F.col("q_failed"), kept=F.col("q_good"))


def keep_clean(docs: DataFrame, max_lost: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int = 10) -> DataFrame:
    """Kept documents with their cleaned texts and the columns of `docs`; an `n_chars` column is counted anew."""
    df = judged(docs, max_lost, min_words, max_repeat_percent, max_symbol_percent)
    return kept_documents(df, F.col("q_good"), docs.columns, F.col("q_clean"))
