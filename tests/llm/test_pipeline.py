"""The corpus pipeline against a brute-force version over the smallest tables, and its registration."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from geoweave.llm import quality
from tests.llm.test_rows import repeated_words

FOLDER = "/root/testdata/sf0.001"
BLANK = "[\x20\x09-\x0d]+"


def passes(line):
    marks, words = len(re.findall(r"[!-/:-@\[-`{-~]", line)), len(re.split(BLANK, line.strip(" ")))
    runs, bars = len(re.findall(r"[!?]{2,}|[#*$%&=~_+]{2,}|[-.,;:]{4,}", line)), len(re.findall("[|»•›·>]", line))
    phrase = any(re.search(r"(?<![^\W])" + p, line.lower()) for p in quality.BOILERPLATE)
    return not (marks >= 4 and marks > 0.3 * len(line) or runs >= 3 and runs >= 0.25 * words or not re.search(r"[^\W_]", line) or bars >= 3 and words <= 6 * bars or phrase and words <= 30)


def cleaned(text):
    w = [x for x in re.split(BLANK, text) if x]
    lines = text.split("\n")
    full = [x for x in lines if re.sub(BLANK, "", x)]
    left = [x for x in lines if not re.sub(BLANK, "", x) or passes(x)]
    n = sum(map(len, w))
    if len(w) < 50 or 2 * repeated_words(w) > len(w) or n - len(re.sub(BLANK, "", "\n".join(left))) > 0.5 * n:
        return None
    if 10 * len(re.findall("[#*$%&|<>]", text)) > n or 2 * (len(full) - len(set(full))) > len(full):
        return None
    return "\n".join(left)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_each_stage_is_computed_once(spark):
    """Rows that the first stage reads are counted where they are read."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    seen = spark.sparkContext.accumulator(0)
    real = corpus_pipeline.STAGES[0]

    def counted(spark, docs, folder):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return real[1](spark, docs.mapInArrow(run, docs.schema), folder)
    corpus_pipeline.STAGES[0] = (real[0], counted)
    try:
        rows = corpus_pipeline.run(spark, FOLDER).collect()
    finally:
        corpus_pipeline.STAGES[0] = real
    assert seen.value == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert max(Counter({b: sum(g.length for g in rows if g.bin_id == b) for b in {g.bin_id for g in rows}}).values()) <= 2048


def test_stages_return_the_columns_of_documents(spark, docs):
    few = docs.filter("doc_id < 40").withColumn("n_words", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        few = stage(spark, few, FOLDER)
        assert few.columns == [*docs.columns, "n_words"], name
    rows = few.collect()
    assert rows and {r.n_words for r in rows} == {"own"} and all(r.n_chars == len(r.text) for r in rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if any(re.match(f"op{n}_", x) for x in names)] == list(range(1, 14)) and "pipeline" in names
