"""Corpus pipeline: clean lines, drop repeated passages, near copies and benchmark leaks, then pack what is left into sequences.

Every stage reads all rows its predecessor kept. All but the last return the columns of `documents`; the last returns which token range of which document goes into which bin.
"""

from __future__ import annotations

from geoweave.llm import chunks, neardup, packing, quality, winnow
from geoweave.session import cut_lineage


def quality_rules(spark, docs, sf_dir):
    """Documents that pass, with their cleaned texts."""
    return quality.keep_clean(docs)


def line_dedup(spark, docs, sf_dir):
    """Texts without passages that stand elsewhere before; a text without a word left goes."""
    return chunks.keep_novel(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark passage."""
    return winnow.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir):
    """(bin_id, slot, doc_id, piece, start, length)."""
    return packing.pack_documents(docs).select("bin_id", "slot", "doc_id", "piece", "start", "length")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: Signatures, passages and packing have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over `documents`. What a stage returns is written once, in the shared folder, and reread by the next, which scans it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
