"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import chat, chunks, extract, merkle, neardup, packing, privacy, quality, secrets, shards, tokens, trie, winnow
from geoweave.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op9_line_quality(spark, folder):
    return quality.clean_lines(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


@_query
def op10_hilbert_shards(spark, folder):
    return shards.shard_documents(_table(spark, folder, "documents")).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op3_chat_parts(spark, folder):
    planted = spark.sql("SELECT -1L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    messages = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.read_back(chat.format_conversations(messages))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))



@_query
def op7_winnowing(spark, folder):
    report = winnow.decontaminate(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")




@_query
def op2_line_chunks(spark, folder):
    left = chunks.drop_repeated_passages(_table(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_lines_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@_query
def op4_best_fit(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents")).select("bin_id", "slot", "doc_id", "piece", "start", "length")


@_query
def op1_viterbi_counts(spark, folder):
    return tokens.with_token_counts(_table(spark, folder, "documents").select("doc_id", "text"), VOCABULARY).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "n_tokens")


@_query
def op8_bag_minhash(spark, folder):
    return neardup.near_classes(_table(spark, folder, "documents")).select("doc_id", "class_id")


@_query
def op6_linked_secrets(spark, folder):
    return secrets.report(secrets.scan_secrets(_table(spark, folder, "documents")))


@_query
def op5_disclosure(spark, folder):
    return privacy.report(privacy.sanitise(_table(spark, folder, "documents").select("doc_id", "text")))


@_query
def op11_burst_trie(spark, folder):
    return trie.conversation_trie(_table(spark, folder, "conversations"))


@_query
def op12_merkle_manifest(spark, folder):
    docs = _table(spark, folder, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, merkle.leaf_digest(docs, text=cut))


@_query
def op13_flat_blocks(spark, folder):
    return extract.extract_pages(_table(spark, folder, "pages"))
