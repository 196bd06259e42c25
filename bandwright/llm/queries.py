"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm import (
    chat,
    fim,
    jaccard,
    licenses,
    lines,
    mixing,
    packing,
    quality,
    token_files,
    toxicity,
    vectors,
    warc,
    whitening,
)
from bandwright.llm.tables import Workspace, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        *quality.COUNTS[:5],
        "base_failed",
        "rule",
        "kept",
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), Workspace(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.scored(documents.select("doc_id", "text"), model).drop("text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), Workspace(spark))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.document_files(table(spark, sf_dir, "documents"))
    found = licenses.scanned(files, Workspace(spark))
    number = F.regexp_extract("path", r"(-?\d+)$", 1)
    return found.withColumn("doc_id", F.when(number != "", number).cast("long"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema
    )
    formatted = chat.rendered(chat.folded(chat.turn_events(rows.unionByName(extra))))
    turns = F.col("read")
    said_so = chat.joined(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    )
    learned = F.col("learned")
    return (
        chat.read_back(formatted)
        .withColumn("read", chat.parsed(F.col("formatted")))
        .select(
            "conv_id",
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(said_so, 256).alias("turns_sha256"),
            F.char_length(learned).cast("long").alias("loss_chars"),
            F.sha2(learned, 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    warc.write(table(spark, sf_dir, "pages"), workspace)
    return warc.parsed(warc.read(workspace)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.marked(table(spark, sf_dir, "documents"), Workspace(spark))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        table(spark, sf_dir, "documents"), packing.public_path(), Workspace(spark)
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    folder = workspace.path("tokens")
    documents = table(spark, sf_dir, "documents")
    token_files.write(documents, folder, token_files.public_path("byte_bpe_50k.json"))
    sums = workspace.save(
        token_files.read(spark, folder)
        .withColumn("ids_crc32", F.crc32("ids"))
        .select("file", "doc_id", "before", "n_tokens", "ids_crc32"),
        "sums",
    )
    return token_files.placed(sums, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), Workspace(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_license_scans": op5_license_scans,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_warc": op7_warc,
        "op8_line_dedup": op8_line_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_mixing": op10_mixing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_files": op12_token_files,
        "op13_embedding_whitening": op13_embedding_whitening,
    }
