"""The registered queries of this folder: thin, over whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import (
    bin_packing,
    chunk_dedup,
    exact_dedup,
    language,
    minhash,
    mixing,
    packing,
    quality_rules,
    secrets,
    spelling,
    token_output,
    toxicity,
    whitening,
)
from cartloom.llm.common import held_out
from cartloom.plans.pinning import pin_folder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{pin_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_token_files(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_output.token_digest(token_output.read_token_files(spark, folder))


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.filter(~held_out()))
    found = language.label_languages(docs, model)
    n = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", n)


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = exact_dedup.exact_duplicates(docs)
    text = exact_dedup.normalised(F.col("text"))
    digests = docs.select(
        F.col("doc_id").alias("d_id"), exact_dedup.document_key(F.col("text")).alias("d_key"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_key") == F.col("d_key"))
    return judged.join(digests, same).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE, F.col("failed"))).alias("base_failed"),
        quality_rules.passes(quality_rules.DEFAULT_POLICY, F.col("failed")).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(documents(spark, sf_dir))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secrets(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marked = labels(spark, sf_dir).filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, marked)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst"
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bin_packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens"
    )


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_language_spans, op3_exact_duplicates, op4_quality_ledger, op5_source_mix,
        op6_repeated_passages, op7_secret_spans, op8_toxicity_scores, op9_near_duplicates, op10_mixture_packing,
        op11_slack_packing, op12_whitened_embeddings, op13_spelling_variants,
    )
}
