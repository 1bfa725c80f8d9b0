"""The registered queries of these operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm import (
    ann, bpe, conversations, counts, decontaminate, lexical, ppm, quality, shards, simhash, tokenfiles,
    toxicity, urls,
)
from cuespark.llm.common import fold, table
from cuespark.llm.sql import ORACLES  # noqa: F401


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "row.doc_id", (fold("row.doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.with_score(docs, model), 0.3)


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return _judged(scored, 0.5)


def op3_simhash(spark, sf_dir) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_nearest(spark, sf_dir) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_bpe(spark, sf_dir) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_urls(spark, sf_dir) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op7_ppm(spark, sf_dir) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir) -> DataFrame:
    return decontaminate.judge_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_token_counts(spark, sf_dir) -> DataFrame:
    return counts.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")
    )


def op10_shards(spark, sf_dir) -> DataFrame:
    return shards.shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_conversations(spark, sf_dir) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


def op12_lexical(spark, sf_dir) -> DataFrame:
    return lexical.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10
    )


def op13_token_files(spark, sf_dir) -> DataFrame:
    return tokenfiles.round_trip(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_toxicity, op3_simhash, op4_nearest, op5_bpe, op6_urls, op7_ppm,
        op8_decontaminate, op9_token_counts, op10_shards, op11_conversations, op12_lexical, op13_token_files,
    )
}
