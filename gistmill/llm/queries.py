"""The operators of this subpackage as queries over a table folder, with production parameters, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import quality_crf
from gistmill.llm.bpe import bpe_round_trip
from gistmill.llm.decontaminate import decontaminate
from gistmill.llm.jaccard_join import jaccard_components
from gistmill.llm.language_id import identify, train
from gistmill.llm.line_dedup import dedup_lines
from gistmill.llm.pii import find_pii
from gistmill.llm.quality_rules import oracle as quality_oracle
from gistmill.llm.quality_rules import quality_rules
from gistmill.llm.token_counts import token_counts
from gistmill.llm.url_filter import listed_domains, url_filter
from gistmill.llm.url_filter import oracle as url_oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; GISTMILL_TOKENIZERS names another folder."""
    import os

    if folder := os.environ.get("GISTMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality_crf.score_quality(documents, quality_crf.train(documents, _table(spark, sf_dir, "labels")))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), listed_domains(spark))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: line counts, whether it was emptied, and a digest of what is left."""
    return dedup_lines(_table(spark, sf_dir, "documents"), own_words=1).select("doc_id", "n_lines", "n_dropped", "emptied", F.sha2("text", 256).alias("text_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return identify(documents, train(documents))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    own = (op1_quality_rules, op2_quality_crf, op3_bpe_round_trip, op4_url_filter, op5_line_dedup, op6_jaccard_join, op7_language_id, op8_token_counts, op9_pii, op10_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_oracle(), "op4_url_filter": url_oracle()}
