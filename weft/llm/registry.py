"""The opN_ queries and the pipeline, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chosen_path, html_text, mixing, oracles, packing, quality_rules, recompression, rule_ensemble, secrets, suffix_dedup, top_k

#: Where the public vocabularies are; a parameter of the operators.
VOCABULARIES = Path(public_tokenizers.path("word_bpe_49k.json")).parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _band(pieces: float, bytes_: float, byte_share: float, evenness: float, most: float = 8.0) -> quality_rules.Band:
    return quality_rules.Band((pieces, most), (bytes_, most), byte_share, evenness)


#: By language: among the rows of sf0.1 that are labelled good and pass the base rules, evenness has its lowest half percent
#: below its end, and both fertilities lie 0.06 or more above theirs but for the lowest quarter percent.  None of these rows
#: has a byte token; 2 % are let through.  A language without bands takes its script's.
FERTILITY = quality_rules.FertilityRules(
    pieces=("sentencepiece", str(VOCABULARIES / "piece_bpe_32k.model")),
    bytes=("tiktoken", str(VOCABULARIES / "byte_bpe_50k.tiktoken")),
    by_language={"en": _band(1.936, 2.052, 0.02, 0.775), "de": _band(2.005, 1.843, 0.02, 0.758), "fr": _band(1.664, 1.678, 0.02, 0.746), "es": _band(1.732, 1.585, 0.02, 0.727)},
    by_script={
        "latin": _band(1.6, 1.5, 0.02, 0.65), "greek": _band(0.7, 0.4, 0.6, 0.3, 6.0), "cyrillic": _band(0.7, 0.4, 0.6, 0.3, 6.0), "hebrew_arabic": _band(0.4, 0.3, 0.9, 0.3, 6.0),
        "indic": _band(0.2, 0.1, 1.0, 0.3, 6.0), "cjk": _band(0.2, 0.1, 1.0, 0.3, 4.0),
    },
)


#: Five-word shingles, similarity 0.8 or more.
NEAR = chosen_path.Join(width=5, numerator=4, denominator=5)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), str(VOCABULARIES / "word_bpe_49k.json"), 2048)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), FERTILITY)


def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"), NEAR)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup(table(spark, sf_dir, "documents"), width=50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, most_copies=2)


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.dedup(table(spark, sf_dir, "documents"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return top_k.search(documents, documents.filter("doc_id % 50 = 0"), top_k.Search(k=10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
