"""A corpus pipeline: quality rules, near duplicates, secrets, source mix, packing.

Each stage works on all rows that the stage before it kept, and takes and returns the columns of ``documents``; the last
returns one row for each piece of a document with its place in a training sequence.  Its rules for null, empty, long and
repeated texts are those of the operators, which each state them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.llm import chosen_path, mixing, packing, quality_rules, secrets
from weft.llm.registry import FERTILITY, NEAR, VOCABULARIES
from weft.llm.shared import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs, FERTILITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the smallest doc_id."""
    return chosen_path.first_of_each(docs, NEAR)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it: never, once or twice."""
    return mixing.resample(docs, weights=(5, 2, 1), budget=1.5, most_copies=2)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places."""
    return packing.pack(docs, str(VOCABULARIES / "word_bpe_49k.json"), 2048)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", redaction),
    ("source_mix", source_mix),
    ("packing", sequences),
]

#: No SQL for the tokenisers, the fitted mix and the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read from there.

    What a stage left is removed when the stage after it is written; the last one's files stay for the caller.
    """
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
