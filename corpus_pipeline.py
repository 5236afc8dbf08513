"""From raw documents to a weighted training mix.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what the next one works on. All but the last return the
columns of documents: rejects of the quality classifier go, lines that ten or more documents share go, of each group of near copies the
document with the smallest id stays, documents that repeat the benchmark go. The last adds each document's rate and copies for the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipewatch.llm import common, decontaminate, lines, mixing, quality, simhash

#: SQL can express neither the classifiers nor the fingerprints; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_shared_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(common.table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, columns=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet to the shared checkpoint folder and read again."""
    import uuid

    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
