"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all
that the one before kept. All but the last return the columns of ``documents``; what a stage
returns is written and read again by the next.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import decontaminate, jaccard, mixing, quality
from ebbline.llm.queries import tokens
from ebbline.sources.staging import stage

# No SQL states the language model, the set join or the alignments; tests/llm hold the stages
# against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose id is not among ``ids``; a null id is never among them."""
    return docs.join(stage(ids.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality.judge_quality(docs, labels).where("not keep"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates (five-word shingles, 0.8)."""
    return _without(docs, jaccard.near_duplicates(docs).where("component_id <> doc_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.find_contamination(docs, benchmark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate takes it."""
    return mixing.copies(mixing.mix_sources(docs)).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: place, size and checksum of each document."""
    return tokens(spark, docs)


STAGES: list[tuple[str, Callable]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, "pipeline")
    return docs
