"""A corpus pipeline over ``documents``: rate, deduplicate, mask, mix and pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import mixing, neardup, packing, quality, queries, secrets
from veilframe.llm.common import give_back, stash, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels of the documents at hand; rejected documents go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; no document goes."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: each document once at least, small sources more often."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing; a document that is shown twice gives its pieces twice."""
    return packing.pack_documents(docs, queries.tokenizer_path())


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def rested(stage):
    """``stage``, before which the driver gives back what earlier ones left behind.

    Batches between Spark and Python hold ``BATCH_ROWS`` rows at most from then on in the session,
    as a worker has a batch several times: as Arrow, as strings and as words.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        rows = int(spark.conf.get(BATCH_CONF))
        spark.conf.set(BATCH_CONF, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", rested(quality_classifier)),
    ("near-duplicates", rested(near_duplicates)),
    ("secrets", rested(secret_scan)),
    ("mixing", rested(mix_sources)),
    ("packing", rested(pack_sequences)),
]

#: Trained models and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each one returns is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = stash(docs)
    return docs
