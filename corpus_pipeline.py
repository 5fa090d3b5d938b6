"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vecmill.llm import mixing, ngram_join, pieces, pii, quality_rules
from vecmill.llm.common import documents, shared_dir

STAGES = [
    ("quality rules", quality_rules.keep_good),
    ("n-gram Jaccard join", ngram_join.keep_one),
    ("personal data", pii.redact),
    ("mixing sources to target weights", mixing.mix_documents),
    ("SentencePiece encoding and decoding", pieces.encode_documents),
]

#: Mixing draws pseudorandom blocks and encoding merges by score: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
