"""The corpus pipeline: five stages over `documents`, each the whole output of the one before.

Part of the training-data operators (`engram.llm`). A stage takes (spark, docs, sf_dir); all but the last return
the columns of `documents`. `run` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import bpe, decontaminate, jaccard, quality, toxicity
from engram.llm.common import Scratch, free_name, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go. It learns from the labels of the documents it is given."""
    name = free_name(docs.columns, "toxicity_score")
    scores = toxicity.toxicity_scores_beside(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return scores.where(F.col(name) < 0.5).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the learned decision list go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "quality_verdict")
    return quality.quality_verdicts_beside(docs, rules, name=name).where(F.col(name)["kept"]).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach (five-word shingles, similarity 0.8 or more) the one of least doc_id stays."""
    return jaccard.one_of_each(docs, k=5, threshold="0.8")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text left, and the digests of the ids and of what they decode to."""
    return bpe.encoded_round_trip(docs, bpe.production_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: A trained classifier, a learned list, an iterative closure and a tokenizer: none of it is SQL. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = s.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i > 1:
            s.drop(f"stage-{i - 1}")
    return docs
