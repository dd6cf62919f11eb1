"""The corpus pipeline: documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before
kept, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import jaccard, mixing, packing, secrets, toxicity
from logloom.llm.common import stored, table
from logloom.llm.queries import labelled_languages

#: Documents scored at or above this are rejected.
TOXIC = 0.7


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on doc_id, text and one column that holds all others, so that no
    name of theirs meets one that is used inside; the columns come back as they were."""
    own = ("doc_id", "text")
    others = [c for c in docs.columns if c not in own]
    if not others:
        return work(docs).select(*own)
    done = work(docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")))
    return done.select(*(F.col(c) if c in own else F.col("others")[c].alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores as toxic go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return _apart(docs, lambda d: toxicity.score(d, model, "toxicity").where(F.col("toxicity") < TOXIC))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingle sets the smallest doc_id stays."""
    return _apart(docs, jaccard.distinct_documents)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, plain or in nested encodings, are masked in the text."""
    return secrets.redact(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their fitted rates, for even languages."""
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels"))
    fitted = mixing.fit(docs.select("doc_id", "text"), labelled)
    return _apart(docs, lambda d: mixing.mixed(d, fitted))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: Learnt scores, components, decoding and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
