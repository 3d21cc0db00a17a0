"""A corpus from documents in five stages. Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import language
from passagelake.llm.common import fold, shared_dir, table
from passagelake.llm.packing import pack_documents
from passagelake.llm.queries import mixture, tokenizer_path
from passagelake.llm.simhash_long import first_of_each
from passagelake.llm.toxicity import fit_lexicon, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text none of whose languages has this share of its letters is rejected.
LEAST_SHARE = 0.4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from their labels, doesn't call toxic.

    Null and empty texts score as without matches; repeated rows and null keys pass or fail by their texts; without labels all stay. Empty input gives an empty result.
    """
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 0))
    return score_toxicity(docs.select(*COLUMNS), lexicon).where(F.col("predicted") == 0).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of which one language has enough.

    Null and empty texts go, as they have no letters; without rows that name a language, all go. Repeated rows and null keys pass or fail by their texts. Empty input gives an empty result.
    """
    model = language.fit(docs.where(~fold(F.col("doc_id"), 0)))
    found = language.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_SHARE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts that are equal or similar (Jaccard similarity of five-word shingles, 0.8); SimHash finds the candidates.

    Rows without doc_id come last in their group. Of rows that share the smallest doc_id, one stays; unlike texts that share a doc_id all stay.
    """
    return first_of_each(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture; a row is repeated for each epoch that takes it.

    Null languages and sources are names of their own; rows without tokens go with their neighbours; of rows alike in all, as many as the budget wants are taken. Empty input gives an empty result.
    """
    return mixture(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences for training.

    A null or empty text is its closing id; repeated rows and null keys are packed as rows of their own. Empty input gives an empty result.
    """
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Models are trained in the stages, which SQL can't express; the tests hold the operators behind the stages against brute force or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
