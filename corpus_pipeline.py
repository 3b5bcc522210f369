"""A corpus pipeline: five operators of ``sparkloom.llm``, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from sparkloom.llm.common import fresh, materialize, read_table, small_batches
from sparkloom.session import discard

#: What the language stage has returned from the scratch folder, until a later stage reads other files.
_returned: list[DataFrame] = []


def clear_returned(docs: DataFrame) -> None:
    """Deletes what an earlier stage returned, once its rows have been written elsewhere and are read from there."""
    for old in list(_returned):
        if old.sparkSession is not docs.sparkSession:
            _returned.remove(old)
        elif not set(old.inputFiles()) & set(docs.inputFiles()):
            discard(old)
            _returned.remove(old)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay, with the predicted one as ``lang``; those without any (``und``) go."""
    names = docs.columns
    model = language_id.fit(docs)
    found = fresh(names, "lang_pred")
    judged = language_id.predict(docs, model, found, fresh(names, "lang_score"))
    kept = judged.filter(judged[found] != language_id.UNKNOWN)
    with small_batches(spark):  # whole texts go through Python here
        out = materialize(kept.withColumn("lang", kept[found]).select(*[f"`{c}`" for c in names]), "in-a-language")
    _returned.append(out)
    return out


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the smallest doc_id stays."""
    clear_returned(docs)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at Jaccard 0.8 or more, the smallest doc_id stays."""
    return ngram_join.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document appears as often as it is taken.

    Quality weights are from ``labels``; a folder without that table has no
    labelled documents, and says so.
    """
    try:
        labels = read_table(spark, sf_dir, "labels")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no labels in {sf_dir}: all documents are mixed with weight 1", stacklevel=2)
        labels = None
    return mixing.mix_documents(docs, labels)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 2048 tokens."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: Tokenizing, language models and packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None
