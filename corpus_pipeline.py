"""A training corpus from raw documents: toxicity, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the last
returns packed pieces. run() writes each stage's result as Parquet in the shared folder and reads it for the next.

Defined results, for every stage: columns other than doc_id, text and lang aren't read, and all that the input has come
through unchanged, whatever their names and nulls; helper columns take names that the input doesn't have. An empty table
gives an empty result. Texts are read whole, however long. What a null or empty text, a repeated row or a tie
comes to is said stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelframe.llm import exact_dedup, langid, minhash, packing
from babelframe.llm import toxicity as toxic
from babelframe.llm.common import Stored, keep_rows, table, unused

#: A document stays if its bytes' labels favour one language by at least so much on average.
LEAST_LANGUAGE_SCORE = 0.35


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts have the score of a text without words and stay; repeated rows share their fate; a score of the
    threshold itself is rejected; rows without a doc_id are scored like others; without labels of both kinds all stay.
    """
    score, rejected = unused(docs.columns, "toxic_score", "toxic_predicted")
    scored = toxic.score(docs, toxic.train(docs, table(spark, sf_dir, "labels")), names=(score, rejected))
    return scored.where(F.col(rejected) == 0).drop(score, rejected)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that resemble none of the languages, go.

    So null and empty texts go here. Repeated rows share their fate; a score of the least value itself stays; if no row has both
    text and lang there is nothing to learn from and no document is recognised, so all go.
    """
    lang, score = unused(docs.columns, "lang_pred", "lang_score")
    found = langid.predict(docs, langid.train(docs), (lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null and empty are one text. A row without a doc_id stays only if no row with one has its text; of repeats of the row that
    stays (same doc_id and text), one stays, whichever its other columns.
    """
    return keep_rows(docs, Stored(spark).put(exact_dedup.exact_dedup(docs).select("doc_id", "text_sha256", "kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays.

    Null and empty are one text, a class of its own like any text without words. A row without a doc_id stays only if its class has
    none with one; of repeats of the row that stays, one stays; different texts under one doc_id are told apart.
    """
    return keep_rows(docs, Stored(spark).put(minhash.near_dedup(docs).select("doc_id", "text_sha256", "kept")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in sequences. A null or empty text is the separator alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Trained models and near-duplicate classes are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, docs = Stored(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
