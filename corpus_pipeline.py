"""A corpus from documents to training sequences, as stages that each write their result.

Each stage is a function of (spark, docs, sf_dir), reads what its predecessor kept, and returns the columns of
``documents``, with n_chars that fit the text; the last returns packed pieces.  STAGES can be run one by one, each
result written and read again; ``run`` does so in the shared folder.

In all stages a null or empty text is a document like any other (quality judges it by its statistics, which are 0; it
repeats nothing, resembles nothing, holds no personal data and packs as its closing id alone), null and repeated ids and
repeated rows are rows of their own unless a stage says otherwise, extra columns pass whatever their names, and an empty
table stays empty.  The order of the stages is given.  As lines go before documents are compared, what line dedup leaves
of a near copy may no longer resemble its model; it stays, without the lines that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import linededup, minhash, packing, pii, quality
from telemill.llm.queries import PII_KEY, vocabulary
from telemill.llm.workspace import materialise, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.7 or more)."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line of the corpus: equal ones unless blank, nearly equal ones
    from 20 bytes on.

    Earlier is by id (null at last), hash of the text and number of the line; of repeated rows the first keeps its lines.
    A text of which nothing is left becomes empty and stays.
    """
    return _counted(linededup.without_repeats(docs, equal=1).drop("n_lines", "n_repeats"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates, by id (null at last) and hash of the text; ties are repeated rows."""
    return minhash.representatives(docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; a null text stays null."""
    return _counted(pii.pseudonymise(docs, PII_KEY).drop("pii"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token sequences: a row for each piece."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_trees", good_quality),
    ("line_dedup", without_repeated_lines),
    ("minhash_dedup", one_of_each_group),
    ("pseudonyms", pseudonymised),
    ("best_fit_packing", packed),
]

#: SQL can't express boosted trees, the edit join, Feistel permutations or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
