"""A training corpus from `documents`: language ID, quality rules, line dedup, near-dedup, packing.

STAGES names the steps in order. Each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs; all
but the last return the columns of `documents` (n_chars follows the text).

All stages take whole texts of any length, further columns under any name, and
an empty table (which gives an empty one). Rows, not ids, are documents: repeated
rows are judged alike, and null ids are ids like any other. What a null or empty
text, a repeated row or a tie comes to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portlens.llm import langid, linededup, packing, quality, simhash
from portlens.llm.common import bounded_batches, read_table, stored
from portlens.llm.queries import VOCABULARY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Null and empty texts and texts without a letter are in none and go; a text
    in letters is always taken for the nearest learned language and stays. Null
    values of `lang` are not learned from. Without a labelled row nothing is
    learned and all documents go. Equal scores go to the language that sorts first.
    """
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs, langid.train_rows()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy.

    Null and empty texts have no words and go, by the rule on few words. A
    repeated row passes or goes with its copies. No rule compares documents, so
    there are no ties.
    """
    bounded_batches(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; no row goes.

    A line stays in the largest id that holds it, in all rows of that id; a null
    id is below every other. Null texts stay null, empty ones empty (both count as
    one empty line, too short to be shared), and a text may become empty.
    """
    bounded_batches(spark)
    out = linededup.dedup_lines(docs, min_chars=40, min_docs=5)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group.

    It is the row with the smallest id, a null id only if there is no other; of
    different texts under that id the one with the smallest hash, of equal rows
    one. Null, empty and blank texts have fingerprint zero and form one group.
    """
    bounded_batches(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens.

    A null or empty text is its closing id alone. Repeated rows are packed each
    for itself. Ties in length go by id, then by the text's hash. A text longer
    than a sequence is cut; each of its ids lies in exactly one piece.
    """
    bounded_batches(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: No SQL expresses these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
