"""From raw documents to a training mix, in stages over Parquet.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of documents; the last returns what the mix takes of each document.

In every stage rows are judged by their own text: rows that share a doc_id, null
included, are told apart by it, and extra columns stay.  Null and empty texts have no
language, so the first stage drops them; the others keep them.  Repeated rows are
one: of equal doc_id and text, the lines of both stay, and one row stays of the
group.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.llm import decontaminate, langid, lines, minhash, mixing
from spanline.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language (``und``) go."""
    return langid.accepted(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go out of the texts; a document stays even if nothing is left of it.  n_chars, if there, is counted anew."""
    done = lines.dedup(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by similarities of 0.8 or more."""
    return minhash.keep_one(docs, 80, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark passages go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.taken(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: SQL can't express a trained network, SimHash or edit distances of words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
