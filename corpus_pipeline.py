"""From raw documents to packed training sequences: five stages, each one operator of ``telemetra.llm``.

Every stage takes all that its predecessor kept and is written as Parquet before the next begins. All but the last return the
columns of the documents they were given, unchanged; rows are carried whole, so a column of any name comes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemetra.llm import exact_dedup, langid, quality, queries, simhash
from telemetra.llm.tables import keep_rows, learnable, stored, table, tuned


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is determined; those without a letter (``und``) go."""
    tuned(spark)
    model = langid.train(docs.where(learnable("doc_id", 5, 0)))
    if not model.languages:                     # no usable label: only the letter check can tell
        model = langid.one_language()
    return langid.identify(_whole_rows(docs), model, ["__row"]).where(F.col("lang_pred") != langid.UNDETERMINED).select("__row.*")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base checks and are probably good."""
    tuned(spark)
    measured = quality.measure(docs, docs.columns)
    return quality.judge(measured, quality.fit(measured)).where("kept").select("__row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of equal texts."""
    tuned(spark)
    return keep_rows(docs, exact_dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each component of near-duplicates."""
    tuned(spark)
    return keep_rows(docs, simhash.near_duplicates(docs, shingle=4, distance=4))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 1024 tokens; one row per piece."""
    tuned(spark)
    return queries.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: Fingerprints, trained models and token ids are not expressible in SQL; the tests hold each stage, and run() as a whole, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
