"""Corpus pipeline over ``documents``: STAGES of (name, function), each calling one operator of ``cohortwise.llm``.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. Every stage decides over all rows that
its predecessor kept:

1. language ID, learned on the labelled rows of the training folds; rows
   that it rejects go,
2. line dedup; texts lose their repeated long lines,
3. SimHash near-dedup; the smallest doc_id of each group stays,
4. benchmark decontamination; documents that leak an item of five words or
   more go,
5. mixing; documents get the words that the mix takes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import decontaminate, language_id, line_dedup, mixing, simhash
from cohortwise.llm.common import free_name, materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judge = language_id.learn(language_id.training_rows(docs))
    names = tuple(free_name(docs, n) for n in ("lang_pred", "score", "cross_entropy", "rejected"))
    return language_id.predict(docs, judge, names).where(~F.col(names[3])).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(docs).select(*docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "hits")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), name)
    # the few words of a short item stand in clean texts too
    leaked = F.exists(name, lambda hit: hit["n_matches"] >= decontaminate.MIN_ITEM_WORDS)
    return found.where(~leaked).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized, size = mixing.with_size(docs)
    return mixing.mix(sized, size)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
]
#: Language models, alignment and the seeded selection have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
