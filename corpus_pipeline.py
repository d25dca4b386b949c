"""A corpus pipeline of five stages over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on everything
its predecessor kept; all but the last return the columns of documents.
``run`` writes every stage's result as Parquet to the cluster's shared
folder and reads it back as the next one's input.

1. ``language_id``: documents without a letter, or whose trigrams no learned
   language explains (share below ``MIN_LANGUAGE``), go.
2. ``simhash_dedup``: one document of each near-duplicate group stays.
3. ``suffix_dedup``: byte strings of 50 or more that a smaller doc_id has as
   well are cut out; ``n_chars`` is counted anew; no row goes.
4. ``decontaminate``: documents that hold a benchmark passage go.
5. ``packing``: token ids in sequences of at most 2048 (one row per piece,
   with its ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, langid, packing, simhash, suffix_dedup
from concord.llm.common import fold, saved
from concord.llm.queries import tokenizer_file
from concord.session import read_table

MIN_LANGUAGE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    judged = langid.predict(docs, model)
    if not model.languages:            # nothing was learned: no ground to reject a text with letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_array_dedup),
    ("decontaminate", benchmark_decontamination),
    ("packing", pack),
]

# language models, fingerprints, suffix arrays and tokenizers are beyond SQL;
# tests/llm/test_pipeline.py holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
