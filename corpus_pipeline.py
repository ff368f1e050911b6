"""A training-data pipeline over ``documents``, from raw rows to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terragrain.llm import dedup, jaccard, langid, mixing, packing
from terragrain.llm.common import keep, scratch, ship
from terragrain.llm.entry import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told.

    Those are null and empty texts, texts without a letter, and texts that are long enough to tell
    that they have too few n-grams of any learnt language. Short texts with little evidence stay.
    Rows without doc_id, repeated rows and ties are judged by their text alone; where no row has a
    lang, none stays; all columns, whatever their names, stay as they are; an empty table stays empty.
    """
    ship(spark)
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, the one with the smallest doc_id (null last).

    A null text equals an empty one; of rows with one doc_id and text any one stays; all columns,
    whatever their names, stay as they are; an empty table stays empty.
    """
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id (null last).

    Null and empty texts are similar to nothing and stay; of rows with one doc_id, or none, in a group
    any one stays; all columns, whatever their names, stay as they are; an empty table stays empty.
    """
    ship(spark)
    return jaccard.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the documents to the sources' target weights; a document that is taken twice is there twice.

    A null source is a source of its own, a null text has no words and goes with its place in the
    shuffle; repeated rows are taken alike; ties in finish time go by source, round and key; all
    columns, whatever their names, stay as they are; an empty table stays empty.
    """
    return mixing.draw_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences: one row per piece, with its place and its token ids' checksum.

    A null text is empty and leaves its end id; repeated rows and rows without doc_id are packed each;
    other columns take no part; an empty table gives no sequences.
    """
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL can express neither the language filters nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):  # a stage's tables go once the next one has been written
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline-packed")
