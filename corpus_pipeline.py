"""From raw documents to training tokens: language, shared lines, near duplicates, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.llm import bpe, language, lines, mixing, neardup
from tabulant.llm.queries import word_tokenizer
from tabulant.storage import stored


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with spans in the languages learned from the labelled ones, however many languages share them.

    Texts that are null, without a letter or in scripts of no learned language go. A label that is given stays, also of a
    language that was not learned; the others get the language found. Repeated rows stay or go together, and other
    columns stay as they are, whatever their names.
    """
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    return language.accepted(docs, model, min_score=0.0)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more sources share, but for each line's first occurrence.

    Null texts stay null. Repeated rows share their lines' first occurrence; other columns stay as they are.
    """
    return lines.without_boilerplate(docs).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles.

    Texts that are null or without words are alike to nothing and stay; of repeated rows one stays.
    """
    return neardup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix by source weights reads them.

    Null is a source of its own, which sorts last. Texts without words are not read.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mix reads, once per reading, and a hash of the text they decode to.

    A null text counts as empty. Rows come one by one, so repeated ones are repeated; an empty table gives no rows.
    """
    both = bpe.round_trip(spark, word_tokenizer())(F.coalesce("text", F.lit(""))).alias("both")
    ids, decoded = F.col("both.ids"), F.sha2("both.decoded", 256).alias("decoded_sha256")
    encoded = docs.select("doc_id", "lang", "source", both)
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), decoded)


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", own_lines),
    ("near_dedup", distinct_documents),
    ("source_mix", source_mix),
    ("bpe", token_ids),
]

#: SQL has no way to learn and apply the language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
