"""The corpus pipeline: language, near-duplicates, repeated passages, mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import langid, mixing, pieces, simhash, substring
from traceloom.llm.common import save, small_batches, unpacked

#: No stage but the mix and the passages can be put in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter. A missing lang is filled with the prediction, and stays null if nothing was learned."""
    small_batches(spark)
    found = langid.identify(docs, carry=True)
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) | F.col("row.text").rlike(r"\p{L}"))
    lang = F.coalesce(F.col("row.lang"), F.expr(f"nullif(lang_pred, '{langid.UNKNOWN}')"))
    return found.select(*unpacked(docs.columns, lang=lang))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id: texts whose five-word shingles are alike by
    0.8 or more, and those that a chain of such texts joins."""
    small_batches(spark)
    return simhash.one_of_each(docs, size=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 35-word windows that stand elsewhere too; a text that loses nothing stays as it is. n_chars is
    the new text's; a text that loses all its words becomes empty and stays a row."""
    small_batches(spark)
    cut, same = substring.remove_repeats(docs, carry=True), F.col("n_removed") == 0
    text = F.when(same, F.col("row.text")).otherwise(F.col("kept"))
    new = {"text": text, "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return cut.select(*unpacked(docs.columns, **new))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every text, with the digests that show the round trip."""
    small_batches(spark)
    return pieces.encode_pieces(docs)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing sources", mix_sources), ("SentencePiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage{i}")
    return docs
