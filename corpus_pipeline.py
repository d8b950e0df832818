"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialworks.llm.exact import keep_best, keep_rows
from trialworks.llm.language import fit_languages, has_letter, predict_language
from trialworks.llm.minhash import near_duplicates
from trialworks.llm.mixing import file_order, from_files, in_mixed_order, weights_of_order
from trialworks.llm.packing import pack
from trialworks.storage import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: those without text or letter, and those that the classifier places
    less surely than its cut, which labelled documents set such that it is half as far above chance as the least sure of
    them. A missing language is filled with the predicted one.

    Where no labelled document can be learned from, nothing is predicted: all texts with a letter stay as they are. Repeated
    rows and all columns stay, texts of any length are read whole, an empty table gives an empty result.
    """
    model = fit_languages(docs)
    if model is None:
        return docs.where(has_letter(F.col("text")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict_language(F.col("text"), model).alias("found"))
    kept = rows.where((F.col("found.lang") != "und") & (F.col("found.score") >= model.cut))
    return kept.select(F.col("row").withField("lang", F.coalesce("row.lang", "found.lang")).alias("row")).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then the one of the least id; null counts as empty. One
    row of a group stays, also where ids repeat or are null. All columns stay, an empty table gives an empty result."""
    return keep_best(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id (five-word shingles, similarity 0.8, whole
    texts). Texts without a word, null ones and rows without an id have no near copy and stay. All columns stay, an empty
    table gives an empty result."""
    return keep_rows(docs, near_duplicates(docs, k=5, percent=80).where("kept").select("doc_id"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order that interleaves the sources to their target weights; a null source is a source of its own,
    null texts count as empty, repeated rows and all columns stay, an empty table gives an empty result."""
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None, **options) -> DataFrame:
    """The pieces of every document in full sequences of 4096 tokens.

    Rows are taken in the order of the files that they are read from, as the mixing stage has written them, and windows are
    filled to the weights that this order shows (:func:`weights_of_order`), each source's queue in its order; ``weights``
    (source, weight) replaces them. Rows that come from no files have no order: they are put in the mixed one first.
    """
    if not from_files(docs):
        docs = written(in_mixed_order(docs, weights=weights), "mixed")
    rows, slot, place = file_order(docs)
    shares: dict[str, float] = {}
    if weights is None:
        shares = weights_of_order(rows, place)
    else:
        for r in weights.collect():  # a row per source
            shares[r.source or ""] = shares.get(r.source or "", 0.0) + r.weight
    total = sum(shares.values())
    shares = {s: w / total for s, w in shares.items()} if total > 0 else {}
    return pack(rows, public_tokenizers.path("word_bpe_49k.json"), shares=shares, order=(slot, place), **options)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: SQL expresses neither the first stage nor the last; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
