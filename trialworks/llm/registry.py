"""Queries over the driver's tables, one per operator, with their DuckDB counterparts where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


EXACT_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bytes from documents),
k as (select bytes, count(*) as group_size, arg_min(doc_id, [-chars, doc_id]) as keep_id from d group by bytes)
select d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id as kept, sha256(d.bytes) as text_sha256 from d join k using (bytes)
"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chars")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.conversations import damaged, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations.select("conv_id"))


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.parsing import remove_passages

    return remove_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialworks.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from trialworks.llm.collocations import COLLOCATIONS_SQL
    from trialworks.llm.mixing import MIX_SQL
    from trialworks.llm.parsing import PASSAGES_SQL

    return {"op6_exact_dedup": EXACT_SQL, "op7_source_mixing": MIX_SQL.format(docs="documents"), "op12_passage_dedup": PASSAGES_SQL, "op13_phrase_collocations": COLLOCATIONS_SQL}
