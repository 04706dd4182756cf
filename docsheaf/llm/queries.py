"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsheaf.llm import alignment, decontaminate, langid, neardup, packing, pieces, pii, quality, secrets, substrings, tokens, trie, warc
from docsheaf.llm.common import table


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op6_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: For this query alone: pseudonyms made with a key that anybody can read are no protection.
DEMO_KEY = b"docsheaf demonstration key"


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), DEMO_KEY)


def op10_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("path")


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links_report(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_archive,
        op2_order_minhash,
        op3_secret_scan,
        op4_spaced_seed_decontamination,
        op5_debruijn_repeats,
        op6_ecoc_language,
        op7_host_rules,
        op8_binary_packing,
        op9_feistel_pseudonyms,
        op10_prefix_tokens,
        op11_conversation_trie,
        op12_lockstep_alignment,
        op13_sentencepiece,
    )
}
ORACLES = {"op1_warc_archive": warc.ORACLE, "op3_secret_scan": secrets.ORACLE, "op4_spaced_seed_decontamination": decontaminate.ORACLE, "op7_host_rules": quality.ORACLE, "op11_conversation_trie": trie.ORACLE}
