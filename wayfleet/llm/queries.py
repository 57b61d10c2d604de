"""The registered queries of this package, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfleet.llm import bpe, chat, collocation, langid, minmaxhash, packing, permutation, pii, prefixtrie, quality, simhash, topk, urlgraph
from wayfleet.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_example(table(spark, sf_dir, "conversations")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmaxhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1,
    "op2_exact_top_k": op2,
    "op3_best_fit_packing": op3,
    "op4_language_id": op4,
    "op5_chat_formatting": op5,
    "op6_permutation_index": op6,
    "op7_byte_bpe": op7,
    "op8_quality_classifier": op8,
    "op9_url_filters": op9,
    "op10_simhash_near_duplicates": op10,
    "op11_minmax_near_duplicates": op11,
    "op12_collocations": op12,
    "op13_prefix_trie": op13,
}

ORACLES: dict[str, str] = {"op2_exact_top_k": topk.ORACLE, "op5_chat_formatting": chat.ORACLE,
                           "op11_minmax_near_duplicates": minmaxhash.ORACLE, "op12_collocations": collocation.ORACLE,
                           "op13_prefix_trie": prefixtrie.ORACLE}
