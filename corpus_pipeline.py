"""From raw documents to token ids: quality rules, near-duplicates, decontamination, mixing, output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm import decision_list, decontaminate, mixing, order_minhash, token_store
from veritab.llm.common import cut, new_path, table
from veritab.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rules and the learned list. A null or empty text fails; a null doc_id stays a row, as do
    repeated rows; other columns are carried, whatever their names. An empty table gives an empty one."""
    rules = decision_list.learn(decision_list.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    return decision_list.keep_good(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of its least doc_id, and the rows with a null doc_id. Null texts are
    empty, and copies of each other; of repeated rows one stays. An empty table gives an empty one."""
    return order_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item. Null and empty texts hold none; a null doc_id and repeated rows stay as they
    are. An empty table or benchmark drops nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and its own draw say, in random order. A null source is one of its own; a null
    doc_id draws by its text; repeated rows draw alike. An empty table gives an empty one."""
    return mixing.mix(docs, name=None)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the token ids of all rows in the order in which mixing left them, and reads them back: doc_id, start, n_tokens,
    ids_crc32. A null text has the end id only; a null doc_id and repeated rows are stored. An empty table gives none."""
    path, place = new_path(spark, "corpus"), "place"
    while place in docs.columns:
        place += "_"
    token_store.write(docs.withColumn(place, F.monotonically_increasing_id()), path, tokenizer_file("byte_bpe_50k.json"), end_id=2, order=[place])
    return token_store.read(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The rules are learned and links are found by alignment: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
