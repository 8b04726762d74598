"""A training corpus from `documents`: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendmart.llm import bpe, decontaminate, language, ngram_join, substrings
from spendmart.llm.shared import materialize, read, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; mixtures of languages stay. The model is trained on the labelled ones."""
    predicted = language.predict(docs.select(*COLUMNS), language.train(docs), keep=COLUMNS)
    return predicted.filter("lang_pred <> 'und'").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays; rows without an id stay.

    A document is an id and its text: rows that repeat both are one, texts that share an id are several."""
    docs = docs.select(*COLUMNS)
    printed = docs.filter("doc_id IS NOT NULL").withColumn("_fp", F.coalesce(F.xxhash64("text"), F.lit(0)))
    with scratch(spark) as keep:
        first = keep(_first_of_groups(printed.select("doc_id", "text", "_fp")), "first-of-group")
    kept = printed.join(first, ["doc_id", "_fp"], "left_semi")
    one = Window.partitionBy("doc_id", "_fp").orderBy("lang", "source", "n_chars")  # rows that repeat one document
    kept = kept.withColumn("_place", F.row_number().over(one)).filter("_place = 1").select(*COLUMNS)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def _first_of_groups(printed: DataFrame) -> DataFrame:
    """(doc_id, _fp) of the document that stays of each group of near copies; printed: doc_id, text, _fp."""
    # of texts that share an id each is a document: one keeps the id as its key, the others get keys from 2**62 on
    shared = printed.groupBy("doc_id").agg(F.min("_fp").alias("_low"), F.max("_fp").alias("_high")).filter("_low < _high")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", "_fp"), 2).bitwiseOR(F.lit(1 << 62))
    keyed = printed.join(shared.select("doc_id", "_low"), "doc_id", "left")
    keyed = keyed.withColumn("_key", F.when(F.col("_fp") > F.col("_low"), other).otherwise(F.col("doc_id")))
    keyed = materialize(keyed.select("_key", "doc_id", "text", "_fp"), "keyed")
    groups = ngram_join.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), width=5, percent=80)
    owners = keyed.filter(f"_key >= {1 << 62}").select("_key", F.col("doc_id").alias("_owner")).distinct()
    members = groups.select(F.col("doc_id").alias("_key"), "component_id").join(owners, "_key", "left")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.coalesce("_owner", "_key"), "_key")).alias("_first"))
    return keyed.select("_key", "doc_id", "_fp").join(least.select("_first._key"), "_key", "left_semi").select("doc_id", "_fp")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window that an earlier document holds are cut; the rest is joined by spaces."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS), width=50, keep=["lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    length = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", length.alias("n_chars"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows of 13 words cover a twentieth or more go."""
    found = decontaminate.benchmark_matches(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), width=13, keep=COLUMNS)
    return decontaminate.verdicts(found).filter(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by byte-level BPE, with digests of the ids and of the text decoded from them."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontamination", decontaminate_benchmark),
    ("tokens", encode),
]

# Language models, set similarity and merges have no SQL form; the stages are tested on planted cases
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
