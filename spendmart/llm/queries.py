"""The registered queries of this subpackage: each applies an operator to its whole table and returns the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spendmart.llm import bpe, decontaminate, hosts, language, licenses, ngram_join, periodic, permutation_index, prefix_trie, quality, substrings, token_files, toxicity
from spendmart.llm.shared import crc_fold, identified, materialize, read

QUERIES, ORACLES = {}, {}
RULES = [
    hosts.Rule("allow", "org/"),
    hosts.Rule("block", "example.org/es/"),
    hosts.Rule("block", "example.org/en/1"),
    hosts.Rule("allow", "com/fr/"),
    hosts.Rule("block", "com/de/"),
]


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op4_substring_dedup(spark, sf):
    docs = identified(read(spark, sf, "documents"))
    return substrings.remove_repeats(docs, width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_ngram_jaccard(spark, sf):
    docs = identified(read(spark, sf, "documents"))
    return ngram_join.near_duplicates(docs, width=3, percent=90)


@query
def op8_decontamination(spark, sf):
    docs = identified(read(spark, sf, "documents"))
    found = decontaminate.verdicts(decontaminate.benchmark_matches(docs, read(spark, sf, "benchmark"), width=13))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op9_byte_bpe(spark, sf):
    docs = identified(read(spark, sf, "documents"))
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op1_token_files(spark, sf):
    docs = identified(read(spark, sf, "documents"))
    segments = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_documents(segments)


@query
def op2_language_mixture(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("fold", crc_fold("doc_id", 4))
    model = language.train(docs.filter("fold <> 2"))
    predicted = language.predict(docs.withColumn("held_out", F.coalesce(F.col("fold") == 2, F.lit(False))), model, keep=["doc_id", "held_out"])
    return predicted.select("doc_id", "held_out", "lang_pred", "score", "shares")


@query
def op3_host_reputation(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", "url")
    # a page shows the document its path ends in; its labels tell whether it turned out bad
    labels = read(spark, sf, "labels").filter("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id")
    labels = labels.agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    shown = pages.select(hosts.host_of(F.col("url")).alias("host"), F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/(\\d+)', 1) AS BIGINT)").alias("doc_id"))
    return hosts.judge(pages, shown.join(labels, "doc_id").select("host", "bad"), RULES)


@query
def op5_toxicity(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text").withColumn("fold", crc_fold("doc_id", 5))
    learned = docs.filter("fold <> 0").select("doc_id", "text")
    labels = read(spark, sf, "labels").filter(crc_fold("doc_id", 5) != 0)
    model = toxicity.train(learned, labels)
    return toxicity.score(docs.withColumn("held_out", F.coalesce(F.col("fold") == 0, F.lit(False))), model, keep=["doc_id", "held_out"])


@query
def op7_license_scan(spark, sf):
    return licenses.license_blocks(identified(read(spark, sf, "documents")))


@query
def op10_permutation_index(spark, sf):
    return permutation_index.search(read(spark, sf, "embeddings"), "vec_id % 20 = 0", best=20)


@query
def op11_quality(spark, sf):
    docs = identified(read(spark, sf, "documents"))
    docs = docs.withColumn("held_out", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)))
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(docs, labels, learn="NOT held_out", threshold=0.3, keep=["doc_id", "held_out"])


# A tenth of the documents is made periodic from word a on: its p words from there, again and again, to the old length
LOOPED = r"""
    CASE WHEN h % 10 = 0 AND size(w) > 0 THEN
        array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((size(w) - a) / p) AS INT)))), 1, size(w)), ' ')
    ELSE text END
"""


@query
def op13_periodic_runs(spark, sf):
    docs = identified(read(spark, sf, "documents")).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("w", F.expr(r"CASE WHEN h % 10 = 0 THEN array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '') END"))
    docs = docs.withColumn("a", F.expr("CAST((h DIV 10) % nullif(size(w), 0) AS INT)"))
    docs = docs.withColumn("p", F.expr("CAST(1 + (size(w) - a) DIV (3 + (h DIV 10) % 8) AS INT)"))
    found = periodic.periodic_runs(docs.select("doc_id", F.expr(LOOPED).alias("text")), exponent=4, least=6)
    # exact comparison of length / period; the first in order wins a tie
    found = found.withColumn("best", F.expr("aggregate(runs, get(runs, 0), (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def branched(blocks, heads=100, longest=6):
    """Conversations that begin with the first turns of another: conversation c takes crc32(c) % longest turns of c - c % heads, then its own after as many."""
    base = blocks.filter(f"conv_id % {heads} = 0 AND before < {longest - 1}").select(F.col("conv_id").alias("base"), "before", F.slice("turns", 1, longest - 1).alias("head"))
    base = base.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("before", "head"))).alias("h"))
    base = base.select("base", F.slice(F.flatten(F.col("h.head")), 1, longest - 1).alias("head"))
    own = blocks.withColumn("base", F.expr(f"conv_id - conv_id % {heads}")).withColumn("k", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int"))
    own = own.join(base, "base", "left").withColumn("lead", F.expr("coalesce(slice(head, 1, k), array())"))
    rest = F.expr("slice(turns, CAST(greatest(0, k - before) AS INT) + 1, size(turns))")
    start = F.expr("CASE WHEN before = 0 THEN 0L ELSE greatest(before, k) - k + size(lead) END")
    return own.select("conv_id", start.alias("start"), F.when(F.col("before") == 0, F.concat("lead", rest)).otherwise(rest).alias("turns"), "whole")


@query
def op12_prefix_trie(spark, sf):
    blocks = materialize(prefix_trie.turn_blocks(read(spark, sf, "conversations")), "turn-blocks")
    return prefix_trie.prefix_nodes(branched(blocks))
