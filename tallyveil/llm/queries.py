"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm import arrow_stream, conversations, html_extract, importance, line_dedup, lsh_forest, merkle, mixing, packing, pii, quality, suffix_dedup, url_trust
from tallyveil.llm.common import table
from tallyveil.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: the folder TOKENIZERS names, else the installed package's."""
    if os.environ.get("TOKENIZERS"):
        return os.path.join(os.environ["TOKENIZERS"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


# Target shares of tokens; what the named values leave goes to all others together. Where that is nothing, the others keep
# their observed share.
SOURCE_SHARES = {f"src{i}": 0.05 for i in range(20)}
LANG_SHARES = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}
TOPIC_SHARES = {"prose": 0.55, "long": 0.44}


@query("op1_raked_mixing")
def op1(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), SOURCE_SHARES, LANG_SHARES, TOPIC_SHARES)
    return mixed.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").cast("long").alias("tokens"),
                        F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2, keep_ids=False)


@query("op6_arrow_sequences")
def op6(spark, sf_dir):
    folder = scratch_path(spark, "sequences")
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = arrow_stream.write_sequences(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), 1)
    return arrow_stream.read_documents(spark, folder, manifest)


@query("op9_quality_ratio")
def op9(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


@query("op7_line_dedup", r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position
  FROM documents),
keyed AS (
  SELECT doc_id, line, position, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.position, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    lines = line_dedup.text_lines(F.col("text"))
    kept = F.when(F.col("__dropped") > 0, F.array_join(line_dedup.kept_lines(lines, F.col("__runs")), "\n")).otherwise(F.coalesce("text", F.lit("")))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


@query("op10_lsh_forest")
def op10(spark, sf_dir):
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_url_trust")
def op4(spark, sf_dir):
    judged = url_trust.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


@query("op8_merkle_fingerprints")
def op8(spark, sf_dir):
    beside = merkle.against_next(table(spark, sf_dir, "documents"))
    mine, edited, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return beside.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                         merkle.likeness(mine, edited).alias("near_edited"), merkle.likeness(mine, following).alias("near_next"))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"), "n_shared_words")


@query("op5_pii_boosting")
def op5(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op13_importance_resampling")
def op13(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(rows, conversations.damage(rows))


@query("op12_html_extraction")
def op12(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))
