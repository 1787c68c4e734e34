"""Line deduplication: lines found in several documents stay only in the document with the largest doc_id.

Hashes of lines (128 bits, no text) are range-partitioned with a secondary sort by document and position; first occurrences
stream out of the sorted ranges and give each hash its number of documents and its keeper. A hash is dealt by document over as
many shards as there are shuffle partitions, so a line in a third of all documents is sorted by all tasks; the shards' first
occurrences are then combined. Texts are split and hashed once: the hashes are written, read by the range sort and the lookup of
shared keys, and deleted.
The result is a run-length-compressed keep bitmap for each document that loses lines; texts are not shuffled for it.

Nulls: a null or empty text is one empty line and loses nothing. A null doc_id counts as one document below all others.
Repeated rows of a doc_id are one document, rows of a doc_id with different texts too. Keys shorter than `min_chars` code points
never count. Texts of any length are split whole; an empty table gives no rows; all columns of the documents are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.llm.common import carrying, discard, saved

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SHARDS = 16  # least number of shards of a key
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, position, h1, h2 of each line whose key is long enough."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("position", "line"))
    key = F.translate(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)
    keyed = split.select("doc_id", "text_hash", "position", key.alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def shared_keys(hashes: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """h1, h2, keeper of each key found in at least `min_documents` documents."""
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hashes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(max(SHARDS, parts))))
    ranged = dealt.repartitionByRange(parts, "h1", "h2", "shard")
    stream = W.partitionBy("h1", "h2", "shard").orderBy(F.desc_nulls_last("doc_id"), "position")
    before = F.lag("doc_id").over(stream)
    marked = ranged.select("h1", "h2", "shard", "doc_id", ((F.row_number().over(stream) == 1) | ~before.eqNullSafe(F.col("doc_id"))).alias("first"))
    heads = marked.where("first").groupBy("h1", "h2", "shard").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    return heads.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= min_documents).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, text_hash, n_dropped, dropped_runs of each document that loses lines.

    `dropped_runs` is the keep bitmap, run-length-compressed: sorted (first, lines) runs of zeros; all other bits are one.
    """
    hashes = saved(line_hashes(docs, min_chars), "line-hashes")
    keys = saved(shared_keys(hashes, min_documents), "shared-keys")  # so Spark can split a key with very many lines
    lost = hashes.join(keys, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "text_hash", "position").distinct()
    own = W.partitionBy("doc_id", "text_hash").orderBy("position")
    runs = lost.withColumn("island", F.col("position") - F.row_number().over(own)).groupBy("doc_id", "text_hash", "island").agg(
        F.min("position").alias("first"), F.count("*").cast("int").alias("lines"))
    bitmaps = runs.groupBy("doc_id", "text_hash").agg(F.sum("lines").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("first", "lines"))).alias("dropped_runs"))
    bitmaps = saved(bitmaps, "keep-bitmaps")
    discard(hashes, keys)
    return bitmaps


def kept_lines(lines, runs):
    """The lines outside the sorted runs (null: none dropped), as an expression."""
    none = F.array().cast("array<struct<first:int,lines:int>>")
    runs = F.coalesce(runs, none)
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["first"] + r["lines"]))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    spans = F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), (e - b).alias("n")))
    return F.flatten(F.transform(F.filter(spans, lambda s: s["n"] > 0), lambda s: F.slice(lines, s["b"] + 1, s["n"])))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of the documents and __dropped, __runs (0 and null where nothing is dropped)."""
    found = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("n_dropped").alias("__dropped"), F.col("dropped_runs").alias("__runs"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    return joined.drop("__id", "__hash").withColumn("__dropped", F.coalesce("__dropped", F.lit(0)))


@carrying
def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents without their dropped lines; an n_chars column follows the text. Untouched texts stay as they are."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_documents))
    touched = F.col("__dropped") > 0
    out = joined.withColumn("text", F.when(touched, F.array_join(kept_lines(text_lines(F.col("text")), F.col("__runs")), "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(touched, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
