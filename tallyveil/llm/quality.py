"""Quality rules: word statistics of each text, and a hashed n-gram likelihood ratio of trusted text against the whole corpus.

Raw counts run over all documents; tasks add their n-grams into vectors, so what is shuffled is one vector for each task
whatever the words are. The number of buckets follows the amount of text, between LEAST_BUCKETS and MOST_BUCKETS, which
bounds the model's size. Trusted counts come from at most about FIT_DOCUMENTS labelled documents, chosen by hash: their ids are
a broadcast of known size, so no text is moved to meet its label. The threshold is exact and the same for any partitioning:
scores are whole millionths, and their counts over all held-out trusted documents are summed.

Nulls: a null text has no words; it fails the base rules. A null doc_id is kept as a row and never counts as labelled.
Repeated doc_ids are rows of their own; several labels of a doc_id count as the worst of them. Ties with the threshold pass.
Empty tables: no document, no result; no label, no threshold. Texts of any length are read whole, one block for a long text.
Other columns are carried along by `keep_good` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.blocks import BLANK, Parts, byte_hashes, lines, mix, per_row, text_blocks, utf8, words
from tallyveil.llm.common import discard, saved

LEAST_BUCKETS, MOST_BUCKETS = 1 << 18, 1 << 21
BUCKET_CHARS = 4096  # characters of text for each bucket, between those bounds
FIT_DOCUMENTS = 100_000  # labelled documents that the trusted counts come from, at most
MICRO = 1_000_000  # scores are kept as whole numbers of this part of one
SLAB = 1 << 8  # buckets in one shuffled row
PRIOR = 8.0  # occurrences added to observed and expected counts of a bucket
KEEP_TRUSTED = 0.995  # share of trusted documents that pass the base rules and must pass the threshold
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three words that its row has twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return covered
    inside = np.flatnonzero(rows[2:] == rows[:-2])
    size = int(ids.max()) + 1
    pair = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three ids no longer fit 63 bits: number the pairs
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[inside] * size + ids[inside + 2]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(key), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    at, key = inside[twin], key[twin]
    order = np.lexsort((rows[at], key))
    again = (key[order][1:] == key[order][:-1]) & (rows[at][order][1:] == rows[at][order][:-1])
    hit = np.zeros(len(at), bool)
    hit[order[1:][again]] = True
    hit[order[:-1][again]] = True
    for step in range(3):
        covered[at[hit] + step] = True
    return covered


def word_stats(data: np.ndarray, offsets: np.ndarray, found: Parts) -> dict[str, np.ndarray]:
    """The base columns of each row of a block."""
    n_words = np.diff(found.bounds)
    points = ~BLANK[data] & ((data & 0xC0) != 0x80)
    line, has_word = lines(data, offsets)
    line_rows = line.rows()[has_word]
    distinct = np.unique(line_rows * (len(line.distinct) + 1) + line.ids[has_word]) // (len(line.distinct) + 1)
    n = len(n_words)
    repeats = per_row(repeated_words(found.ids, found.rows()), found.bounds)
    return {
        "n_words": n_words, "word_chars": per_row(points, offsets), "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_rows, minlength=n) - np.bincount(distinct, minlength=n), "n_repeat_words": repeats,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words),
    }


def gram_buckets(found: Parts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a block, and the row of each."""
    hashed, rows = byte_hashes(found.distinct)[found.ids], found.rows()
    paired = rows[1:] == rows[:-1]
    pair = mix(hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:])[paired]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return (np.concatenate([hashed, pair]) >> shift).astype(np.int64), np.concatenate([rows, rows[1:][paired]])


def _count_task(batches, size: int):
    raw, trusted = np.zeros(size, np.int32), np.zeros(size, np.int32)  # a task reads far less than 2^31 words
    for block in text_blocks(batches):
        found, rows = gram_buckets(words(*utf8(block.column("text"))), size)
        flag = block.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        raw += np.bincount(found, minlength=size).astype(np.int32)
        if flag.any():
            trusted += np.bincount(found[flag[rows]], minlength=size).astype(np.int32)
    some = np.flatnonzero(raw.reshape(-1, SLAB).any(axis=1))
    if len(some):
        yield _slabs(some, raw.reshape(-1, SLAB)[some].ravel(), trusted.reshape(-1, SLAB)[some].ravel(), np.int32)


def _slabs(slab, raw, trusted, kind=np.int64) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(slab) + 1, dtype=np.int32) * SLAB)
    return pa.RecordBatch.from_arrays(
        [pa.array(slab.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(raw.astype(kind))), pa.ListArray.from_arrays(offsets, pa.array(trusted.astype(kind)))],
        names=["slab", "raw", "trusted"])


def _add_slabs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(SLAB, np.int64), np.zeros(SLAB, np.int64)
    for batch in batches:
        raw += batch.column("raw").flatten().to_numpy().reshape(-1, SLAB).sum(axis=0)
        trusted += batch.column("trusted").flatten().to_numpy().reshape(-1, SLAB).sum(axis=0)
    yield _slabs(np.array([key[0].as_py()]), raw, trusted)


def trusted_ids(labels: DataFrame, part: int) -> DataFrame:
    """doc_ids of one half of the trusted documents (quality 1, toxic 0): half 0 fits the ratios, half 1 sets the threshold."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return worst.where("quality = 1 AND toxic = 0").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).select(F.col("doc_id").alias("__good"))


def fitted_ids(labels: DataFrame) -> DataFrame:
    """About FIT_DOCUMENTS of the trusted documents that fit the ratios, or all of them where they are fewer."""
    good = trusted_ids(labels, 0)
    share = min(1.0, FIT_DOCUMENTS / max(good.count(), 1))
    place = F.pmod(F.xxhash64("__good", F.lit(1)), F.lit(1 << 20))
    return F.broadcast(good.where(place < int(share * (1 << 20)))) if share < 1 else F.broadcast(good)


def bucket_count(docs: DataFrame) -> int:
    """A power of two that follows the characters of all texts."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(chars // BUCKET_CHARS, 1).bit_length()))


def fit_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of each bucket: trusted documents against all documents.

    Two vectors of at most MOST_BUCKETS numbers reach the driver, whatever the corpus.
    """
    size = bucket_count(docs)
    flagged = docs.select("doc_id", "text").join(fitted_ids(labels), F.col("doc_id") == F.col("__good"), "left").select(
        "text", F.col("__good").isNotNull().alias("trusted"))
    kind = "slab int, raw array<{0}>, trusted array<{0}>"
    counted = flagged.mapInArrow(partial(_count_task, size=size), kind.format("int")).groupBy("slab").applyInArrow(_add_slabs, kind.format("long"))
    raw, trusted = np.zeros(size), np.zeros(size)
    for slab, some, good_some in zip(*counted.toArrow().to_pydict().values()):
        raw[slab * SLAB:(slab + 1) * SLAB], trusted[slab * SLAB:(slab + 1) * SLAB] = some, good_some
    expected = raw * (trusted.sum() / max(raw.sum(), 1.0))
    return np.log((trusted + PRIOR) / (expected + PRIOR)).astype(np.float32)


def judged_rows(model: np.ndarray, block: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Base statistics and the length-normalised score (in millionths) of each row."""
    data, offsets = utf8(block.column("text"))
    found = words(data, offsets)
    out = word_stats(data, offsets, found)
    buckets, rows = gram_buckets(found, len(model))
    grams = np.bincount(rows, minlength=block.num_rows)
    score = np.bincount(rows, weights=model[buckets], minlength=block.num_rows) / np.maximum(grams, 1)
    return out | {"micro": np.rint(score * MICRO).astype(np.int64)}


def score_documents(docs: DataFrame, weights) -> DataFrame:
    """doc_id, base statistics, micro: the mean log ratio of the text's n-grams in millionths (0 without words)."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        for block in text_blocks(batches):
            out = judged_rows(weights.value, block)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(v) for v in out.values()]], names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {STATS}, micro long")


def trusted_threshold(scores: DataFrame, labels: DataFrame) -> int | None:
    """The score that the share KEEP_TRUSTED of held-out trusted documents reaches, among those that pass the base rules.

    Exact: counts by thousandths first, then by millionths within the one that holds the place; a score lies within a few
    units, so either is a few thousand rows. Without any such document nothing is rejected.
    """
    held = scores.where("NOT base_failed").join(trusted_ids(labels, 1), F.col("doc_id") == F.col("__good"), "left_semi")
    counted = saved(held.groupBy("micro").agg(F.count("*").alias("n")), "trusted-scores")
    coarse = sorted(counted.groupBy(F.floor(F.col("micro") / 1000).alias("at")).agg(F.sum("n")).collect())
    total = sum(n for _, n in coarse)
    may_miss = total - math.ceil(KEEP_TRUSTED * total)  # documents that may lie below the threshold
    for at, n in coarse:
        if may_miss < n:
            for micro, some in sorted(tuple(r) for r in counted.where(F.floor(F.col("micro") / 1000) == at).collect()):
                if may_miss < some:
                    return micro
                may_miss -= some
        may_miss -= n
    return None


def _fit(docs: DataFrame, labels: DataFrame):
    """The broadcast model, the scores of all documents, and the threshold as a column condition's bound."""
    weights = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, labels))
    scores = saved(score_documents(docs, weights), "quality-scores")
    cut = trusted_threshold(scores, labels)
    return weights, scores, -(1 << 62) if cut is None else cut


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base statistics, score and `kept`: base rules and threshold passed."""
    _, scores, cut = _fit(docs, labels)
    return scores.withColumn("score", F.col("micro") / MICRO).withColumn("kept", ~F.col("base_failed") & (F.col("micro") >= F.lit(cut))).drop("micro")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns, filtered where they are read."""
    weights, scores, cut = _fit(docs, labels)
    discard(scores)

    def run(batches):
        for block in text_blocks(batches):
            out = judged_rows(weights.value, block)
            kept = block.filter(pa.array(~out["base_failed"] & (out["micro"] >= cut)))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
