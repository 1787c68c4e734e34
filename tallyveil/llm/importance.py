"""Resampling documents towards a target corpus: gains of hashed word and word-pair buckets, and a draw with Gumbel keys.

Words are found by an Aho-Corasick automaton whose keys are words between two delimiters. A key's payload is the word's CRC,
the CRC of the word after a space, and its length; payloads of adjacent words compose to the CRC of the pair, so no pair is
ever spelt out. The dictionary grows with the words that a Python worker meets, up to DICTIONARY of them; words beyond that
get their payload from their bytes, with the same result. Both passes (counting and scoring) run over all texts; what is
shuffled for the counts is one number for each bucket and task.

Nulls: a null or empty text has no words, weight 0 and is not eligible. A null doc_id is hashed as the empty string. Empty
tables: without documents the result is empty; without target texts all gains come from the documents alone. Very long texts
are blocks of their own. Ties of the score go to the smaller doc_id (null first); rows that share score and doc_id are ranked
one after the other. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.llm.blocks import per_row, text_blocks, utf8
from tallyveil.llm.common import saved

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
DICTIONARY = 1 << 16  # words of the automaton of one Python worker
LONGEST = 48  # bytes of a word in the dictionary; CRC shifts are tabled up to here

_BYTES = np.arange(256)
_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_NORMAL = np.where(_WORD, np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES), 0x20).astype(np.uint8)


def _shifts(longest: int) -> np.ndarray:
    """[length, byte place, byte] -> the CRC's change when `length` zero bytes follow."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


_SHIFT = _shifts(LONGEST + 1)


class Words:
    """Payloads of words: found by the automaton, or computed and learned."""

    def __init__(self, limit: int = DICTIONARY):
        self.limit, self.place, self.compiled, self.pending = limit, {}, 0, []
        self.crc, self.spaced, self.length = (np.zeros(1024, kind) for kind in (np.uint32, np.uint32, np.int64))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def _learn(self, word: bytes) -> int:
        at = self.place[word] = len(self.place)
        if at == len(self.crc):
            self.crc, self.spaced, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.crc, self.spaced, self.length))
        self.crc[at], self.spaced[at], self.length[at] = zlib.crc32(word), zlib.crc32(b" " + word), len(word)
        self.pending.append((word, at))
        return at

    def _compile(self) -> None:
        """Add what was learned once it is a good part of the dictionary, so that all rebuilding together stays linear."""
        if len(self.pending) < max(512, self.compiled // 2) and not (self.pending and len(self.place) == self.limit):
            return
        for word, at in self.pending:
            self.automaton.add_word(f" {word.decode('latin-1')} ", at)
        self.automaton.make_automaton()
        self.compiled, self.pending = len(self.place), []

    def payloads(self, hay: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, CRC after a space, and length of each word of a delimited byte string."""
        found, raw = np.full(len(starts), -1, np.int64), hay.tobytes()
        if self.compiled and len(starts):
            met = np.fromiter(chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64)
            found[np.searchsorted(ends, met[0::2])] = met[1::2]
        new: list[tuple[int, int, int, int]] = []
        for i in np.flatnonzero(found < 0).tolist():
            word = raw[starts[i]:ends[i]]
            at = self.place.get(word)
            if at is None and len(self.place) < self.limit and len(word) <= LONGEST:
                at = self._learn(word)
            if at is None:
                new.append((i, zlib.crc32(word), zlib.crc32(b" " + word), len(word)))
            else:
                found[i] = at
        crc, spaced, length = self.crc[found], self.spaced[found], self.length[found]
        if new:
            at, *values = (np.array(v, np.int64) for v in zip(*new))
            crc[at], spaced[at], length[at] = values
        self._compile()
        return crc, spaced, length


def pair_crcs(left: np.ndarray, spaced: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of `left + space + right`, from the CRC of the left word and the payload of the right one."""
    n = length + 1
    out = np.zeros(len(left), np.uint32)
    short = n <= LONGEST + 1
    a, size = left[short], n[short]
    for k in range(4):
        out[short] ^= _SHIFT[size, k, (a >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(~short).tolist():
        out[i] = zlib.crc32(bytes(int(n[i])), int(left[i])) ^ zlib.crc32(bytes(int(n[i])))
    return out ^ spaced


_MET = Words()  # of this Python worker


def buckets(column: pa.Array, known: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and adjacent pairs of a text column, the row of each, and the words of each row."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    hay = np.append(np.insert(_NORMAL[data], offsets[:-1], 0x20), np.uint8(0x20))
    solid = hay != 0x20
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(~solid[1:] & solid[:-1]) + 1
    bounds = np.searchsorted(starts, np.append(offsets[:-1] + np.arange(rows), len(hay)))
    crc, spaced, length = (known or _MET).payloads(hay, starts, ends)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs = pair_crcs(crc[inside], spaced[inside + 1], length[inside + 1])
    return np.concatenate([crc, pairs]).astype(np.int64) % BUCKETS, np.concatenate([row, row[inside]]), np.diff(bounds)


def _count_task(batches):
    total = np.zeros(BUCKETS, np.int64)
    for block in text_blocks(batches):
        total += np.bincount(buckets(block.column("text"))[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; BUCKETS numbers at most reach the driver."""
    counted = texts.select("text").mapInArrow(_count_task, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted:
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket, target against corpus, both smoothed by 1."""
    all_corpus, all_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(docs), bucket_counts(target)))

    def run(batches):
        table = gains.value
        for block in text_blocks(batches):
            found, row, words = buckets(block.column("text"))
            n = np.bincount(row, minlength=block.num_rows)
            order = np.argsort(row, kind="stable")
            sums = per_row(table[found[order]], np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(words), pa.array(n), pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; the rank is null unless the document is drawn.

    Scores are whole numbers of a few ten thousand values whatever the corpus, so their counts are a small table: it tells
    the lowest drawn score and how many documents lie above each score. Only documents of equal score are sorted together.
    """
    hexed = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(hexed, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = saved(score_documents(docs, target).withColumn("score", F.col("weight") + noise), "importance-scores")
    eligible = F.col("n_words") >= MIN_WORDS
    above = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    counted = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    places = counted.select("score", F.lit(True).alias("fit"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    draw = scored.where(eligible).count() * percent // 100
    within = F.row_number().over(W.partitionBy("score", "fit").orderBy("doc_id"))
    ranked = scored.withColumn("fit", eligible).join(F.broadcast(places), ["score", "fit"], "left")
    rank = F.when(F.col("fit") & (F.col("above") < draw), F.col("above") + within)
    return ranked.withColumn("rank", rank).select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank"))
