"""Exact substring removal: bytes covered by a string of LENGTH bytes that also starts anywhere else.

1. Every string of LENGTH bytes belongs to the smallest hash among its windows of SEED_BYTES bytes; consecutive strings with
   the same one at the same place form a run. Equal strings have equal smallest hashes, so only runs whose hash recurs can hold repeats.
2. Runs are counted by content, so copies of a passage become one context with its number of occurrences.
3. A hash whose runs all have one content is decided by that number. The contexts of the others go to blocks by hash; in each
   block the Burrows-Wheeler transform of the contexts is built, and its intervals are extended backward breadth first. This
   yields the boundaries of common prefixes by increasing value; it stops at LENGTH, and what is still undivided repeats.
4. A hash with more than HOT contexts is not gathered in a block: its strings are counted one by one by hash, by all tasks.
5. Passages of over 50 words that another document holds too may be shorter than LENGTH and then stay. They are only counted:
   strings of WORDS words take part in steps 1 and 2 with windows of SEED_WORDS words, and what has several contents in step 4.

Positions are bytes of UTF-8. Nulls: a null or short text loses nothing; a null doc_id is a document. Repeated rows are
occurrences of their own, so they lose what they share. For step 5 rows with equal doc_id and text are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.blocks import BLOCK_BYTES, SEED, _powers, byte_hashes, mix, pieces, ragged, text_blocks, utf8, word_places
from tallyveil.llm.common import saved

LENGTH = 400
SEED_BYTES = 128
WORDS = 51
SEED_WORDS = 12
HOT = 2_000
END = 0xFF  # never a byte of UTF-8; closes each context


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def _sums(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial of the values, from which any string of them gets its hash."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), salt)[0], out=total[1:])
    return total


def _byte_sums(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return _sums(data.astype(np.uint64) + np.uint64(1), salt), offsets


def _word_sums(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Like bytes, with words as units: their prefix sums and the bounds of rows in them."""
    _, parts, bounds = word_places(data, offsets)
    return _sums(byte_hashes(parts, salt), salt), bounds


def string_runs(total: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Runs of strings of `length` units with one smallest hash among windows of `seed` units: (row, first start, number of starts, hash, content hash)."""
    units = len(total) - 1
    if units < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    down = _powers(units + 1)[1]
    window = length - seed + 1
    values = mix((total[seed:] - total[:-seed]) * down[:units - seed + 1])
    least = _window_minimum(values, window)
    begins = np.ones(len(least), bool)  # a run ends with its smallest window's first place, so a string and its shift differ in run
    begins[1:] = (least[1:] != least[:-1]) | (values[:len(least) - 1] == least[:-1])
    heads = offsets[:-1]
    begins[heads[heads < len(least)]] = True
    at = np.flatnonzero(begins)
    row = np.searchsorted(offsets, at, side="right") - 1
    stop = np.minimum(np.append(at[1:], len(least)), offsets[row + 1] - length + 1)  # strings end inside their row
    whole = stop > at
    at, row, stop = at[whole], row[whole], stop[whole]
    content = mix((total[stop + length - 1] - total[at]) * down[at] + (stop - at).astype(np.uint64) * SEED)
    return row, at - offsets[row], stop - at, least[at], content


def _runs_task(length: int, seed_bytes: int, words: int, seed_words: int):
    def run(batches):
        for block in text_blocks(batches):
            text = utf8(block.column("text"))
            for of_words, found in ((False, string_runs(*_byte_sums(*text), length, seed_bytes)), (True, string_runs(*_word_sums(*text), words, seed_words))):
                row, first, n, least, content = found
                if len(row):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([block.column("doc_id").take(at), block.column("text_hash").take(at), pa.array(np.full(len(row), of_words)), pa.array(first.astype(np.int32)),
                                                      pa.array(n.astype(np.int32)), pa.array(least.view(np.int64)), pa.array(content.view(np.int64))],
                                                     names=["doc_id", "text_hash", "words", "first", "n", "v", "content"])

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the cyclic text, sorted by at least their first `depth` bytes (prefix doubling from packed words)."""
    n = len(text)
    wide = np.concatenate([text, text[:8] if n >= 8 else np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k:k + n]
    done = 8
    while True:
        order = np.argsort(key)
        placed = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
        if done >= depth or rank[order[-1]] == n - 1:
            return order
        key = ((rank << 32) | np.concatenate([rank[done % n:], rank[:done % n]])).astype(np.uint64)
        done *= 2


def prefix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts and a class number for each: equal numbers share at least `length` bytes (cyclic text).

    Breadth-first backward extension: the intervals of all strings of k bytes that end at a boundary found last are extended by
    each byte before them; an interval whose right end is no boundary yet makes one, with common prefix k.
    """
    order, n = suffix_order(text, length), len(text)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # from a suffix to the one that begins a byte earlier
    step[by_byte] = np.arange(n)
    following = np.full(n, n, np.int64)  # next row with the same byte before it
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    places = before[by_byte].astype(np.int64) * (n + 1) + by_byte
    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    left, right = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        size = right - left + 1
        rows = ragged(left, size)
        owner = np.repeat(np.arange(len(left)), size)
        last = following[rows] > right[owner]  # one row for each byte before the interval
        rows, owner = rows[last], owner[last]
        end = step[rows]
        new = ~boundary[end + 1]
        rows, owner, end = rows[new], owner[new], end[new]
        if not len(rows):
            break
        boundary[end + 1] = True
        start, wide = end.copy(), np.flatnonzero(size[owner] > 1)
        start[wide] = np.searchsorted(places, before[rows[wide]].astype(np.int64) * (n + 1) + left[owner[wide]])
        left, right = start, end
    return order, np.cumsum(boundary[:n])


def repeated_starts(contexts: list, owned: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For all owned starts, context after context: does the string there occur at least twice, by weight?"""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    order, of_rank = prefix_classes(text, length)
    number = np.empty(len(text), np.int64)
    number[order] = of_rank
    starts = ragged(begins, owned)
    times = np.bincount(number[starts], weights=np.repeat(weight, owned))
    return times[number[starts]] >= 2


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[0::2], edges[1::2]


def _span_batch(v, content, counts, lo, hi) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    spans = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lo", "hi"])
    return pa.RecordBatch.from_arrays([v, content, pa.ListArray.from_arrays(offsets, spans)], names=["v", "content", "spans"])


def _block_task(length: int):
    def solve(table: pa.Table) -> pa.RecordBatch:
        owned, contexts = table["n"].to_numpy().astype(np.int64), table["bytes"].to_pylist()
        flags = repeated_starts(contexts, owned, table["times"].to_numpy(), length)
        ends = np.cumsum(owned)
        # a gap after each context keeps ranges inside it
        spaced = np.zeros(len(flags) + len(owned), bool)
        spaced[np.arange(len(flags)) + np.repeat(np.arange(len(owned)), owned)] = flags
        lo, hi = _ranges(spaced)
        base = ends - owned + np.arange(len(owned))
        which = np.searchsorted(base, lo, side="right") - 1
        return _span_batch(table["v"].combine_chunks(), table["content"].combine_chunks(), np.bincount(which, minlength=len(owned)), lo - base[which], hi - base[which])

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            while batch.num_rows:
                lengths = np.cumsum(np.diff(utf8(batch.column("bytes"))[1]))
                v = batch.column("v").to_numpy()
                turns = np.flatnonzero(np.diff(v)) + 1
                if waiting and size >= BLOCK_BYTES and waiting[-1].column("v")[-1].as_py() != v[0]:
                    yield solve(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                enough = turns[(turns > 0) & (size + lengths[np.minimum(turns, len(v)) - 1] >= BLOCK_BYTES)]
                stop = int(enough[0]) if len(enough) else batch.num_rows
                waiting.append(batch.slice(0, stop))
                size += int(lengths[stop - 1])
                batch = batch.slice(stop)
                if batch.num_rows:
                    yield solve(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return run


def _cut_task(length: int, words: int):
    """The bytes of the wanted runs of each text."""
    carried = ["words", "v", "content", "times", "low", "high", "n"]

    def run(batches):
        for block in text_blocks(batches):
            data, offsets = utf8(block.column("text"))
            wanted = block.column("wanted")
            row = np.repeat(np.arange(block.num_rows), np.diff(wanted.offsets.to_numpy()))
            runs = wanted.flatten()
            of_words = runs.field("words").to_numpy(zero_copy_only=False)
            first, n = runs.field("first").to_numpy().astype(np.int64), runs.field("n").to_numpy().astype(np.int64)
            start, size = offsets[row] + first, n + length - 1
            if of_words.any():
                at, parts, bounds = word_places(data, offsets)
                head = bounds[row[of_words]] + first[of_words]
                last = head + n[of_words] + words - 2
                start[of_words], size[of_words] = at[head], at[last] + np.diff(utf8(parts)[1])[last] - at[head]
            cut = pieces(data[ragged(start, size)], np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([*map(runs.field, carried), cut], names=[*carried, "bytes"])

    return run


def _gram_task(length: int, sums):
    """Every owned string of contexts as two hashes."""
    carried = ["v", "content", "times", "low", "high"]

    def run(batches):
        for batch in batches:
            for block in text_blocks(iter([batch]), "bytes"):
                data, offsets = utf8(block.column("bytes"))
                owned = block.column("n").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(owned)), owned)
                hashed = []
                for salt in (0, 1):
                    total, bounds = sums(data, offsets, salt)
                    starts = ragged(bounds[:-1], owned)
                    hashed.append(mix((total[starts + length] - total[starts]) * _powers(len(total), salt)[1][starts]).view(np.int64))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(block.column(c).take(at) for c in carried), pa.array((starts - bounds[row]).astype(np.int32)),
                                                  pa.array(hashed[0]), pa.array(hashed[1])], names=[*carried, "at", "g1", "g2"])

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH, seed_bytes: int = SEED_BYTES, hot: int = HOT, words: int = WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, text_hash, starts, word_starts: for each document with any the ranges [lo, hi) of starts of repeated strings, and
    in words those of strings of `words` words that another document holds too."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.octet_length("text") >= min(length, 2 * words - 1))
    runs = saved(hashed.mapInArrow(_runs_task(length, seed_bytes, words, seed_words), f"doc_id {kind}, text_hash long, words boolean, first int, n int, v long, content long"), "runs")
    # written before the join, so both sides are plain exchanges and Spark can split a hash with very many runs
    again = saved(runs.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "recurring-hashes")
    found = saved(runs.join(again, "v", "left_semi"), "recurring-runs")
    document = F.xxhash64("doc_id", "text_hash")
    contexts = saved(found.groupBy("words", "v", "content").agg(F.count("*").alias("times"), F.min(document).alias("low"), F.max(document).alias("high"),
                                                                F.min(F.struct("doc_id", "text_hash", "first", "n")).alias("where")), "contexts")
    kinds = contexts.groupBy("v").agg(F.count("*").alias("kinds"), F.min("low").alias("least"), F.max("high").alias("most"))
    judged = contexts.join(kinds, "v").where("not words or least != most")
    alone = judged.where("kinds = 1").select("words", "v", "content", F.array(F.struct(F.lit(0).alias("lo"), F.col("where.n").alias("hi"))).alias("spans"))
    wanted = judged.where("kinds > 1").select("where.doc_id", "where.text_hash", F.struct("words", "where.first", "where.n", "v", "content", "times", "low", "high").alias("run"))
    of_doc = wanted.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("run").alias("wanted"))

    cut = hashed.join(of_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", "wanted")
    bytes_of = saved(cut.mapInArrow(_cut_task(length, words), "words boolean, v long, content long, times long, low long, high long, n int, bytes binary").dropDuplicates(["words", "v", "content"]), "context-bytes")
    crowded = kinds.where(F.col("kinds") > hot).select("v")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span_kind = "v long, content long, spans array<struct<lo:int,hi:int>>"
    gram_kind = "v long, content long, times long, low long, high long, at int, g1 long, g2 long"
    of_bytes = bytes_of.where("not words")
    normal = of_bytes.join(crowded, "v", "left_anti").repartition(parts, "v").sortWithinPartitions("v", "content").mapInArrow(_block_task(length), span_kind)
    grams = of_bytes.join(crowded, "v", "left_semi").mapInArrow(_gram_task(length, _byte_sums), gram_kind)
    twice = grams.groupBy("g1", "g2").agg(F.sum("times").alias("all")).where("all > 1").select("g1", "g2")
    word_grams = bytes_of.where("words").mapInArrow(_gram_task(words, _word_sums), gram_kind)
    shared = word_grams.groupBy("g1", "g2").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least != most").select("g1", "g2")
    at = F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))).alias("spans")
    dense, passages = (g.join(some, ["g1", "g2"], "left_semi").groupBy("v", "content").agg(at) for g, some in ((grams, twice), (word_grams, shared)))
    solved = normal.unionByName(dense).withColumn("words", F.lit(False)).unionByName(passages.withColumn("words", F.lit(True)))
    spans = saved(alone.unionByName(solved).where("size(spans) > 0"), "repeated-spans")
    placed = found.join(spans, ["words", "v", "content"]).select("doc_id", "text_hash", "words", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("first")).alias("lo"), (s["hi"] + F.col("first")).alias("hi"))).alias("spans"))
    return placed.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list(F.when(~F.col("words"), F.col("spans")))).alias("starts"), F.flatten(F.collect_list(F.when(F.col("words"), F.col("spans")))).alias("word_starts"))


def removed_spans(starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by strings of `length` that begin in [start, stop)."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], np.maximum.accumulate(stops[order] + length - 1)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


def _spans_of_rows(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that `removed_spans` makes of the ranges of each row: row, begin, end."""
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    ranges, apart = column.flatten(), np.int64(1) << 40  # rows are far apart, so none reaches into the next
    lo, hi = removed_spans(*(ranges.field(c).to_numpy().astype(np.int64) + row * apart for c in ("lo", "hi")), length)
    row = lo // apart
    return row, lo - row * apart, hi - row * apart


def _remove_task(length: int, words: int):
    def run(batches):
        for block in text_blocks(batches):
            data, offsets = utf8(block.column("text"))
            rows = block.num_rows
            row, lo, hi = _spans_of_rows(block.column("starts"), length)
            held, first, stop = _spans_of_rows(block.column("word_starts"), words)
            bounds = np.searchsorted(row, np.arange(rows + 1))
            kept = []
            for r, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                mine = slice(bounds[r], bounds[r + 1])
                edges = [0, *np.stack([lo[mine], hi[mine]], axis=1).ravel().tolist(), end - start] if bounds[r] < bounds[r + 1] else [0, end - start]
                kept.append(b"".join(data[start + a:start + b].tobytes() for a, b in zip(edges[0::2], edges[1::2])))
            spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"]))
            shared = np.bincount(held, weights=stop - first, minlength=rows).astype(np.int64)
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(sizes), pa.array(sizes - np.fromiter(map(len, kept), np.int64, rows)), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                 spans, pa.array(kept, pa.binary()), pa.array(shared)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_shared_words"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed_bytes: int = SEED_BYTES, hot: int = HOT, words: int = WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs), kept (remaining bytes) and n_shared_words
    (words in strings of `words` words that another document holds too, removed or not) of each row."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    found = repeated_runs(docs, length, seed_bytes, hot, words, seed_words).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "starts", "word_starts")
    joined = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    return joined.select("doc_id", "text", "starts", "word_starts").mapInArrow(
        _remove_task(length, words), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, kept binary, n_shared_words long")
