"""Best-fit packing of token pieces into sequences of a fixed length, improved by swap-based local search.

Pieces are dealt into groups of bounded size by a hash of their keys; a task packs a group: best fit in decreasing length, then
moves, one-for-one and two-for-one exchanges between underfull bins, each of which increases the sum of squared fills, until
no exchange is left; emptied bins vanish. Bins that are still underfull are dissolved and packed again together with those of
other groups, round by round, so groups cost almost no bins.

Nulls: a null text is an empty document of one end id. An empty table gives no rows. Repeated rows are packed as rows of
their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.blocks import text_blocks, utf8
from tallyveil.llm.common import saved
from tallyveil.llm.tokens import encoder, space_led

CAPACITY = 1024
GROUP_ROWS = 4_000  # pieces that one task packs together
LOOSE = 0.03  # bins with more free room than this share are packed again with those of other groups
ROUNDS = 4


class Bins:
    """Bins of one group: best fit and local search on piece lengths."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self):
        """Longest pieces first, each into the bin with the least room that holds it."""
        by_room, rooms = defaultdict(list), 0  # bit r of rooms: some bin has r free
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            need = self.lengths[i]
            fits = rooms >> need
            if fits:
                room = need + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.free.append(room)
            self.items[b].append(i)
            self.free[b] = room - need
            if room > need:
                by_room[room - need].append(b)
                rooms |= 1 << (room - need)

    def local_search(self):
        """Exchange between underfull bins until no exchange increases the sum of squared fills."""
        under = [b for b in range(len(self.items)) if self.free[b]]
        reach: dict = defaultdict(set)  # length + free room -> (bin, piece or None for just the room)
        sums = 0

        def index(b, add):
            nonlocal sums
            for i in (*self.items[b], None):
                key = (self.lengths[i] if i is not None else 0) + self.free[b]
                if not key:
                    continue
                if add:
                    reach[key].add((b, i))
                    sums |= 1 << key
                else:
                    reach[key].discard((b, i))
                    if not reach[key]:
                        sums &= ~(1 << key)

        def partner(a, size):
            """Bin and piece to exchange for pieces of `size` from bin a: what leaves that bin with the least room."""
            left = sums >> size
            key = size - 1
            while left:
                step = (left & -left).bit_length()
                key += step
                left >>= step
                for b, i in reach[key]:
                    gain = size - (self.lengths[i] if i is not None else 0)
                    if b != a and gain > 0 and gain > self.free[b] - self.free[a]:
                        return b, i
            return None

        def improve(a):
            mine = self.items[a]
            options = [(i,) for i in mine] + [(mine[x], mine[y]) for x in range(len(mine)) for y in range(x)]
            for given in sorted(options, key=lambda g: -sum(self.lengths[i] for i in g)):
                size = sum(self.lengths[i] for i in given)
                found = partner(a, size) if size <= self.capacity else None
                if found:
                    b, back = found
                    index(a, False)
                    index(b, False)
                    for i in given:
                        self.items[a].remove(i)
                        self.items[b].append(i)
                    gain = size
                    if back is not None:
                        self.items[b].remove(back)
                        self.items[a].append(back)
                        gain -= self.lengths[back]
                    self.free[a] += gain
                    self.free[b] -= gain
                    for x in (a, b):
                        if self.free[x] and self.items[x]:
                            index(x, True)
                    return True
            return False

        for b in under:
            index(b, True)
        queue = sorted(under, key=lambda b: -self.free[b])
        while queue:
            again = []
            for a in queue:
                changed = False
                while self.items[a] and self.free[a] and improve(a):
                    changed = True
                if changed and self.items[a] and self.free[a]:
                    again.append(a)
            queue = again


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of piece numbers."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.local_search()
    return [b for b in bins.items if b]


def _pack_group(capacity: int, loose: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row", ignore_index=True)  # a task run again packs alike
        lengths = pdf["length"].tolist()
        bin_of, offset, settled = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for number, held in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in held:
                bin_of[i], offset[i], at = number, at, at + lengths[i]
            settled[held] = last or capacity - at <= loose
        group = int(pdf["__group"].iloc[0]) if len(pdf) else 0
        return pdf.assign(sequence_id=(group << 32) + bin_of, offset=offset, __settled=settled)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to `capacity`; all other columns stay.

    The rows are numbered and written once; only number and length take part in the packing and are joined back.
    """
    numbered = saved(items.withColumn("__row", F.monotonically_increasing_id()), "packing-items")
    rest = numbered.select("__row", F.col("length").cast("long").alias("length"))
    n, done = numbered.count(), []
    kind = "__row long, length long, __group int, sequence_id long, offset long, __settled boolean"
    for turn in range(ROUNDS):
        groups = max(1, -(-n // GROUP_ROWS))
        last = groups == 1 or turn == ROUNDS - 1
        dealt = rest.withColumn("__group", (F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(groups)) + F.lit(turn << 28)).cast("int"))
        packed = saved(dealt.groupBy("__group").applyInPandas(_pack_group(capacity, int(LOOSE * capacity), last), kind), "packing-round")
        done.append(packed.where("__settled"))
        rest = packed.where("NOT __settled").select("__row", "length")
        n = 0 if last else rest.count()
        if not n:
            break
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return numbered.join(placed.select("__row", "sequence_id", "offset"), "__row").drop("__row")


def _piece_task(vocabulary: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, space_led)
        for block in text_blocks(batches):
            ids, bounds = encode.ids(*utf8(block.column("text")), end_id)
            sizes = np.diff(bounds)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = sizes - (counts - 1) * capacity  # only the first piece of a document may be shorter
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            begin = bounds[:-1][row] + start
            crc = [zlib.crc32(ids[b:b + n]) for b, n in zip(begin.tolist(), length.tolist())]
            out = [block.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                offsets = np.append(begin, len(ids)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 and, unless left out, the ids."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_piece_task(vocabulary, end_id, capacity, keep_ids), schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence_id and gapless offset; tokenised once."""
    return pack(token_pieces(docs, vocabulary, end_id, capacity, keep_ids), capacity)
