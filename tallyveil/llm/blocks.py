"""Texts of Arrow batches as flat byte arrays, and their words and lines, without a Python object per character or word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20  # text handled at once inside a task; a longer single text is a block of its own

_BYTES = np.arange(256)
BLANK = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SEED = np.uint64(0x9E3779B97F4A7C15)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about `limit` bytes of text each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its rows in them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, starts: np.ndarray, end: int | None = None) -> pa.Array:
    """Binary array of the gapless pieces of `data` that begin at `starts`."""
    offsets = np.append(starts, len(data) if end is None else end).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Parts:
    """Words or lines of a block: `ids` index `distinct`; those of row r are ids[bounds[r]:bounds[r + 1]]."""

    ids: np.ndarray
    distinct: pa.Array
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def encoded(parts: pa.Array, bounds: np.ndarray) -> Parts:
    if len(parts) == 0:
        return Parts(np.zeros(0, np.int64), pa.array([], pa.binary()), bounds)
    coded = parts.dictionary_encode()
    return Parts(coded.indices.to_numpy().astype(np.int64), coded.dictionary, bounds)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """First bytes of the words (runs of bytes other than ASCII white space, never across rows), the words, and the bounds of rows in them."""
    keep = ~BLANK[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = keep[heads]
    at = np.flatnonzero(first)
    place = np.cumsum(keep) - 1
    return at, pieces(data[keep], place[at]), np.searchsorted(at, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> Parts:
    """Runs of bytes other than ASCII white space; a word never crosses rows."""
    _, parts, bounds = word_places(data, offsets)
    return encoded(parts, bounds)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Parts, np.ndarray]:
    """Lines between \\n (an empty row has one empty line) and whether each has a word."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    compact = starts - np.searchsorted(breaks, starts)
    kept = data[data != 10]
    solid = np.concatenate([[0], np.cumsum(~BLANK[kept])])
    has_word = solid[np.append(compact[1:], len(kept))] > solid[compact]
    return encoded(pieces(kept, compact), np.searchsorted(owner, np.arange(rows + 1))), has_word


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_hashes(parts: pa.Array, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings from prefix sums of a polynomial, without Python objects."""
    data, offsets = utf8(parts)
    up, down = _powers(len(data) + 1, salt)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    sizes = np.diff(offsets).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]] + sizes * SEED)


_BASES = (0xB5297A4D3F84D5B5, 0x8CB92BA72F3D8DD7)
_POWERS: dict = {}


def _powers(n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse; tables of usual size are kept."""
    if salt not in _POWERS or len(_POWERS[salt][0]) < n:
        size, made = max(n, BLOCK_BYTES + (1 << 17)), []
        for base in (_BASES[salt], pow(_BASES[salt], -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if size > 16 * BLOCK_BYTES:
            return made[0][:n], made[1][:n]
        _POWERS[salt] = made
    return _POWERS[salt][0][:n], _POWERS[salt][1][:n]


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
