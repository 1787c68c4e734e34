"""Token ids by the `tokenizers` library, which sees each distinct chunk of text about once.

Texts are cut where no token can cross, so joined ids equal those of the whole text. Chunks repeat a lot; a bounded cache of
their ids, found by two 64-bit hashes, lives as long as the Python worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyveil.llm.blocks import BLANK, LOWER, Parts, byte_hashes, encoded, pieces, ragged

CACHE_CHUNKS = 2_000_000  # about 40 bytes each
JOINED = 4_000  # chunks in one call, between end-of-text marks
MARK = "<|endoftext|>"

_BYTES = np.arange(256)
_LEADS = np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])  # first bytes of all white space outside ASCII
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_STOP = np.isin(_BYTES, [ord(","), ord(".")])


def _rows(cut: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[heads] = True
    return np.flatnonzero(cut)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Parts:
    """Chunks for lower-casing tokenizers that drop white space: words, their commas and full stops apart."""
    if MARK[:2].encode() not in data.tobytes():  # else a mark in capitals would become a mark
        data = LOWER[data]
    keep = ~BLANK[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1] | (_STOP[data[1:]] & _LETTER[data[:-1]])
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = keep[heads]
    at = np.flatnonzero(first)
    place = np.cumsum(keep) - 1
    return encoded(pieces(data[keep], place[at]), np.searchsorted(at, offsets))


def space_led(data: np.ndarray, offsets: np.ndarray) -> Parts:
    """Chunks for byte-level tokenizers, whose tokens may begin with one space.

    Cuts: before a single space, before and after a single line end, before a comma or full stop after a letter. A run of
    white space is never cut, so the characters around must surely be none.
    """
    blank = BLANK[data] | ((data >= 0x1C) & (data <= 0x1F))
    one = (data == 0x20) | (data == 0x0A)
    one[1:] &= ~blank[:-1]
    one[:-1] &= ~blank[1:] & ~_LEADS[data[1:]]
    for back in (2, 3):  # the character before may be white space of two or three bytes
        one[back:] &= ~_LEADS[data[:-back]]
    filled = offsets[:-1] < offsets[1:]
    one[offsets[1:][filled] - 1] = False
    one[offsets[:-1][filled]] = False
    cut = one.copy()
    cut[1:] |= one[:-1] & (data[:-1] == 0x0A)
    cut[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    at = _rows(cut, offsets)
    return encoded(pieces(data, at), np.searchsorted(at, offsets))


class Encoder:
    """ids(data, offsets): the ids of all rows one after the other, and where each row's ids begin."""

    def __init__(self, path: str, chunks):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.mark, self.chunks = self.tokenizer.token_to_id(MARK), chunks
        self._clear()

    def _clear(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begins, self.sizes, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and how many each has. Marks part the chunks of one call."""
        if any(MARK in c for c in chunks):  # rare: a chunk that holds a mark is encoded alone
            alone = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32) for c in chunks]
            return np.concatenate(alone), np.fromiter(map(len, alone), np.int64, len(alone))
        ids, sizes = [], []
        for at in range(0, len(chunks), JOINED):
            part = chunks[at:at + JOINED]
            got = np.array(self.tokenizer.encode(MARK.join(part), add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(got == self.mark)
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
            ids.append(np.delete(got, marks))
        return np.concatenate(ids), np.concatenate(sizes)

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, (self.keys[place] == keys) & (self.checks[place] == checks)

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where the cache has each distinct chunk, after adding those it lacks."""
        keys, checks = byte_hashes(distinct), byte_hashes(distinct, 1)
        place, there = self._find(keys, checks)
        if there.all():
            return place
        if len(self.keys) + len(keys) > CACHE_CHUNKS:
            self._clear()
            there[:] = False
        new = np.flatnonzero(~there)
        new = new[np.argsort(keys[new])]
        ids, sizes = self._encode(distinct.take(pa.array(new)).cast(pa.string()).to_pylist())
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(2 * len(self.flat) + len(ids), np.uint32)])
        self.flat[self.used:self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys[new])
        self.begins = np.insert(self.begins, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.checks, self.keys, self.used = np.insert(self.checks, at, checks[new]), np.insert(self.keys, at, keys[new]), self.used + len(ids)
        place, there = self._find(keys, checks)
        if not there.all():
            raise ValueError("two chunks share a 64-bit hash")
        return place

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        parts = self.chunks(data, offsets)
        places = self._places(parts.distinct)
        of_chunk = self.sizes[places].astype(np.int64)[parts.ids]
        out = self.flat[ragged(self.begins[places][parts.ids], of_chunk)]
        bounds = np.concatenate([[0], np.cumsum(of_chunk)])[parts.bounds]
        if end_id is None:
            return out, bounds
        return np.insert(out, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


_ENCODERS: dict = {}


def encoder(path: str, chunks) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, chunks) not in _ENCODERS:
        _ENCODERS[path, chunks] = Encoder(path, chunks)
    return _ENCODERS[path, chunks]
