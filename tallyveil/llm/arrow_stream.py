"""Binary token files: Arrow files whose batches hold fixed-size lists, so any sequence is read in place.

A file covers a range of documents in order. Its ids are cut into equal sequences; only the last of a file is padded. Columns:
`ids` fixed_size_list<uint16 or uint32>[L], by the size of the vocabulary; `mask` fixed_size_list<bool>[L], false for padding;
`doc_ids` list<int64> and `ends` list<int32>, the documents that end in the sequence and the place after their last id.
Files are uncompressed: a memory map gives Arrow arrays, and the ids as numpy arrays, without a copy.

Tasks write under a name of their own and move the finished file to its place, so a task that is run again leaves a whole file.
Nulls: a null text is an empty document with its end id; a null doc_id sorts first and reads back as null. Repeated doc_ids
keep their rows, ordered by a hash of the text; an empty table makes no file and no row.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm.blocks import text_blocks, utf8
from tallyveil.llm.tokens import encoder, plain_words

LENGTH = 1024
BATCH_SEQUENCES = 256
FILE_BYTES = 32 << 20  # text for one file, about, until there are MAX_FILES
MAX_FILES = 100_000  # then files grow with the input, so neither the shuffle nor the manifest does


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))])


class SequenceWriter:
    """Collects documents' ids and writes whole batches of sequences; holds less than one batch and one block."""

    def __init__(self, sink, length: int, size: int):
        self.length, self.kind = length, np.uint16 if size <= 1 << 16 else np.uint32
        self.schema = _schema(length, pa.from_numpy_dtype(self.kind))
        self.out = ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.ended, self.waiting = [], [], [], 0
        self.tokens = self.sequences = self.documents = 0

    def add(self, ids: np.ndarray, bounds: np.ndarray, doc_ids: list):
        self.ids.append(ids.astype(self.kind))
        self.ends.append(bounds[1:] + self.waiting)
        self.ended.extend(doc_ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        self.documents += len(doc_ids)
        if self.waiting >= BATCH_SEQUENCES * self.length:
            self._write(self.waiting // self.length // BATCH_SEQUENCES * BATCH_SEQUENCES)  # all batches but the last are full

    def _write(self, count: int):
        ids, ends, size = np.concatenate(self.ids), np.concatenate(self.ends), count * self.length
        inside = int(np.searchsorted(ends, size, side="right"))
        self.ids, self.ends = [ids[size:]], [ends[inside:] - size]
        self.waiting, mask = max(0, len(ids) - size), np.arange(size) < len(ids)
        ids = np.append(ids[:size], np.zeros(max(0, size - len(ids)), self.kind))
        row, held = (ends[:inside] - 1) // self.length, self.ended[:inside]
        del self.ended[:inside]
        for at in range(0, count, BATCH_SEQUENCES):
            n = min(BATCH_SEQUENCES, count - at)
            span, these = slice(at * self.length, (at + n) * self.length), slice(*np.searchsorted(row, [at, at + n]))
            offsets = pa.array(np.searchsorted(row[these], np.arange(at, at + n + 1)).astype(np.int32))
            place = (ends[:inside][these] - row[these] * self.length).astype(np.int32)
            batch = [pa.FixedSizeListArray.from_arrays(pa.array(ids[span]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask[span]), self.length),
                     pa.ListArray.from_arrays(offsets, pa.array(held[these], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(place))]
            self.out.write_batch(pa.RecordBatch.from_arrays(batch, schema=self.schema))
        self.sequences += count

    def close(self):
        if self.waiting:
            self._write(-(-self.waiting // self.length))
        self.out.close()


def _writer(folder: str, vocabulary: str, end_id: int, length: int):
    def run(batches):
        encode, part = encoder(vocabulary, plain_words), TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        writer = None
        for block in text_blocks(batches):
            if writer is None:
                files.create_dir(root, recursive=True)
                mine = f"{root}/_{part}-{uuid.uuid4().hex}"
                stream = files.open_output_stream(mine)
                writer = SequenceWriter(stream, length, encode.tokenizer.get_vocab_size())
            ids, bounds = encode.ids(*utf8(block.column("text")), end_id)
            writer.add(ids, bounds, block.column("doc_id").to_pylist())
        if writer is not None:
            writer.close()
            stream.close()
            name = f"part-{part:06d}.arrow"
            files.move(mine, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "documents": [writer.documents],
                                              "tokens": [writer.tokens], "sequences": [writer.sequences]})

    return run


def write_sequences(docs: DataFrame, folder: str, vocabulary: str, end_id: int, length: int = LENGTH, parts: int | None = None) -> list:
    """Tokenise documents in doc_id order into Arrow files under `folder` (a URI that all executors reach).

    Returns the manifest, one row for each file in order: part, file, documents, tokens, sequences, first (ids before the
    file). The manifest is also the only thing that passes the driver: at most MAX_FILES rows.
    """
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, min(MAX_FILES, -(-size // FILE_BYTES)), docs.sparkSession.sparkContext.defaultParallelism if size > FILE_BYTES else 1)
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = ranged.mapInArrow(_writer(folder, vocabulary, end_id, length), "part long, file string, documents long, tokens long, sequences long").collect()
    first, manifest = 0, []
    for row in sorted(written, key=lambda r: r.part):
        manifest.append(row.asDict() | {"first": first})
        first += row.tokens
    return manifest


def batches_of(path: str, files=None):
    """Record batches of one file, in place where the store allows a memory map."""
    local = files is None or isinstance(files, pafs.LocalFileSystem)
    with (pa.memory_map(path) if local else files.open_input_file(path)) as source, ipc.open_file(source) as reader:
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def sequence_at(path: str, number: int) -> tuple[np.ndarray, pa.Array]:
    """ids (in place) and mask of one sequence of a local file, by its number alone."""
    with pa.memory_map(path) as source, ipc.open_file(source) as reader:
        batch, row = reader.get_batch(number // BATCH_SEQUENCES), number % BATCH_SEQUENCES
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values


def _reader(folder: str):
    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                running, size = 0, 0  # of the document that goes on
                for held in batches_of(f"{root}/{name}", files):
                    length = held.schema.field("ids").type.list_size
                    flat = held.column("ids").flatten().to_numpy().astype("<u4")[:held.column("mask").flatten().true_count]
                    row = np.repeat(np.arange(held.num_rows), np.diff(held.column("ends").offsets.to_numpy()))
                    ends = held.column("ends").flatten().to_numpy() + row * length
                    out, at = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}, 0
                    for end, doc in zip(ends.tolist(), held.column("doc_ids").flatten().to_pylist(), strict=True):
                        running, size = zlib.crc32(flat[at:end], running), size + end - at
                        for key, value in zip(out, (doc, start, size, running)):
                            out[key].append(value)
                        start, running, size, at = start + size, 0, 0, end
                    running, size = zlib.crc32(flat[at:], running), size + len(flat) - at
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def read_documents(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; one task for a few files."""
    rows = [json.loads(json.dumps({k: m[k] for k in ("file", "first")})) for m in manifest]
    files = spark.createDataFrame(rows, "file string, first long")
    spread = files.repartition(max(1, min(len(rows), 10_000)))
    return spread.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
