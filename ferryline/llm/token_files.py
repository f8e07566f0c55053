"""Token ids as Arrow files of fixed-size-list batches.

Layout: documents in ascending doc_id order are encoded, ended by ``end_id`` and laid one after the
other into sequences of ``length`` ids. A file holds the sequences of one range of doc_ids as record
batches of two columns, ``ids`` (fixed-size list of unsigned integers) and ``mask`` (fixed-size list of
booleans, false on the padding of the file's last sequence). A second file beside it lists the documents:
doc_id, start (within the file) and n_tokens. A sequence is found by number without reading
others: every batch but the last has the same number of rows, and the buffers are memory-mapped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, fresh_path, materialize, read_documents
from .tokens import BYTE_BPE, encoder, tokenizer_path

ROWS_PER_BATCH = 128
_MANIFEST = "part int, file string, low_id long, n_docs long, n_tokens long"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer:
    """Appends ids to one pair of files, holding one batch of sequences."""

    def __init__(self, folder: str, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.store, base = _filesystem(folder)
        self.store.create_dir(base)
        self.name = f"{folder}/{uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        stem = f"{base}/{self.name.rpartition('/')[2]}"
        self.out = self.store.open_output_stream(f"{stem}.arrow")
        self.docs_out = self.store.open_output_stream(f"{stem}.docs.arrow")
        self.ids = pa.ipc.new_file(self.out, self.schema)
        self.docs = pa.ipc.new_file(self.docs_out, self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.low_id = None
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if not self.n_docs:
            self.low_id = doc_id
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_held >= ROWS_PER_BATCH * self.length:
            self._flush(False)
        if len(self.rows) >= 8192:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([*self.held, np.empty(0, self.dtype)])
        step = ROWS_PER_BATCH * self.length
        whole = len(flat) if last else len(flat) // step * step
        for at in range(0, whole, step):
            part = flat[at : at + step]
            size = -(-len(part) // self.length) * self.length
            mask = np.arange(size) < len(part)
            part = np.concatenate([part, np.zeros(size - len(part), self.dtype)])
            self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _flush_docs(self) -> None:
        if self.rows:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.docs_schema))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        for x in (self.ids, self.docs, self.out, self.docs_out):
            x.close()


def _write(path: str, folder: str, length: int, end_id: int):
    dtype = np.dtype(np.uint16 if max(end_id, encoder(path, False).tokenizer.get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, writer, part = encoder(path, False), None, -1
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found.encode(batch.column("text")), strict=True):
                if writer is None:
                    writer = _Writer(folder, length, dtype)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.name]), pa.array([writer.low_id], pa.int64()), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_tokens], pa.int64())], names=["part", "file", "low_id", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, length: int = 2048) -> DataFrame:
    """Encode ``docs`` into Arrow files below ``folder``; returns the manifest, one row per file.

    Manifest: part (ascending with doc_id), file (name without ending), low_id, n_docs, n_tokens and start
    (ids in the files before it). A task writes under a name of its own and reports it when it is done, so what a lost or
    repeated task leaves behind is in no manifest. Null doc_ids come first.
    """
    dealt = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    manifest, _ = materialize(dealt.mapInArrow(_write(path, folder, length, end_id), _MANIFEST), "manifest")
    # One row per file: the files' sizes are added up, nothing of the corpus.
    start, starts = 0, []
    for row in manifest.orderBy("part").collect():
        starts.append((*row, start))
        start += row["n_tokens"]
    return docs.sparkSession.createDataFrame(starts, f"{_MANIFEST}, start long")


class TokenFile:
    """Random access to one file's sequences and documents; local files are memory-mapped, not copied."""

    def __init__(self, name: str):
        store, stem = _filesystem(name)
        opened = [pa.memory_map(f"{stem}{x}") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(f"{stem}{x}") for x in (".arrow", ".docs.arrow")]
        self.ids, self.docs = (pa.ipc.open_file(x) for x in opened)
        self.length = self.ids.schema.field("ids").type.list_size
        self._kept, self._at = np.empty((0, self.length)), -1

    def batch(self, i: int) -> np.ndarray:
        """ids of the i-th batch, one row per sequence; the last one asked for is kept, so a reader in order fetches each once."""
        if i != self._at:
            self._kept, self._at = self.ids.get_batch(i).column("ids").flatten().to_numpy().reshape(-1, self.length), i
        return self._kept

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of the i-th sequence."""
        batch = self.ids.get_batch(i // ROWS_PER_BATCH).slice(i % ROWS_PER_BATCH, 1)
        return batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten().to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the file's stream."""
        step = ROWS_PER_BATCH * self.length
        parts = []
        for i in range(start // step, -(-(start + count) // step)):
            flat = self.batch(i).ravel()
            parts.append(flat[max(start - i * step, 0) : start + count - i * step])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            file = TokenFile(name)
            for i in range(file.docs.num_record_batches):
                docs = file.docs.get_batch(i)
                crc = [zlib.crc32(file.tokens(at, n).astype("<u4").tobytes()) for at, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(docs.column("start").to_numpy() + start), docs.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``manifest``, read from them."""
    files = manifest.select("file", "start")
    # A stated number of partitions is not merged at run time: the files are read by many tasks.
    return files.repartition(max(1, files.count()), "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, path: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and report what the files hold.

    Returns (doc_id, start, n_tokens, ids_crc32), one row per input row; n_tokens counts the end id, start
    the ids of all documents before it. Null and empty texts hold the end id alone; null doc_ids come
    first; repeated doc_ids follow one another in any order; an empty table gives no file and an empty result.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path, end_id, length))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(read_documents(spark, sf_dir), tokenizer_path(BYTE_BPE), end_id=2)
