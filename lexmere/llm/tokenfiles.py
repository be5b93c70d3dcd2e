"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds its documents in order. Every frame is a zstandard frame of its own with the
little-endian ids of whole documents (one document at least, about FRAME_BYTES together).
Two skippable frames follow, so the file is still one valid zstandard stream:

directory   zstandard-compressed columns: document id, null mark, frame, offset, ids
seek table  per frame: compressed size, decompressed size, low half of the XXH64 of the
            decompressed bytes; then the number of frames, a flag byte and the magic of the
            public seekable format, by which a reader starts from the file's end

A reader takes the tail, then only the frames of the documents it wants, and checks each
frame against its checksum.

Writing range-partitions whole texts by document id, encodes each partition's sorted rows
and streams them into one file. File names carry the task attempt, and only the files that
the finished job reports are in the manifest, so lost or repeated tasks leave no trace.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows of
equal id keep an order by text hash; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm.units import unit_encoder
from lexmere.session import written

FRAME_BYTES = 1 << 18
LEVEL = 3
# Fixed values of the public zstandard formats.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_DIRECTORY = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
FOOTER = struct.Struct("<IBI")
HEAD = struct.Struct("<II")
DIRECTORY = np.dtype([("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])

MANIFEST = "path string, part int, docs long, tokens long"


class TokenFileWriter:
    """Streams documents into one open binary file."""

    def __init__(self, out):
        self.out = out
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.buffer: list[bytes] = []
        self.size = 0
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.rows.append((doc_id or 0, doc_id is None, len(self.entries), self.size // 4, len(ids) // 4))
        self.buffer.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.buffer:
            return
        plain = b"".join(self.buffer)
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.buffer, self.size = [], 0

    def close(self) -> None:
        self._flush()
        rows = self.packer.compress(np.array(self.rows, DIRECTORY).tobytes())
        self.out.write(HEAD.pack(SKIPPABLE_DIRECTORY, len(rows)) + rows)
        table = np.array(self.entries, ENTRY).tobytes()
        self.out.write(HEAD.pack(SKIPPABLE_TABLE, len(table) + FOOTER.size) + table)
        self.out.write(FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class TokenFileReader:
    """Opens a file by its tail; frames are read and checked only when asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flag, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file with a checksummed seek table")
        length = n * ENTRY.itemsize
        self.entries = np.frombuffer(self._bytes(size - FOOTER.size - length, length), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        head, length = HEAD.unpack(self._bytes(int(self.starts[-1]), HEAD.size))
        if head != SKIPPABLE_DIRECTORY:
            raise ValueError("the document directory is not where the seek table ends")
        rows = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.starts[-1]) + HEAD.size, length))
        self.rows = np.frombuffer(rows, DIRECTORY)

    def _bytes(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        entry = self.entries[k]
        packed = self._bytes(int(self.starts[k]), int(entry["packed"]))
        plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(entry["plain"]))
        if len(plain) != entry["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k} does not match its checksum")
        return plain

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, ids); only the frames of wanted documents."""
        starts = np.concatenate([[0], np.cumsum(self.rows["n"], dtype=np.int64)])
        held, plain = -1, b""
        for row, start in zip(self.rows.tolist(), starts.tolist()):
            doc_id = None if row[1] else row[0]
            if wanted is not None and doc_id not in wanted:
                continue
            if row[2] != held:
                held, plain = row[2], self.frame(row[2])
            yield doc_id, start, plain[4 * row[3] : 4 * (row[3] + row[4])]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "bytes", *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest, one row per file."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, writer, docs_written = TaskContext.get().partitionId(), None, None, 0
        store, root = _place(folder)
        path = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = unit_encoder(kind, tokenizer)
                store.create_dir(root, recursive=True)
                writer = TokenFileWriter(store.open_output_stream(f"{root}/{path}", compression=None))
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for own, data in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                writer.add(own, data + end)
            docs_written += batch.num_rows
        if writer is not None:
            writer.close()
            writer.out.close()
            row = [[f"{folder}/{path}"], [part], [docs_written], [writer.tokens]]
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], ["path", "part", "docs", "tokens"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_files(spark: SparkSession, manifest: DataFrame, wanted: set | None = None) -> DataFrame:
    """(doc_id, start, ids): `start` counts the ids of all documents before it.

    The manifest has one row per file, so adding up what lies before each file is a
    matter of as many rows as the writing job had tasks.
    """
    files, before = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((row["path"], before))
        before += row["tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "ids"]
        types = (pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = _place(path)
                with store.open_input_file(name) as source:
                    rows: list[tuple] = []
                    size = 0
                    for own, start, ids in TokenFileReader(source).documents(wanted):
                        rows.append((own, base + start, ids))
                        size += len(ids)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back."""
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return documents.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
