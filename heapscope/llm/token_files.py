"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a series of zstandard frames. All but the last hold the ids (little-endian 32-bit words) of some
consecutive documents; the last holds the index: for each document its id, whether that is null, and its number
of tokens. A seek table in a skippable frame ends the file, in the public "seekable" layout: for each frame its
compressed size, its size and the low 32 bits of the XXH64 of its content. Any zstandard tool can read the whole
file; TokenFile reads single documents by decompressing only their frames.

Null text: an empty document (its end id alone). Repeated doc_ids: all kept, ordered by text. Null doc_id: first.
An empty table: no files with documents, an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heapscope.llm.bpe import encoder
from heapscope.llm.common import batches_of, fresh_dir, out_batch, rows, spread, text_only, tidied

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_tokens", "<i8")])


class BadFrame(ValueError):
    """A frame's content doesn't match its checksum, or the seek table is damaged."""


class TokenFileWriter:
    def __init__(self, sink, frame_bytes: int = 1 << 18, level: int = 3):
        self.sink, self.frame_bytes, self.zstd = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.n_tokens += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.sink.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        self._frame(np.array(self.index, _INDEX).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class TokenFile:
    """Reads documents of one file; opened is a seekable binary file."""

    def __init__(self, opened):
        self.file, self.zstd = opened, zstandard.ZstdDecompressor()
        end = opened.seek(0, 2)
        opened.seek(end - 9)
        n, flag, magic = struct.unpack("<IBI", opened.read(9))
        if magic != FOOTER_MAGIC or flag != CHECKSUM_FLAG:
            raise BadFrame("no seek table")
        opened.seek(end - 17 - 12 * n)
        head = opened.read(8 + 12 * n)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE_MAGIC, 9 + 12 * n):
            raise BadFrame("damaged seek table")
        self.table = np.frombuffer(head[8:], "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.index = np.frombuffer(self.frame(n - 1), _INDEX)
        self.from_byte = np.concatenate([[0], np.cumsum(self.index["n_tokens"] * 4)])
        self.frame_from = np.concatenate([[0], np.cumsum(self.table[:-1, 1].astype(np.int64))])

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        try:
            content = self.zstd.decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        except zstandard.ZstdError as e:
            raise BadFrame(f"frame {k}: {e}") from e
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
            raise BadFrame(f"frame {k}: wrong checksum")
        return content

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents, one frame in memory at a time (a document lies in one frame)."""
        k, content = -1, b""
        for (doc_id, null, _), a, b in zip(self.index.tolist(), self.from_byte[:-1].tolist(), self.from_byte[1:].tolist(), strict=True):
            if b > a:
                while k < 0 or a >= self.frame_from[k + 1]:
                    k += 1
                    content = self.frame(k)
            base = int(self.frame_from[k]) if k >= 0 else 0
            yield (None if null else doc_id), content[a - base : b - base]

    def read(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of some documents; decompresses their frames only."""
        found, frames = {}, {}
        for i in np.flatnonzero(np.isin(self.index["doc_id"], list(doc_ids)) & (self.index["null"] == 0)).tolist():
            a, b = int(self.from_byte[i]), int(self.from_byte[i + 1])
            k = max(0, int(np.searchsorted(self.frame_from, a, "right")) - 1)
            if b > a and k not in frames:
                frames[k] = self.frame(k)
            base = int(self.frame_from[k])
            found[int(self.index["doc_id"][i])] = np.frombuffer(frames[k][a - base : b - base], "<u4") if b > a else np.zeros(0, "<u4")
        return found


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, out: str | None = None, frame_bytes: int = 1 << 18) -> DataFrame:
    """Writes docs to files in out, in ascending doc_id order over all files. Returns the manifest: part, path, n_docs, n_tokens.

    Each task writes a file of its own name; only files of tasks that ended well are in the manifest, so a task that
    runs again after a lost executor adds no document twice.
    """
    spark = docs.sparkSession
    out = out or fresh_dir(spark, "tokens")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer_path), struct.pack("<I", end_id)
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex[:8]}.ids.zst"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as sink:
            writer = TokenFileWriter(sink, frame_bytes)
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for a, b in batches_of([len(t) for t in texts]):
                    for doc_id, ids in zip(doc_ids[a:b], enc.many(texts[a:b]), strict=True):
                        writer.add(doc_id, ids + end)
            writer.close()
        yield out_batch(schema, [[part], [f"{out}/{name}"], [len(writer.index)], [writer.n_tokens]])

    ordered = text_only(docs).repartitionByRange(spread(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidied(write, "bpe"), "part int, path string, n_docs long, n_tokens long").write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back frame by frame with all checksums verified."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in rows(batch, "path", "first"):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    columns: list[list] = [[], [], [], []]
                    for doc_id, ids in TokenFile(f).documents():
                        for c, v in zip(columns, (doc_id, start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            c.append(v)
                        start += len(ids) // 4
                        if len(columns[0]) == 10_000:
                            yield out_batch(schema, columns)
                            columns = [[], [], [], []]
                    yield out_batch(schema, columns)

    # One row for each file: the running total is over the files, not over the documents.
    first = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(first, F.lit(0)).alias("first"))
    return files.repartition(spread(spark), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(spark, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
