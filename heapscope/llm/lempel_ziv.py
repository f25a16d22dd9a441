"""Removal of repeated word sequences by relative Lempel-Ziv parsing against earlier documents.

A window is `length` consecutive words of one document; a word goes if a window that covers it also starts in a
document with a smaller doc_id. Windows are judged on the input.

1. Every window has an anchor, the `kmer` words with the least hash in it; equal windows have equal anchors. Runs of
   windows with one anchor are emitted as hashes, and anchors that lie in one document only are done with.
2. A run's slice of words is kept once, with the smallest doc_id that has it; the other places of an equal slice go
   whole. Slices are equal if their anchors' and their windows' hashes are, 128 bits in all. If an anchor has several
   slices, they are sent to the shard of the anchor, in the order of that doc_id.
3. A shard parses each slice greedily into factors, each the longest match with any indexed block of the reference,
   which is all slices of smaller doc_ids with the same anchor: others have no window in common with it. Words are
   compared, not hashes. One index of windows, each with its block and the place where it first
   stands, serves all blocks. A factor of `length` words or more is a duplicate
   span; windows that cross a factor's end are looked up one by one, so a cut between factors hides none. A slice then
   joins the reference. Blocks are of a fixed number of words; with the next anchor a new reference begins.
4. Marks go back to all places of their slice and are merged into each document's spans.

Equal slices are parsed once, and smallest ids are taken before the shuffle, so the number of copies of a passage
enters no task but that of the join, which the skew handling splits.

Null text: no words. Texts under `length` words: nothing removed. Null doc_id: such documents come after all others
and after none of each other. Rows with one doc_id aren't earlier than each other, also where they repeat. Very long texts are
hashed in parts and read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heapscope.llm.common import batches_of, out_batch, rows, small_batches, spread, staged, tidied
from heapscope.llm.word_hash import hashed_words, ngrams, prefix_sums, string_hash

LENGTH, KMER = 13, 4
#: The most windows in a slice.
MOST = 64


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == w else np.minimum(h[: len(h) - (w - size)], h[w - size :])


def slices(texts: list[bytes], length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Text's number, anchor's hash, slice's hash, first window, number of windows of every run of windows with one anchor.

    All texts are worked on as one array of words; windows that cross from one to the next are left out.
    """
    w, n = hashed_words(texts)
    if len(w) < length or n.max() < length:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    end = np.cumsum(n)
    last = np.repeat(end, n)[: len(w) - length + 1]
    valid = np.flatnonzero(np.arange(length, len(w) + 1) <= last)
    least = _least(ngrams(w, kmer), length - kmer + 1)[valid]
    edge = np.flatnonzero((least[1:] != least[:-1]) | (np.diff(valid) != 1)) + 1
    run = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([run, [len(valid)]]))
    if count.max() > MOST:
        run = np.concatenate([np.arange(a, a + c, MOST) for a, c in zip(run.tolist(), count.tolist(), strict=True)])
        count = np.diff(np.concatenate([run, [len(valid)]]))
    first = valid[run]
    whole = string_hash(prefix_sums(ngrams(w, length)), first, first + count)
    doc = np.searchsorted(end, first, "right")
    return doc, least[run], whole, first - (end - n)[doc], count


def windows_of(words: np.ndarray, length: int) -> list[bytes]:
    """The windows themselves, as bytes of the words' numbers."""
    raw, size = words.tobytes(), words.itemsize
    return [raw[i * size : (i + length) * size] for i in range(len(words) - length + 1)]


class Reference:
    """Blocks of words, as numbers, with an index of the windows that start in them, each where it first stands."""

    def __init__(self, length: int, block_words: int = 1 << 16):
        self.length, self.block_words = length, block_words
        self.blocks: list[np.ndarray] = []
        self.index: dict[bytes, tuple[int, int]] = {}
        self.size = 0

    def add(self, words: np.ndarray, windows: list[bytes], new: np.ndarray) -> None:
        """Indexes the windows marked new; a block that is full is followed by another."""
        if not new.any():
            return
        if not self.blocks or self.size + len(words) + 1 > len(self.blocks[-1]):
            self.blocks.append(np.full(max(self.block_words, len(words) + 1), -1, np.int32))
            self.size = 0
        self.blocks[-1][self.size : self.size + len(words)] = words
        for i in np.flatnonzero(new).tolist():
            self.index.setdefault(windows[i], (len(self.blocks) - 1, self.size + i))
        self.size += len(words) + 1

    def longest(self, words: np.ndarray, window: bytes, at: int) -> int:
        """Words from `at` on that stand in a row where this window does, in whichever block; 0 if none has it."""
        if (place := self.index.get(window)) is None:
            return 0
        block, p = self.blocks[place[0]], place[1]
        n = min(len(words) - at, len(block) - p)
        differs = words[at : at + n] != block[p : p + n]
        return int(differs.argmax()) if differs.any() else n

    def parse(self, words: np.ndarray, windows: list[bytes]) -> np.ndarray:
        """Greedy factors; which windows lie in the reference."""
        found, i, n = np.zeros(len(windows), bool), 0, len(windows)
        while i < n:
            size = self.longest(words, windows[i], i)
            if not size:
                i += 1
                continue
            found[i : i + size - self.length + 1] = True
            for j in range(i + size - self.length + 1, min(n, i + size)):
                found[j] = self.longest(words, windows[j], j) > 0
            i += size
        return found


def parsed(found: Iterator[tuple], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """h, s and the marked windows of each slice; found: (h, s, smallest doc_id, text of the slice) in the order of h and that doc_id."""
    for h, slices_ in groupby(found, key=lambda r: r[0]):
        reference, waiting, now = Reference(length), [], None
        numbers: dict[bytes, int] = {}
        for _, s, m, text in slices_:
            words = np.array([numbers.setdefault(w, len(numbers)) for w in text.split()], np.int32)
            windows = windows_of(words, length)
            if m != now:
                for w in waiting:
                    reference.add(*w)
                waiting, now = [], m
            marks = reference.parse(words, windows)
            waiting.append((words, windows, ~marks))
            yield h, s, marks


def runs_of(marks: np.ndarray) -> bytes:
    """Runs of marked windows as pairs of 32-bit numbers (from, to)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    edge[1::2] -= 1
    return edge.astype("<i4").tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    k2 = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.crc32(text.cast("binary")))
    return docs.select(F.coalesce(doc_id, F.lit(2**63 - 1)).alias("k1"), k2.alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def _places(keyed: DataFrame, length: int, kmer: int) -> DataFrame:
    """h, s, k1, k2 and pos (first window * 128 + windows) of every run."""
    schema = pa.schema([(c, pa.int64()) for c in ("h", "s", "k1", "k2", "pos")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("k1", "k2"))
            texts = batch.column("text").to_pylist()
            for a, b in batches_of([len(t) for t in texts], 1 << 19):
                doc, h, s, first, n = slices([t.encode("utf-8", "replace") for t in texts[a:b]], length, kmer)
                yield out_batch(schema, [h.view(np.int64), s.view(np.int64), k1[a:b][doc], k2[a:b][doc], first * 128 + n])

    return keyed.select("k1", "k2", "text").mapInArrow(tidied(run), "h long, s long, k1 long, k2 long, pos long")


def _packed(keyed: DataFrame) -> DataFrame:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [zstd.compress(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield out_batch(schema, [*(batch.column(c) for c in ("k1", "k2", "doc_id")), z])

    return keyed.mapInArrow(tidied(run), "k1 long, k2 long, doc_id long, z binary")


def earlier_windows(keyed: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """k1, k2 and runs (pos, marks or null for all windows) of every document with windows that an earlier one has."""
    spark = keyed.sparkSession
    shared = _places(keyed, length, kmer).groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo < hi").select("h")
    places = staged(_places(keyed, length, kmer).join(shared, "h"), "word-anchors")
    one = places.groupBy("h", "s").agg(F.min(F.struct("k1", "k2", "pos")).alias("at"), F.max("k1").alias("last"))
    one = staged(one.withColumn("kinds", F.count("*").over(Window.partitionBy("h"))).select("h", "s", "at.*", "last", "kinds"), "word-slices")
    wanted = one.filter("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "s", "pos")).alias("wanted"))
    cut_schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("m", pa.int64()), ("slice", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for k1, z, own in rows(batch, "k1", "z", "wanted"):
                w = zstd.decompress(z).split()
                parts = [b" ".join(w[(a := x["pos"] >> 7) : a + (x["pos"] & 127) + length - 1]) for x in own]
                yield out_batch(cut_schema, [[x["h"] for x in own], [x["s"] for x in own], [k1] * len(own), parts])

    marks_schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("marks", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for h, s, marks in parsed((r for b in batches for r in rows(b, "h", "s", "m", "slice")), length):
            if marks.any():
                for c, v in zip(out, (h, s, runs_of(marks)), strict=True):
                    c.append(v)
            if len(out[0]) == 10_000:
                yield out_batch(marks_schema, out)
                out = [[], [], []]
        yield out_batch(marks_schema, out)

    texts = _packed(keyed).select("k1", "k2", "z")
    pieces = texts.join(wanted, ["k1", "k2"]).select("k1", "z", "wanted").mapInArrow(tidied(cut), "h long, s long, m long, slice binary")
    ordered = pieces.dropDuplicates(["h", "s"]).repartition(spread(spark), "h").sortWithinPartitions("h", "m", "s")
    marks = staged(ordered.mapInArrow(tidied(parse), "h long, s long, marks binary"), "word-marks")
    # Slices that say something: marked ones, and those that a later document has too.
    told = one.select("h", "s", F.col("k1").alias("m"), "last").join(marks, ["h", "s"], "left").filter("marks is not null or m < last")
    back = places.join(told.select("h", "s", "m", "marks"), ["h", "s"]).filter("k1 > m or marks is not null")
    whole = F.when(F.col("k1") <= F.col("m"), F.col("marks"))
    return back.select("k1", "k2", F.struct("pos", whole.alias("marks")).alias("run")).groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))


def kept_words(text: bytes, runs: list[dict] | None, length: int) -> tuple[list[bytes], int]:
    """The words that stay, and the number of all."""
    words = text.split()
    if not runs:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        first, n = r["pos"] >> 7, r["pos"] & 127
        pairs = np.array([[0, n - 1]]) if r["marks"] is None else np.frombuffer(r["marks"], "<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0] + first, 1)
        np.add.at(edge, pairs[:, 1] + first + length, -1)
    stays = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stays).tolist()], len(words)


def remove_earlier(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by spaces."""
    keyed = _keyed(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, z, runs in rows(batch, "doc_id", "z", "runs"):
                kept, n = kept_words(zstd.decompress(z), runs, length)
                for c, v in zip(out, (doc_id, n, n - len(kept), b" ".join(kept)), strict=True):
                    c.append(v)
            yield out_batch(schema, out)

    both = _packed(keyed).join(earlier_windows(keyed, length, kmer), ["k1", "k2"], "left").select("doc_id", "z", "runs")
    return both.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept binary")


def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_earlier(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
