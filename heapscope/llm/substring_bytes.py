"""Removal of long repeated byte strings, found by external induced sorting of suffixes.

A window is a string of `length` bytes of one document; a byte goes if a window that covers it also starts anywhere
else, in the same document or another. Windows are judged on the input.

1. Every window has an anchor: the substring of `kmer` bytes with the least hash in it. Equal windows have equal
   anchors, so a run of windows with one anchor can only repeat where that anchor occurs. Runs are emitted as hashes
   of the anchor and of the run's whole slice; anchors that occur once are done with.
2. An anchor in several documents whose slices are all equal (by 128 bits of hashes) repeats in all its windows. For the others, each distinct slice is fetched
   once and sent to the shard of its anchor.
3. A shard takes whole anchors, as many as make up a few megabytes or one that is larger, writes their slices to a file,
   sorts all their suffixes by recursive induction with a disk-backed queue (suffix_sort), and marks windows whose common
   prefix with a neighbour is `length` or more. Slices of other anchors have no window in common with these.
4. Marks go back to all places of their slice, and each document's marked windows are merged into spans.

An anchor with very many places is split by the skew handling of the join; counts are added before they are
shuffled, and slices that are equal are sorted once, so a passage's number of copies doesn't enter step 3.

Null text: empty, nothing removed. Texts under `length` bytes: nothing removed. Repeated rows: copies of each other,
so all of their bytes go if there are `length` of them. Null doc_id: kept, rows are told apart by their text. An empty
table gives an empty result. Extra columns are ignored. Very long texts are cut into overlapping parts for hashing only.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.llm.common import out_batch, rows, small_batches, spread, staged, tidied
from heapscope.llm.suffix_sort import sort_suffixes
from heapscope.llm.word_hash import mixed, powers, prefix_sums, string_hash

LENGTH, KMER = 200, 64
_BASE = 0x9E3779B97F4A7C15
#: Windows hashed at once, and the most in a slice.
PART, MOST = 1 << 21, 512


#: Bytes in a window that is hashed as one number.
WIDTH = 8


def _eights(x: np.ndarray) -> np.ndarray:
    """A hash of each WIDTH bytes in a row. Sums of these over overlapping windows, unlike sums over bytes, have no structure
    by which strings of two letters collide."""
    v = x.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | v[k:] << np.uint64(8 * k)
    return mixed(v + np.uint64(_BASE))


def slices(text: bytes, length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Anchor's hash, slice's hash, first window, number of windows of every run of windows with one anchor, and whether
    the anchor occurs again in this part of the text, maybe in the same run."""
    if len(text) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    if len(text) > PART + length:
        parts = [(a, slices(text[a : a + PART + length - 1], length, kmer)) for a in range(0, len(text) - length + 1, PART)]
        return tuple(np.concatenate([p[i] + a if i == 2 else p[i] for a, p in parts]) for i in range(5))
    if kmer < WIDTH:
        raise ValueError(f"kmer must be {WIDTH} or more")
    x = np.frombuffer(text, np.uint8)
    w, k = length - kmer + 1, kmer - WIDTH + 1
    total = prefix_sums(_eights(x))
    inverse = powers(len(total))[1]
    h = mixed((total[k:] - total[:-k]) * inverse[: len(total) - k])
    # Least of each w hashes in a row: least from a block's start, and to its end.
    m = len(h)
    blocks = np.concatenate([h, np.full(-m % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(least)]]))
    if count.max() > MOST:
        cuts = [np.arange(a, a + c, MOST) for a, c in zip(first.tolist(), count.tolist(), strict=True)]
        first = np.concatenate(cuts)
        count = np.diff(np.concatenate([first, [len(least)]]))
    whole = string_hash(total, first, first + count + length - WIDTH)
    # Places of hashes that are some run's anchor, by a table of their last bits; then those that have two.
    table = np.zeros(1 << 16, bool)
    last = np.uint64(0xFFFF)
    table[(least[first] & last).astype(np.intp)] = True
    anchors, times = np.unique(h[table[(h & last).astype(np.intp)]], return_counts=True)
    again = np.isin(least[first], anchors[times > 1])
    return least[first], whole, first, count, again


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: what tells a document apart, the same whenever it is read; doc_id; text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.xxhash64(text)).alias("k1"), F.crc32(text.cast("binary")).cast("long").alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def _places(keyed: DataFrame, length: int, kmer: int) -> DataFrame:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.int64()), ("s", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                keys = [np.repeat(np.array([x[i] for x in held], np.int64), [len(x[2]) for x in held]) for i in (0, 1)]
                h, s, first, n, again = (np.concatenate([x[i] for x in held]) for i in range(2, 7))
                return out_batch(schema, [*keys, h.view(np.int64), s.view(np.int64), first.astype(np.int64), n.astype(np.int32), again])

            for k1, k2, text in rows(batch, "k1", "k2", "text"):
                held.append((k1, k2, *slices(text.encode("utf-8", "replace"), length, kmer)))
                size += len(held[-1][2])
                if size > 50_000:
                    yield flush()
                    held, size = [], 0
            if size:
                yield flush()

    return keyed.select("k1", "k2", "text").mapInArrow(tidied(run), "k1 long, k2 long, h long, s long, first long, n int, again boolean")


def _packed(keyed: DataFrame) -> DataFrame:
    """k1, k2, doc_id and the text, compressed for the shuffles to come."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [zstd.compress(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield out_batch(schema, [*(batch.column(c) for c in ("k1", "k2", "doc_id")), z])

    return keyed.mapInArrow(tidied(run), "k1 long, k2 long, doc_id long, z binary")


#: Bytes of slices that are sorted together, and the memory that a sort's queues, or its ranks, may take.
TOGETHER, MEMORY = 4 << 20, 256 << 20


def by_anchors(found: Iterator[tuple], most: int) -> Iterator[Iterator[tuple]]:
    """Rows (h first, text last, in the order of h) in parts of `most` bytes or a little more, no h in two of them. Each is to be read to its
    end before the next."""
    row = next(found, None)

    def one() -> Iterator[tuple]:
        nonlocal row
        size, last = 0, None
        while row is not None and (size < most or row[0] == last):
            size, last = size + len(row[-1]), row[0]
            yield row
            row = next(found, None)

    while row is not None:
        yield one()


def marked_windows(found: list[tuple[int, bytes]], length: int, memory: int = MEMORY) -> list[bytes]:
    """For slices of n windows each: the runs of windows that also start elsewhere among them, as pairs of 32-bit numbers (from, to)."""
    with tempfile.TemporaryDirectory() as folder:
        return _sorted_marks(iter(found), length, folder, memory)[1]


def _sorted_marks(found: Iterator[tuple], length: int, folder: str, memory: int) -> tuple[list, list[bytes]]:
    """Slices go to a file as they come; (their other columns, their marks)."""
    path, others, counts, sizes = os.path.join(folder, "text"), [], [], []
    with open(path, "wb") as f:
        for *other, n, text in found:
            f.write((np.frombuffer(text, np.uint8).astype("<i2") + 2).tobytes())
            f.write(b"\x01\x00")
            others.append(other)
            counts.append(n)
            sizes.append(len(text) + 1)
        f.write(b"\x00\x00")
    if not sizes:
        return [], []
    t = np.memmap(path, "<i2", "r")
    marks = np.memmap(os.path.join(folder, "marks"), np.bool_, "w+", shape=(len(t),))
    last = [0]

    def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
        same = lcp >= length
        marks[pos[same]] = True
        if same[0]:
            marks[last[0]] = True
        marks[pos[:-1][same[1:]]] = True
        last[0] = int(pos[-1])

    sort_suffixes(t, 258, emit, cap=length, folder=folder, memory=memory)
    out, at = [], 0
    for n, size in zip(counts, sizes, strict=True):
        own = np.flatnonzero(np.diff(np.concatenate([[False], marks[at : at + n], [False]]).astype(np.int8)))
        own[1::2] -= 1
        out.append(own.astype("<i4").tobytes())
        at += size
    return others, out


def repeated_windows(keyed: DataFrame, length: int = LENGTH, kmer: int = KMER, memory: int = MEMORY) -> DataFrame:
    """k1, k2 and runs: for every document with repeated windows, (first window, windows, marks or null for all) of its runs."""
    spark = keyed.sparkSession
    counts = _places(keyed, length, kmer).groupBy("h").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.bool_or("again").alias("again"))
    counts = counts.filter("c > 1 or again").select("h", (F.col("again") | (F.col("lo") != F.col("hi"))).alias("mixed"))
    places = staged(_places(keyed, length, kmer).drop("again").join(counts, "h"), "anchor-places")
    one = places.filter("mixed").groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "first", "n")).alias("at"))
    # A document is fetched with all slices it stands for; their number is bounded by its length.
    wanted = one.select("at.k1", "at.k2", F.struct("h", "s", "at.first", "at.n", (F.col("c") > 1).alias("all")).alias("x")).groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))
    cut_schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("all", pa.bool_()), ("n", pa.int32()), ("text", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, own in rows(batch, "z", "wanted"):
                text = zstd.decompress(z)
                yield out_batch(cut_schema, [[x[c] for x in own] for c in ("h", "s", "all", "n")] + [[text[x["first"] : x["first"] + x["n"] + length - 1] for x in own]])

    marks_schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("marks", pa.binary())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_anchors((row for batch in batches for row in rows(batch, "h", "s", "all", "n", "text")), TOGETHER):
            with tempfile.TemporaryDirectory() as folder:
                others, marks = _sorted_marks(part, length, folder, memory)
            for a in range(0, len(marks), 10_000):
                own = others[a : a + 10_000]
                yield out_batch(marks_schema, [[x[0] for x in own], [x[1] for x in own], [None if x[2] else m for x, m in zip(own, marks[a : a + 10_000], strict=True)]])

    texts = _packed(keyed).select("k1", "k2", "z")
    pieces = texts.join(wanted, ["k1", "k2"]).select("z", "wanted").mapInArrow(tidied(cut), "h long, s long, all boolean, n int, text binary")
    marks = staged(pieces.repartition(spread(spark), "h").sortWithinPartitions("h").mapInArrow(tidied(sort), "h long, s long, marks binary"), "window-marks").dropDuplicates(["h", "s"])
    run = F.struct("first", "n", "marks")
    mixed = places.filter("mixed").join(marks, ["h", "s"]).filter("marks is null or octet_length(marks) > 0").select("k1", "k2", run.alias("run"))
    pure = places.filter("not mixed").select("k1", "k2", F.struct("first", "n", F.lit(None).cast("binary").alias("marks")).alias("run"))
    return mixed.unionByName(pure).groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))


def covered(size: int, runs: list[dict] | None, length: int) -> np.ndarray:
    """Which of size bytes are covered by the marked windows of runs."""
    edge = np.zeros(size + 1, np.int32)
    for r in runs or ():
        if r["marks"] is None:
            a, b = np.array([r["first"]]), np.array([r["first"] + r["n"] - 1])
        else:
            pairs = np.frombuffer(r["marks"], "<i4").reshape(-1, 2) + r["first"]
            a, b = pairs[:, 0], pairs[:, 1]
        np.add.at(edge, a, 1)
        np.add.at(edge, b + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: bytes, runs: list[dict] | None, length: int) -> tuple[bytes, int, int]:
    if not runs:
        return text, 0, 0
    gone = covered(len(text), runs, length)
    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), n_spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the bytes that stay."""
    keyed = _keyed(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, z, runs in rows(batch, "doc_id", "z", "runs"):
                text = zstd.decompress(z)
                kept, n, spans = _kept(text, runs, length)
                for c, v in zip(out, (doc_id, len(text), n, spans, kept), strict=True):
                    c.append(v)
            yield out_batch(schema, out)

    both = _packed(keyed).join(repeated_windows(keyed, length, kmer), ["k1", "k2"], "left").select("doc_id", "z", "runs")
    return both.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned_documents(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """Pipeline stage: documents less their repeated strings, with n_chars of the new text; a character that is cut in two goes.

    A document of which nothing stays, goes.
    """
    keyed = _keyed(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.lit(0).alias(n) if c == "text" else F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], keyed_text(docs).alias("text"), *[x.alias(a) for x, a in zip(_key_columns(docs), ("k1", "k2"), strict=True)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.drop("k1", "k2").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_kept(t.encode("utf-8", "replace"), r, length)[0].decode("utf-8", "ignore") for t, r in rows(batch, "text", "runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    both = plain.join(repeated_windows(keyed, length, kmer), ["k1", "k2"], "left").drop("k1", "k2")
    out = both.mapInArrow(tidied(run), schema).filter(F.length("text") > 0)
    return out.select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def keyed_text(docs: DataFrame):
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _key_columns(docs: DataFrame) -> tuple:
    text = keyed_text(docs)
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)), F.crc32(text.cast("binary")).cast("long")
