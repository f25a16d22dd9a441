"""Mixture-controlled packing: deficit round-robin over source queues fills windows of a fixed number of tokens.

Each source has a queue of its documents' tokens and a quantum, its target share of a round; a round is of a window's
tokens at most. In each round every source is visited in turn and sends a packet: the tokens that its quanta so far
allow beyond what it has sent. Documents are cut wherever a packet ends. What is left of a quantum (less than a token) is
carried over rounds, windows and, as everything here is a function of running totals, partitions. So at every round's
end each source is less than a token from its target share, and a window, which is a round less and plus a token a source
at its ends, holds the mixture too. A source that runs dry leaves the later rounds to the others.

The schedule has a closed form: after r rounds a source has sent the first ceil(r * quantum) tokens of its queue. With
up to FEW sources a packet's place is the sum of these over all sources, so documents are cut where they lie, in arrays of a
bounded number of packets. With more, packets are ordered by (round, source, place in the queue), and running sums over
blocks, then within blocks, give each its place. No task holds a whole source: queues are cut into slices by a hash of the
document, summed one by one.

Null text: an empty document (its end id alone). Null source: a source of its own. Null and repeated doc_ids: kept,
each row is packed. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heapscope.llm.bpe import encoder
from heapscope.llm.common import batches_of, out_batch, spread, staged, text_only, tidied


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """row (unique), doc_id, source, n, ids (little-endian 16-bit words with end_id), staged: each text is encoded once.

    The vocabulary must be of 65,536 ids at most.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, short=True), struct.pack("<H", end_id)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batches_of([len(t) for t in texts], 1 << 22):
                part = batch.slice(a, b - a)
                ids = [x + end for x in enc.many(texts[a:b])]
                yield out_batch(schema, [part.column("doc_id"), part.column("source"), [len(x) // 2 for x in ids], ids])

    source = (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("source")
    out = text_only(docs, source).mapInArrow(tidied(encode, "bpe"), "doc_id long, source string, n long, ids binary")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "packed-ids")


def _before(value: str, *over: str, order: list) -> Column:
    w = Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


#: Up to so many sources the place of a packet is a sum over them.
FEW = 64
#: Packets that are worked on at a time, and rounds that doubles count exactly.
_PACKETS, _EXACT = 1 << 16, 1 << 53


def _rounds(
    lengths: DataFrame, window: int, packet_tokens: int, targets: Mapping[str, float] | None, slices: int, blocks: int
) -> tuple[DataFrame, list[tuple[int, float]], Callable[[DataFrame], DataFrame]]:
    """row, source, rank, c (tokens before it in its queue) and quantum of the rows in lengths. Then the tokens and quanta of the
    sources by rank, for _pieces, or none if the sources are many; and what makes pieces of the rows with their n in that case."""
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    docs = lengths.select("row", name.alias("source"), F.pmod(F.xxhash64("row"), F.lit(slices)).alias("slice"), "n")
    # Running totals of each queue: over its slices, then within a slice.
    per_slice = docs.groupBy("source", "slice").agg(F.sum("n").alias("t"))
    per_slice = per_slice.withColumn("slice_from", _before("t", "source", order=["slice"]))
    per_source = per_slice.groupBy("source").agg(F.sum("t").alias("source_tokens"))
    weight = F.col("source_tokens").cast("double")
    if targets:
        given = F.create_map(*[F.lit(x) for k, v in targets.items() for x in ("s" + k, float(v))])[F.col("source")]
        weight = F.coalesce(given, weight)
    per_source = per_source.withColumn("weight", weight)
    total = per_source.agg(F.sum("weight").alias("w"), F.sum("source_tokens").alias("t"), F.count("*").alias("sources")).first()
    # A round is a window, or less so that no packet is longer than packet_tokens. A source of no weight gets a token a round.
    round_tokens = min(window, packet_tokens)
    quantum = F.when(F.col("weight") > 0, F.col("weight") / F.lit(total["w"] or 1.0) * F.lit(float(round_tokens))).otherwise(1.0)
    sources = per_source.select("source", quantum.alias("quantum"), "source_tokens")
    # Up to FEW sources are numbered in their order, so that packets compare numbers.
    few = sorted((s.source, s.source_tokens, s.quantum) for s in sources.collect()) if total["sources"] <= FEW else []
    if any(tokens >= _EXACT * quantum for _, tokens, quantum in few):
        few = []
    rank = F.create_map(*[F.lit(x) for i, (s, *_) in enumerate(few) for x in (s, i)])[F.col("source")] if few else F.lit(0)
    queues = per_slice.join(sources, "source").select("source", "slice", "slice_from", "quantum", rank.alias("rank"))
    queued = docs.join(queues, ["source", "slice"]).select("row", "source", "rank", "quantum", (F.col("slice_from") + _before("n", "source", "slice", order=["row"])).alias("c"))

    def sent(r: Column, quantum: Column) -> Column:
        return F.ceil(r * quantum)

    def pieces(of: DataFrame) -> DataFrame:
        c, n, q, r = (F.col(x) for x in ("c", "n", "quantum", "round"))
        # By rounds, one more at each end as the division may round; by tokens where a packet is of one token and most rounds of none.
        span = F.when(q >= 1, F.sequence(F.greatest(F.lit(0), F.floor(c / q) - 1), F.floor((c + n) / q) + 1)).otherwise(F.sequence(c, c + n - 1))
        k, near = F.col("k"), F.floor(F.col("k") / q)
        of_token = near + F.when(sent(near, q) > k, -1).when(sent(near + 1, q) <= k, 1).otherwise(0)
        packets = of.filter("n > 0").select("*", F.explode(span).alias("k")).withColumn("round", F.when(q >= 1, k).otherwise(of_token))
        lo, hi = F.greatest(c, sent(r, q)), F.least(c + n, sent(r + 1, q))
        packets = packets.withColumn("lo", lo).withColumn("hi", hi).filter("lo < hi")
        # Over blocks of rounds (a bounded number of them), then within a block.
        rounds_in_block = max(1, -(-int(total["t"] or 0) // round_tokens // blocks))
        block = F.expr(f"round div {rounds_in_block}").alias("block")
        within = packets.select("*", block, (F.col("hi") - F.col("lo")).alias("length"))
        block_from = within.groupBy("block").agg(F.sum("length").alias("t")).select("block", _before("t", order=["block"]).alias("block_from"))
        placed = within.join(block_from, "block").withColumn("at", F.col("block_from") + _before("length", "block", order=["round", "source", "lo"]))
        # A packet over a window's edge is cut there.
        cut = placed.select("*", F.explode(F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + hi - lo - 1) div {window}"))).alias("sequence_id"))
        a, b = F.greatest("at", F.col("sequence_id") * window), F.least(F.col("at") + F.col("hi") - F.col("lo"), (F.col("sequence_id") + 1) * window)
        return cut.select(*of.columns, (F.col("lo") - F.col("c") + a - F.col("at")).alias("start"), (b - a).alias("length"), "sequence_id", (a - F.col("sequence_id") * window).alias("offset"))

    return queued, [(tokens, quantum) for _, tokens, quantum in few], pieces


def _pieces(batch: pa.RecordBatch, few: list[tuple[int, float]], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Place in the batch, start, length, sequence_id and offset of the pieces of its rows (c, n, quantum, rank), in order: a
    document's pieces follow each other without gaps, and so do documents. Some _PACKETS packets at a time, however long a document is."""
    c, n, q, rank = (batch.column(x).to_numpy() for x in ("c", "n", "quantum", "rank"))

    def sent(r: np.ndarray, quantum: np.ndarray | float) -> np.ndarray:
        return np.ceil(r * quantum).astype(np.int64)

    # By rounds, one more at each end as the division may round; by tokens where a packet is of one token and most rounds of none.
    by_rounds = q >= 1
    first = np.where(by_rounds, np.maximum(0, np.floor(c / q).astype(np.int64) - 1), c)
    count = np.where(n > 0, np.where(by_rounds, np.floor((c + n) / q).astype(np.int64) + 1, c + n - 1) - first + 1, 0)
    ends = np.cumsum(count)
    for a in range(0, int(ends[-1]) if len(ends) else 0, _PACKETS):
        at = np.arange(a, min(a + _PACKETS, int(ends[-1])))
        doc = np.searchsorted(ends, at, "right")
        r, quantum = first[doc] + at - (ends - count)[doc], q[doc]
        if not by_rounds[doc].all():
            near = np.floor(r / quantum).astype(np.int64)
            near += np.where(sent(near, quantum) > r, -1, np.where(sent(near + 1, quantum) <= r, 1, 0))
            r = np.where(by_rounds[doc], r, near)
        sent_before = sent(r, quantum)
        lo, hi = np.maximum(c[doc], sent_before), np.minimum((c + n)[doc], sent(r + 1, quantum))
        doc, r, sent_before, lo, hi = (x[lo < hi] for x in (doc, r, sent_before, lo, hi))
        # Sources before this one have sent their packets of the round, the others those of the rounds before.
        place, own = lo - sent_before, rank[doc]
        for i, (tokens, quantum_i) in enumerate(few):
            place += np.minimum(tokens, sent(r + (own > i), quantum_i))
        # A packet over a window's edge is cut there.
        until = place + hi - lo
        windows = (until - 1) // window - place // window + 1
        of = np.repeat(np.arange(len(doc)), windows)
        sequence = (place // window)[of] + np.arange(len(of)) - (np.cumsum(windows) - windows)[of]
        since = np.maximum(place[of], sequence * window)
        length = np.minimum(until[of], (sequence + 1) * window) - since
        yield doc[of], (lo - c[doc] - place)[of] + since, length, sequence, since - sequence * window


def schedule(lengths: DataFrame, window: int = 1024, packet_tokens: int = 1024, targets: Mapping[str, float] | None = None, slices: int = 64, blocks: int = 4096) -> DataFrame:
    """row, start, length, sequence_id, offset for every piece of the rows in lengths (row, source, n).

    targets gives the sources' weights (a source that is missing there has its own share of the tokens); by default all
    have their own share, so every window of the whole output holds the corpus mixture.
    """
    queued, few, pieces = _rounds(lengths, window, packet_tokens, targets, slices, blocks)
    names = ["row", "start", "length", "sequence_id", "offset"]
    of = queued.join(lengths.select("row", F.col("n").cast("long").alias("n")), "row")
    if not few:
        return pieces(of).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, *cut in _pieces(batch, few, window):
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc)), *map(pa.array, cut)], names=names)

    types = f"row {of.schema['row'].dataType.simpleString()}, start long, length long, sequence_id long, offset long"
    return of.select("row", "c", "quantum", "rank", "n").mapInArrow(tidied(run), types)


_PACKED = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
_DIGEST = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _types(names: list[str]) -> str:
    return ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids").cast(pa.large_binary())
        _, at, data = ids.buffers()
        edges = np.frombuffer(at, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        words = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]].view("<u2").astype("<u4")
        raw = memoryview(words.view(np.uint8))
        crc = [zlib.crc32(raw[a:b]) for a, b in pairwise(((edges - edges[0]) * 2).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in _DIGEST], names=_DIGEST)


def _packed(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, targets: Mapping[str, float] | None, checksums: bool) -> DataFrame:
    ids = tokenized(docs, tokenizer_path, end_id)
    queued, few, pieces = _rounds(ids.select("row", "source", "n"), window, window, targets, max(64, 2 * spread(docs.sparkSession)), 4096)
    of = queued.join(ids.select("row", "doc_id", "n", "ids"), "row")
    if not few:
        piece = F.expr("substring(ids, int(start) * 2 + 1, int(length) * 2)")
        placed = pieces(of).withColumn("doc_tokens", F.col("n")).withColumn("ids", piece).select(*_PACKED)
        return digest(placed) if checksums else placed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("ids").cast(pa.large_binary())
            _, at, data = whole.buffers()
            froms = np.frombuffer(at, np.int64)[whole.offset :]
            for doc, start, length, sequence, offset in _pieces(batch, few, window):
                # Pieces follow each other as their documents do, so they are these bytes with other edges.
                edges = np.concatenate([[0], np.cumsum(2 * length)])
                own = data.slice(int(froms[doc[0]] + 2 * start[0]), int(edges[-1])) if len(doc) else data
                parts = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), own])
                doc_id, n = (batch.column(x).take(pa.array(doc)) for x in ("doc_id", "n"))
                yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, (start, length)), n, *map(pa.array, (sequence, offset)), parts.cast(pa.binary())], names=_PACKED)

    out, run = (_DIGEST, lambda batches: _checksums(cut(batches))) if checksums else (_PACKED, cut)
    return of.select("doc_id", "n", "ids", "c", "quantum", "rank").mapInArrow(tidied(run), _types(out))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, targets: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 16-bit words) of every piece."""
    return _packed(docs, tokenizer_path, end_id, window, targets, False)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids as 32-bit words instead of the ids."""
    return packed.select(*_PACKED).mapInArrow(tidied(_checksums), _types(_DIGEST))


def packed_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, targets: Mapping[str, float] | None = None) -> DataFrame:
    """digest(pack(..)), by the tasks that cut the pieces."""
    return _packed(docs, tokenizer_path, end_id, window, targets, True)


def op4_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
