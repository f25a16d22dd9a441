"""Quality rules: countable base rules, then a log-likelihood ratio of hashed n-grams between two multinomials.

One multinomial is of the trusted target (documents marked good), one of the whole raw corpus, both over hashed word
unigrams and bigrams in a fixed number of bins, smoothed towards each other. A document's score is the mean over its n-grams of
log p_target - log p_raw. It is kept if it passes the base rules and its score is at least the threshold; the same
document over the same corpus always gets the same answer. Counts are over all documents: each task adds its own
into one row of bins, whose slices are added up; their size doesn't follow the input.

The threshold follows the corpus: all trusted documents are scored as if they weren't trusted (without their own counts
in the target), and it lies MARGIN below the score that a share LOWEST of them falls short of, to a thousandth.

Null or empty text: no words, base_failed, not kept. Repeated rows are judged one by one, and counted as often as they
occur. Very long texts are counted whole. A score that equals the threshold is kept. Null doc_id: never trusted. Without any
trusted document the ratio is 0 and the base rules alone decide. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.llm.common import SPACES, STORES, counter_slices, out_batch, rows, small_batches, staged, summed_counters, tidied

#: The share of trusted documents that may fall short, and how far below their score, in nats a n-gram, the threshold lies.
LOWEST, MARGIN = 0.01, 0.03
#: Trusted documents of fewer words don't count for the threshold, as the base rules reject them.
LEAST_WORDS = 50
BINS = 1 << 16
SLICES = 16
#: Counts that the target has in each bin beforehand; the raw corpus has as many in proportion, so a bin that was seen a
#: few times only says little for or against.
PRIOR = 4.0
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    pair = w[:-1] * len(number) + w[1:]
    _, pair = np.unique(pair, return_inverse=True)
    three = pair[:-1] * len(number) + w[2:]
    _, which, count = np.unique(three, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


_hashes: dict[bytes, int] = {}
STORES["bins"] = _hashes.clear


def bins_of(text: str) -> np.ndarray:
    """The bins of the unigrams, then of the bigrams. A store of word hashes is kept, and emptied when full."""
    words = text.lower().encode("utf-8", "replace").split()
    if len(_hashes) > 300_000:
        _hashes.clear()
    try:
        h = np.array([_hashes[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in _hashes:
                _hashes[w] = xxhash.xxh64_intdigest(w)
        h = np.array([_hashes[w] for w in words], np.uint64)
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    two ^= two >> np.uint64(31)
    return (np.concatenate([h, two]) >> np.uint64(48)).astype(np.int64) & (BINS - 1)


def counted(docs: DataFrame) -> DataFrame:
    """slice and counts: the two rows of BINS counts (of documents whose column trusted is true, and of all) of each task, in slices; and
    of each trusted document its bins and their counts (slice -1), so that it needn't be cut into words again."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            own = []
            for text, trusted in rows(batch, "text", "trusted"):
                bins = bins_of(text or "")
                c = np.bincount(bins, minlength=BINS)
                total[1] += c
                if trusted:
                    total[0] += c
                    if len(bins) >= 2 * LEAST_WORDS - 1:
                        bins = np.flatnonzero(c)
                        own.append(bins.astype("<u2").tobytes() + c[bins].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(own), pa.int32()), pa.array(own, pa.binary())], ["slice", "counts"])
        parts = counter_slices(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(parts))), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    small_batches(docs.sparkSession)
    return staged(docs.select(F.col("text").cast("string").alias("text"), "trusted").mapInArrow(tidied(count, "bins"), "slice int, counts binary"), "bins")


def bin_counts(parts: DataFrame) -> np.ndarray:
    """Two rows of BINS counts: of the trusted documents, and of all."""
    return summed_counters(parts.filter("slice >= 0"), 2 * BINS, SLICES).reshape(2, BINS)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    if not counts[0].sum():
        return np.zeros(BINS)
    total = counts.sum(axis=1).astype(float)
    prior = np.array([PRIOR, PRIOR * total[1] / total[0]])
    p = (counts + prior[:, None]) / (total + prior * BINS)[:, None]
    return np.log(p[0]) - np.log(p[1])


def score_without(bins: np.ndarray, own: np.ndarray, counts: np.ndarray) -> float:
    """The score that a trusted document with these counts of bins would have if it weren't trusted."""
    n, total = own.sum(), counts.sum(axis=1).astype(float)
    prior = PRIOR * total[1] / total[0]
    target = np.log((counts[0, bins] - own + PRIOR) / (total[0] - n + PRIOR * BINS))
    raw = np.log((counts[1, bins] + prior) / (total[1] + prior * BINS))
    return float(((target - raw) * own).sum() / n)


def threshold_of(parts: DataFrame, counts: np.ndarray, lowest: float = LOWEST, margin: float = MARGIN) -> float:
    """The threshold that all trusted documents give; -inf without any. Their scores are counted by thousandths."""
    if not counts[0].any():
        return -np.inf

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for (x,) in rows(batch, "counts"):
                k = len(x) // 6
                found = score_without(np.frombuffer(x, "<u2", k).astype(np.intp), np.frombuffer(x, "<u4", k, 2 * k).astype(np.int64), counts)
                scores.append(int(np.floor(found * 1000)))
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.int64())], ["score"])

    found = parts.filter("slice = -1").select("counts").mapInArrow(tidied(score), "score long").groupBy("score").agg(F.count("*").alias("n")).collect()
    need, seen = lowest * sum(r["n"] for r in found), 0
    for value, n in sorted((r["score"], r["n"]) for r in found):
        seen += n
        if seen >= need:
            return value / 1000 - margin
    return -np.inf


def judge(docs: DataFrame, trusted_ids: DataFrame, threshold: float | None = None, keep_columns: bool = False) -> DataFrame:
    """doc_id (or all columns), the base counts, base_failed, llr and kept. trusted_ids: the doc_ids of the target. threshold: the one
    that trusted documents give, if none is given."""
    trusted = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True)).hint("merge")  # alike at every size: the ids are never sent around
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = given.join(trusted, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    parts = counted(marked)
    counts = bin_counts(parts)
    if threshold is None:
        threshold = threshold_of(parts, counts)
    weights = log_ratio(counts).astype(np.float32).tobytes()
    first = docs.schema if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id")).schema
    given = docs if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    arrow = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in fields.split(", "))])
    own = [f.name for f in first]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(weights, np.float32)
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for (text,) in rows(batch, "text"):
                text = text or ""
                counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                bins = bins_of(text)
                llr = float(ratio[bins].mean(dtype=np.float64)) if len(bins) else 0.0
                for c, v in zip(out, (*counts, failed, llr, not failed and llr >= threshold), strict=True):
                    c.append(v)
            new = out_batch(arrow, out)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *new.columns], names=[*own, *arrow.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in first), fields])
    return given.mapInArrow(tidied(score, "bins"), schema)


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op7_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_documents(spark, sf_dir))


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # its own columns may have the names that judge() adds
    at = {n: f"c{i}" for i, n in enumerate(names)}
    given = plain.withColumnsRenamed({at["doc_id"]: "doc_id", at["text"]: "text"})
    kept = judge(given, trusted_documents(spark, sf_dir), keep_columns=True).filter("kept")
    return kept.select(*[F.col("doc_id" if n == "doc_id" else "text" if n == "text" else at[n]).alias(n) for n in names])
