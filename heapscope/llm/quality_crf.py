"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its score comes from its own features and those of the lines before and after, and the
states of neighbouring lines are tied by learned transitions. A document's quality is the mean of its lines'
forward-backward marginals for good, weighted by length. The field is trained here, by the gradient of its
log-likelihood, on a bounded sample of labelled documents whose lines all take the label of the document.

Null or empty text, or one of blank lines only: one empty line, scored like any. Null labels are no training rows; a doc_id
with several labels counts with each. Without both kinds of label the field stays at its start and all scores are
0.5. Repeated rows get equal scores. An empty table gives an empty result. Extra columns are ignored. doc_id, lang,
source and labels are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.llm.common import batches_of, out_batch, rows, small_batches, text_only, tidied

#: Features of a line by itself; with those of both neighbours, three times as many.
OWN = 16
SYMBOLS = re.compile(r"[#*$%&|<>]")
_letters, _upper, _digits, _marks = (re.compile(p) for p in (r"[^\W\d_]", r"[A-ZÀ-ÖØ-Þ]", r"\d", r"[.,;:!?]"))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines by OWN features, and the weight (length) of each line."""
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    out = np.zeros((len(lines), OWN), np.float32)
    weight = np.ones(len(lines))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, w = max(1, len(line)), max(1, len(words))
        weight[i] = n
        distinct = len(set(words))
        repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
        spaced = sum(len(x) == 1 and not x.isalnum() for x in words)
        out[i] = (
            1.0,
            min(1.0, np.log1p(len(line)) / 8),
            min(1.0, np.log1p(len(words)) / 6),
            len(_letters.findall(line)) / n,
            min(1.0, 4 * len(_upper.findall(line)) / n),
            min(1.0, 4 * len(_digits.findall(line)) / n),
            min(1.0, 10 * len(SYMBOLS.findall(line)) / n),
            min(1.0, 5 * len(_marks.findall(line)) / n),
            min(1.0, len(line) / w / 20),
            distinct / w,
            repeated / w,
            min(1.0, 4 * spaced / w),
            float(line in seen),
            float(line.rstrip()[-1:] in ".!?"),
            float(len(words) < 4),
            float("http" in line or "@" in line),
        )
        seen.add(line)
    return out, weight


def with_neighbours(own: np.ndarray) -> np.ndarray:
    none = np.zeros((1, own.shape[1]), own.dtype)
    return np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])], axis=1)


@dataclass
class Field:
    """emission: the score of good less that of bad; transition[a, b]: the score of state b after state a."""

    emission: np.ndarray
    transition: np.ndarray

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For documents laid end to end in x, longest first: P(good) of each line, the sums of pair marginals, and log Z summed."""
        e = x @ self.emission
        n = len(lengths)
        first = np.cumsum(lengths) - lengths
        longest = int(lengths[0]) if n else 0
        live = [int((lengths > t).sum()) for t in range(longest)]
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        tr = self.transition
        for t in range(longest):
            at = first[: live[t]] + t
            if t == 0:
                alpha[at, 1] = e[at]
                continue
            s = alpha[at - 1]
            for b in (0, 1):
                alpha[at, b] = np.logaddexp(s[:, 0] + tr[0, b], s[:, 1] + tr[1, b]) + (e[at] if b else 0)
        for t in range(longest - 2, -1, -1):
            at = first[: live[t + 1]] + t
            s = beta[at + 1] + np.stack([np.zeros(len(at)), e[at + 1]], axis=1)
            for a in (0, 1):
                beta[at, a] = np.logaddexp(s[:, 0] + tr[a, 0], s[:, 1] + tr[a, 1])
        both = alpha + beta
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        pairs = np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = np.exp(alpha[at - 1, a] + tr[a, b] + (e[at] if b else 0) + beta[at, b] - z[at]).sum()
        return good, pairs, float(z[first].sum())

    def quality(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i][1]))
        lengths = np.array([len(docs[i][1]) for i in order])
        good, _, _ = self.marginals(np.concatenate([with_neighbours(docs[i][0]) for i in order]).astype(np.float64), lengths)
        weight = np.concatenate([docs[i][1] for i in order])
        first = np.cumsum(lengths) - lengths
        out = np.zeros(len(docs))
        out[order] = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        return np.clip(out, 0.0, 1.0)


def train(docs: list[np.ndarray], labels: np.ndarray, steps: int = 120, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Adam on the mean log-likelihood of a document, each class weighted alike."""
    field = Field(np.zeros(3 * OWN), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        return field
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    x = np.concatenate([with_neighbours(docs[i]) for i in order]).astype(np.float64)
    y = labels[order].astype(float)
    line_y = np.repeat(y, lengths)
    # A document's pairs all are of its own state.
    seen = np.diag([((lengths - 1) * (1 - y)).sum(), ((lengths - 1) * y).sum()])
    m, v = np.zeros(3 * OWN + 4), np.zeros(3 * OWN + 4)
    for step in range(1, steps + 1):
        good, pairs, _ = field.marginals(x, lengths)
        g = np.concatenate([x.T @ (line_y - good), (seen - pairs).ravel()]) / len(x)
        p = np.concatenate([field.emission, field.transition.ravel()])
        g -= decay * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field = Field(p[: 3 * OWN], np.clip(p[3 * OWN :].reshape(2, 2), -4, 4))
    return field


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 3000, most_lines: int = 400) -> Field:
    """Trains on at most most_docs labelled documents outside the held-out fifth, drawn by hash; documents of over
    most_lines lines are no training rows. Both are bounds of the driver's memory, and of nothing else. They hold where
    doc_ids repeat, too: equal labels count once, as do rows of a doc_id with equal lines."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    sample = sample.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_docs)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_id, quality, text in rows(batch, "doc_id", "quality", "text"):
                if text.count("\n") < most_lines:
                    out[0].append(doc_id)
                    out[1].append(quality)
                    out[2].append(line_features(text)[0].tobytes())
            yield out_batch(schema, out)

    # The sample has at most most_docs rows of two numbers.
    chosen = text_only(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = chosen.mapInArrow(tidied(extract), "doc_id long, quality int, lines binary").distinct()
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "lines").limit(most_docs)
    got = sorted((bytes(r.lines), r.quality) for r in found.select("quality", "lines").toLocalIterator())
    return train([np.frombuffer(x, np.float32).reshape(-1, OWN) for x, _ in got], np.array([q for _, q in got]))


def _score_with(field: Field, text: str = "text"):
    emission, transition = field.emission, field.transition

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(emission, transition)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(text).to_pylist()
                # At most 64 texts at once, and of about a million characters in all if they are long.
                parts = [(i + x, i + y) for i in range(0, len(texts), 64) for x, y in batches_of([len(t or "") for t in texts[i : i + 64]])]
                done = np.concatenate([own.quality([line_features(t or "") for t in texts[x:y]]) for x, y in parts])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.float64())], names=[*part.schema.names, "_score"])

    return score


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score."""
    scored = text_only(docs).mapInArrow(tidied(_score_with(field)), "doc_id long, text string, _score double")
    return scored.select("doc_id", F.col("_score").alias("score"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: documents of quality `least` or more, with their columns. The field is trained on the whole table of documents, as
    the stage before may have left one kind of label only."""
    field = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    small_batches(spark)
    names = docs.columns
    plain = docs.toDF(*["text" if n == "text" else f"c{i}" for i, n in enumerate(names)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "_score double"])
    kept = plain.mapInArrow(tidied(_score_with(field)), schema).filter(F.col("_score") >= least).drop("_score")
    return kept.toDF(*names)
