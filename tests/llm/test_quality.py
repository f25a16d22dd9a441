"""Quality rules and the line field, and the pipeline as a whole."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heapscope.llm import quality_crf as crf
from heapscope.llm import quality_rules as rules
from heapscope.llm.common import documents


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i for i, t in enumerate(three) if three.count(t) > 1}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(any(i - k in again for k in range(3)) for i in range(len(w)))


@pytest.mark.parametrize("text", ["", " ", "a", "a b c a b c", "a a a a", "x\nx\n \n\nx y", "é\x0bü\x0c#*", "p q r s p q r t\np q r s p q r t", "a b c d"])
def test_base_counts(text):
    assert rules.base_counts(text) == brute(text)


def test_base_counts_of_documents(spark, sf):
    for r in documents(spark, sf).limit(60).collect():
        assert rules.base_counts(r.text) == brute(r.text)


def test_ratio_by_hand(spark, odd, empty):
    d = spark.createDataFrame([(i, "good words only " * 20) for i in range(30)] + [(100 + i, "bad%%% junk### " * 30) for i in range(30)], "doc_id long, text string")
    trusted = d.filter("doc_id < 10").select("doc_id")
    got = {r.doc_id: r for r in rules.judge(d, trusted).collect()}
    c = np.zeros((2, rules.BINS))
    for r in d.collect():
        b = rules.bins_of(r.text)
        np.add.at(c[1], b, 1)
        if r.doc_id < 10:
            np.add.at(c[0], b, 1)
    w = rules.log_ratio(c).astype(np.float32)
    for r in d.collect():
        assert got[r.doc_id].llr == pytest.approx(float(w[rules.bins_of(r.text)].mean(dtype=np.float64)))
    # The threshold by hand: trusted documents scored with counts of the other ones.
    b = rules.bins_of("good words only " * 20)
    rest = c.copy()
    np.add.at(rest[0], b, -1)
    p = (rest + np.array([[rules.PRIOR], [rules.PRIOR * c[1].sum() / c[0].sum()]])) / np.array([[rest[0].sum() + rules.PRIOR * rules.BINS], [c[1].sum() + rules.PRIOR * c[1].sum() / c[0].sum() * rules.BINS]])
    score = float((np.log(p[0]) - np.log(p[1]))[b].mean())
    marked = d.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    parts = rules.counted(marked)
    assert (rules.bin_counts(parts) == c).all()
    limit = rules.threshold_of(parts, c.astype(np.int64))
    assert score - rules.MARGIN - 0.001 <= limit <= score - rules.MARGIN
    assert got[20].llr > limit > got[100].llr
    # A score at the threshold is kept.
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    at = rules.judge(long, long.select("doc_id")).first()
    assert at.kept and rules.judge(long, long.select("doc_id"), at.llr).first().kept and not rules.judge(long, long.select("doc_id"), at.llr + 1e-9).first().kept
    out = rules.judge(odd, odd.select("doc_id").limit(20))
    assert out.count() == odd.count() and all(r.kept <= (not r.base_failed) for r in out.collect())
    assert rules.judge(empty, empty.select("doc_id")).count() == 0
    assert rules.log_ratio(np.zeros((2, rules.BINS))).any() == False  # noqa: E712


def test_junk_is_told_from_prose(spark):
    big = "/root/testdata/sf0.01"
    out = rules.op7_llr_rules(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in out if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    field = crf.Field(rng.normal(size=3 * crf.OWN), rng.normal(size=(2, 2)))
    x = [rng.normal(size=(n, 3 * crf.OWN)) for n in (5, 3, 1)]
    good, pairs, log_z = field.marginals(np.concatenate(x), np.array([5, 3, 1]))
    want, want_pairs, want_z = [], np.zeros((2, 2)), 0.0
    for d in x:
        n = len(d)
        states = [[s >> i & 1 for i in range(n)] for s in range(2**n)]
        p = np.array([np.exp(sum((d[i] @ field.emission) * y[i] for i in range(n)) + sum(field.transition[y[i], y[i + 1]] for i in range(n - 1))) for y in states])
        want_z += np.log(p.sum())
        p /= p.sum()
        want += [sum(q for q, y in zip(p, states, strict=True) if y[i]) for i in range(n)]
        for q, y in zip(p, states, strict=True):
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += q
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    out = crf.op5_line_crf(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r.quality for r in out]), np.array([r.score for r in out])
    assert set(y.tolist()) == {0, 1}
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.95
    assert np.mean((s >= 0.3) == y) > 0.93


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (5, None)], "doc_id long, quality int")
    field = crf.fit(odd, labels)
    s = crf.score(odd, field).collect()
    assert len(s) == odd.count() and all(0 <= r.score <= 1 for r in s)
    assert crf.score(empty, crf.fit(empty, labels)).count() == 0
    one = crf.fit(odd, labels.filter("quality = 1"))
    assert {round(r.score, 9) for r in crf.score(odd, one).collect()} == {0.5}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, counts = documents(spark, sf), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            from heapscope.llm.common import staged

            docs = staged(docs, "test")
            assert docs.columns == names
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    stage = corpus_pipeline.STAGES[0][1](spark, documents(spark, sf), sf)
    kept = {r.doc_id for r in stage.collect()}
    long_good = {r.doc_id for r in documents(spark, sf).collect() if r.doc_id in good and len(r.text.split()) >= 50}
    assert len(long_good & kept) >= 0.95 * len(long_good)
    ids = [(r.sequence_id, r.offset) for r in docs.collect()]
    assert len(ids) == len(set(ids)) > 0


def test_training_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    sizes, real = [], crf.train
    monkeypatch.setattr(crf, "train", lambda docs, labels: (sizes.append(len(docs)), real(docs, labels, steps=2))[1])
    docs = spark.createDataFrame([(i, f"line {i}\n" * (1 + i % 5) + "junk%%% ###" * (i % 2)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = crf.fit(docs, labels, most_docs=20)
    again = crf.fit(docs.union(docs).union(docs), labels.union(labels), most_docs=20)
    unlike = docs.select("doc_id", F.concat("text", F.lit("\nmore 123 words")).alias("text"))
    crf.fit(docs.union(unlike), labels, most_docs=20)
    assert sizes == [20, 20, 20]
    assert np.array_equal(once.emission, again.emission)


def test_long_texts_are_scored_by_few(spark, monkeypatch):
    sizes, real = [], crf.Field.quality
    monkeypatch.setattr(crf.Field, "quality", lambda self, docs: (sizes.append(len(docs)), real(self, docs))[1])
    import pyarrow as pa

    score = crf._score_with(crf.Field(np.ones(3 * crf.OWN), np.zeros((2, 2))))
    texts = ["x" * 600_000 + "\ny"] * 5 + ["short", None]
    out = list(score(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert sum(b.num_rows for b in out) == sum(sizes) == 7 and max(sizes[:4]) == 1
    assert len({x for b in out for x in b.column("_score").to_pylist()[:5]}) == 1
