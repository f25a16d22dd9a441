"""The three deduplicating operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from heapscope.llm import lempel_ziv, ngram_join, substring_bytes
from heapscope.llm.graph import components
from heapscope.llm.suffix_sort import sort_suffixes


@pytest.mark.parametrize(("memory", "wide"), [(1 << 20, 4096), (16, 4096), (16, 2), (1 << 20, 0)])
def test_suffix_sort(memory, wide):
    rng = random.Random(5)
    for _ in range(300):
        k, cap = rng.choice([2, 3, 4, 9]), rng.choice([1000, 8])
        t = [rng.randrange(1, k + 1) for _ in range(rng.randrange(1, 60))] * rng.choice([1, 1, 5])
        t = [*t[:200], 0]
        out = []
        sort_suffixes(np.array(t, np.int32), k + 1, lambda p, c: out.append((p.copy(), c.copy())), cap, wide, None, memory)  # noqa: B023
        p, c = (np.concatenate(x).tolist() for x in zip(*out, strict=True))
        assert sorted(p) == list(range(len(t)))
        for i in range(1, len(p)):
            a, b = t[p[i] : p[i] + cap], t[p[i - 1] : p[i - 1] + cap]
            assert a <= b
            assert c[i] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("memory", [1 << 26, 1 << 16])
def test_suffix_sort_of_prose(spark, memory):
    """Ranks in memory, and recursion down to different names, at an alphabet of thousands of them; types over several blocks."""
    raw = "\n".join(r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()).encode()[:40_000]
    t = np.concatenate([np.frombuffer(raw, np.uint8).astype(np.int16) + 2, [0]]).astype(np.int16)
    out = []
    sort_suffixes(t, 258, lambda p, c: out.append((p.copy(), c.copy())), 100, 64, None, memory)
    p, c = (np.concatenate(x).tolist() for x in zip(*out, strict=True))
    text = t.astype(">u2").tobytes()
    assert sorted(p) == list(range(len(t)))
    cut = [text[2 * i : 2 * i + 200] for i in p]
    assert all(x >= y for x, y in zip(cut, cut[1:], strict=False))
    same = lambda a, b: next((k for k in range(0, min(len(a), len(b)), 2) if a[k : k + 2] != b[k : k + 2]), min(len(a), len(b))) // 2
    assert c[1:] == [same(x, y) for x, y in zip(cut, cut[1:], strict=False)]


def test_types_over_blocks(monkeypatch):
    from heapscope.llm import suffix_sort

    rng = np.random.default_rng(2)
    t = np.concatenate([rng.integers(1, 3, 500), [0]])
    want = [True] * 501
    for i in range(499, -1, -1):
        want[i] = bool(t[i] < t[i + 1] or t[i] == t[i + 1] and want[i + 1])
    for block in (1, 7, 1000):
        monkeypatch.setattr(suffix_sort, "BLOCK", block)
        assert suffix_sort._is_s(t).tolist() == want


def test_parts_hold_whole_anchors():
    rows = [(h, bytes(10)) for h in (1, 1, 2, 3, 3, 3, 3, 4)]
    parts = [[r[0] for r in part] for part in substring_bytes.by_anchors(iter(rows), 25)]
    assert parts == [[1, 1, 2], [3, 3, 3, 3], [4]] and list(substring_bytes.by_anchors(iter([]), 5)) == []


def cut_bytes(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(t), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize(("length", "kmer"), [(200, 64), (20, 8)])
def test_repeated_bytes(odd, length, kmer):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, cut_bytes([(r.text or "").encode() for r in rows], length), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_bytes.remove_repeats(odd, length, kmer).collect())
    assert got == want


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(substring_bytes, "PART", 1000)
    rng = random.Random(1)
    t = bytes(rng.randrange(97, 100) for _ in range(5000))
    _, _, first, n, _ = substring_bytes.slices(t, 50, 16)
    assert sorted(w for a, c in zip(first.tolist(), n.tolist(), strict=True) for w in range(a, a + c)) == list(range(5000 - 49))


def test_cleaned_documents_keep_columns(odd, empty):
    out = substring_bytes.cleaned_documents(odd)
    assert out.schema.names == odd.schema.names
    assert all(r.n_chars == len(r.text) > 0 for r in out.collect())
    assert substring_bytes.cleaned_documents(empty).count() == 0 and substring_bytes.remove_repeats(empty).count() == 0


def test_earlier_words(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    order = lambda r: 2**63 - 1 if r.doc_id is None else r.doc_id
    first = {}
    for r in sorted(rows, key=order):
        w = (r.text or "").encode().split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), order(r))
    want = []
    for r in rows:
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order(r):
                gone[i : i + 13] = [True] * 13
        want.append((str(r.doc_id), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = [(str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in lempel_ziv.remove_earlier(odd).collect()]
    assert sorted(got) == sorted(want)
    assert lempel_ziv.remove_earlier(empty).count() == 0


def test_factors_are_checked_at_their_ends():
    ref = lempel_ziv.Reference(3)
    g = lambda *w: np.array(w, np.int32)
    for words in (g(1, 2, 3, 4), g(3, 4, 5, 6)):
        windows = lempel_ziv.windows_of(words, 3)
        ref.add(words, windows, ~ref.parse(words, windows))
    words = g(1, 2, 3, 4, 5, 6, 7)
    assert ref.parse(words, lempel_ziv.windows_of(words, 3)).tolist() == [True, True, True, True, False]


def shingled(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets


def tops(rows):
    """A number for each row, the same in a component."""
    sets, up = shingled(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def brute_components(rows):
    sets, of, least = shingled(rows), tops(rows), {}
    for r, c in zip(rows, of, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return sorted((str(r.doc_id), len(s), str(least.get(c) if s else r.doc_id)) for r, s, c in zip(rows, sets, of, strict=True))


@pytest.mark.parametrize("tile", [1024, 2])
def test_components(odd, tile, monkeypatch):
    real = ngram_join.linked_sets
    monkeypatch.setattr(ngram_join, "linked_sets", lambda d, k, p: real(d, k, p, tile))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(odd).collect())
    assert got == brute_components(odd.collect())


@pytest.mark.parametrize("tile", [1024, 3])
def test_every_link_is_counted(odd, tile):
    rows = odd.collect()
    sets = [frozenset(ngram_join.shingles((r.text or "").encode()).tolist()) for r in rows]
    links = {s: sum(x != s and 100 * len(x & s) >= 80 * len(x | s) for x in set(sets)) if s else 0 for s in sets}
    assert max(links.values()) > 2
    got = sorted((str(r.doc_id), r.n_links) for r in ngram_join.link_counts(odd, tile=tile).collect())
    assert got == sorted((str(r.doc_id), links[s]) for r, s in zip(rows, sets, strict=True))


def test_one_of_each(odd, empty):
    out = ngram_join.one_of_each(odd)
    assert out.schema.names == odd.schema.names
    rows = odd.collect()
    component = dict(zip([(r.doc_id, r.text) for r in rows], tops(rows), strict=True))
    kept = out.collect()
    with_words = [r for r in kept if (r.text or "").split()]
    of = [component[r.doc_id, r.text] for r in with_words]
    assert len(of) == len(set(of)) and set(of) == {component[r.doc_id, r.text] for r in rows if (r.text or "").split()}
    assert len(kept) - len(with_words) == sum(not (r.text or "").split() for r in rows)
    ids = [r.doc_id for r in kept]
    assert 6 in ids and 7 not in ids and ids.count(3) == 2
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096])
@pytest.mark.parametrize(("a", "b"), [("a", "b"), ("L", "r")])
def test_words_that_polynomial_hashes_confuse(spark, n, a, b):
    x, y = thue_morse(n, a, b), thue_morse(n, b, a)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(1, f"{x} {common}"), (2, f"{y} {common}"), (3, " ".join([x] * 5)), (4, " ".join([y] * 5)), (5, x * 2), (6, y * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(docs.collect()) and [c for *_, c in got] == ["1", "1", "3", "4", "5", "6"]
    assert {r.doc_id: r.n_removed for r in lempel_ziv.remove_earlier(docs).collect()} == dict.fromkeys(range(1, 7), 0)
    cut = cut_bytes([t.encode() for _, t in rows], 200)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_bytes.remove_repeats(docs).collect())
    assert got == [(i, *c) for i, c in enumerate(cut, 1)]


def test_product_of_blocks():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, k, rng.integers(0, 60))).astype(np.uint64) for k in (50, 5000) * 20] for _ in "ab")
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert ngram_join.overlaps(a, b).tolist() == want
    assert ngram_join.overlaps(a[:1], b[:2]).tolist() == [want[0][:2]]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_unlike_texts_of_a_group_are_not_fetched(spark, monkeypatch):
    counts, real = {}, ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: (counts.setdefault(name, []).append((x := real(df, name)).count()), x)[1])
    # Three documents each share some n-grams, and are unlike otherwise.
    texts = [" ".join([*(f"s{i}x{j}" for j in range(12)), *(f"w{i}y{d}z{j}" for j in range(32))]) for i in range(60) for d in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.near_duplicates(docs).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 180
    assert sum(counts["groups"]) > 0 and sum(counts["pair-texts"]) == 0


def test_promising_rows_are_all_that_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 390), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(60)]
    sig = np.array([ngram_join.signature(x) for x in sets], np.int64).view(np.uint64)
    n, c = np.array([len(x) for x in sets]), rng.integers(0, 9, 60)
    for side in (np.full(60, 2), rng.integers(0, 2, 60)):
        hit = ngram_join.promising(side, c, n, sig, 80)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if side[i] != 1 and side[j] != 0 and c[i] != c[j]:
                    same = len(np.intersect1d(x, y))
                    assert 100 * same < 80 * (len(x) + len(y) - same) or (hit[i] and hit[j])
