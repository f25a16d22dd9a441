"""Token files, packing, pieces, FLAC and shards: exact round trips and covers."""

import hashlib
import io
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from heapscope.llm import flac, packing, pieces, sharding, token_files
from heapscope.llm.bpe import Encoder

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(BPE)
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("short", "forms"), [(False, 1000), (True, 1000), (False, 5)])
def test_words_are_cut_as_the_library_does(plain, short, forms):
    rng = random.Random(2)
    parts = ["a", "B", "é", " ", "\n", ".", ",", "'", "s", "_", "-", "1", " the", "\t", "²", "%", "  ", "<|endoftext|>", "漢", "😀", "\r\n", "\0", "\x1c", "…", "\xa0", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    e = Encoder(BPE, max_forms=forms, short=short)
    got = [x for a in range(0, 3000, 100) for x in e.many(texts[a : a + 100])]
    assert [np.frombuffer(x, "<u2" if short else "<u4").tolist() for x in got] == [plain(t) for t in texts]


def test_forms_of_many_texts_are_looked_up_once(plain):
    class Counted(dict):
        asked = 0

        def get(self, form):
            self.asked += 1
            return super().get(form)

    e, texts = Encoder(BPE), ["one two, one two.", "", "two  spaces  one", "漢字 one", "\0", "<|endoftext|> one"] * 50
    e.forms = Counted()
    assert [np.frombuffer(x, "<u4").tolist() for x in e.many(texts)] == [plain(t) for t in texts]
    assert e.forms.asked == len({"one", " two", ",", " one", ".", "two", " ", " spaces", "漢字", "\0", "<|endoftext|> one"})
    assert e.many([]) == [] and e.many(["", ""]) == [b"", b""] and e.many(["\0"]) == e.many(["", "\0"])[1:]


def test_token_files(spark, odd, empty, plain, tmp_path):
    manifest = token_files.write_token_files(odd, BPE, 2, f"file://{tmp_path}/t", frame_bytes=500)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*plain(r.text), 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.read_token_files(spark, manifest).collect()), key=lambda x: x[1])
    assert got == want
    none = token_files.write_token_files(empty, BPE, 2, f"file://{tmp_path}/e")
    assert token_files.read_token_files(spark, none).count() == 0


def test_single_documents_and_damage():
    b = io.BytesIO()
    w = token_files.TokenFileWriter(b, frame_bytes=64)
    for i in range(30):
        w.add(i, np.arange(i, dtype="<u4").tobytes())
    w.close()
    assert {k: v.tolist() for k, v in token_files.TokenFile(b).read([0, 3, 29]).items()} == {0: [], 3: [0, 1, 2], 29: list(range(29))}
    raw = bytearray(b.getvalue())
    # A seekable file is a series of zstandard frames and a skippable one.
    import zstandard

    assert len(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(raw))) > 0
    raw[10] ^= 255
    with pytest.raises(token_files.BadFrame):
        list(token_files.TokenFile(io.BytesIO(raw)).documents())


def test_packing_covers_each_id_once(odd, empty, plain):
    rows = packing.pack(odd, BPE).collect()
    places, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert len(r.ids) == 2 * r.length > 0
    want = sorted(sum((plain(r.text) + [0] for r in odd.collect()), []))
    assert sorted(np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u2").tolist()) == want
    for k, own in seqs.items():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == 1024 or k == max(seqs)
    one = sorted(places[11], key=lambda r: r.start)
    assert np.frombuffer(b"".join(bytes(r.ids) for r in one), "<u2").tolist() == plain(odd.filter("doc_id = 11").first().text) + [0]
    assert all(r.doc_tokens == sum(x.length for x in one) for r in one)
    assert packing.pack(empty, BPE).count() == 0


def test_every_window_has_the_target_mixture(spark):
    n = spark.createDataFrame([(i, "a" if i % 4 else "b", 100) for i in range(4000)], "row long, source string, n long")
    for targets, share in ((None, 0.25), ({"a": 1.0, "b": 1.0}, 0.5)):
        s = packing.schedule(n, targets=targets).join(n, "row").collect()
        by = defaultdict(lambda: defaultdict(int))
        for r in s:
            by[r.sequence_id][r.source] += r.length
        for k in range(10, 150):
            done = sum(by[i]["b"] for i in range(k + 1))
            assert abs(done - share * 1024 * (k + 1)) <= 2 * 1024


@pytest.mark.parametrize("few", [64, 0])
def test_single_windows_hold_the_mixture(spark, few, monkeypatch):
    monkeypatch.setattr(packing, "FEW", few)
    rng = random.Random(4)
    n = spark.createDataFrame([(i, None if i % 20 == 0 else f"s{i % 20}", rng.randrange(1, 900)) for i in range(1500)] + [(1500, "tiny", 7)], "row long, source string, n long").cache()
    lengths = {r.row: r for r in n.collect()}
    total, own = sum(r.n for r in lengths.values()), defaultdict(int)
    for r in lengths.values():
        own[r.source] += r.n
    by, covered = defaultdict(lambda: defaultdict(int)), defaultdict(list)
    seqs = defaultdict(list)
    for r in packing.schedule(n).collect():
        by[r.sequence_id][lengths[r.row].source] += r.length
        covered[r.row].append((r.start, r.start + r.length))
        seqs[r.sequence_id].append((r.offset, r.offset + r.length))
    for spans, whole in [(covered[k], r.n) for k, r in lengths.items()] + [(v, 1024 if k < max(seqs) else total % 1024 or 1024) for k, v in seqs.items()]:
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == whole and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    for k in range(total // 1024):
        assert all(abs(by[k][s] - 1024 * t / total) <= len(own) + 2 for s, t in own.items())
        assert sum(abs(by[k][s] / 1024 - t / total) for s, t in own.items()) / 2 < 0.03


def test_documents_are_cut_where_they_lie(spark, odd, monkeypatch):
    """In arrays, not in a copy of the document for each piece; and as running sums over all packets place them."""
    n = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 7}", i % 90 * (50 if i % 13 == 0 else 1)) for i in range(1500)] + [(1500, "tiny", 7), (1501, "é", 1), (1502, "s1", 30000)], "row long, source string, n int")
    forms = [{}, {"window": 64, "packet_tokens": 10}, {"targets": {"s1": 5.0, "s2": 0.0, "tiny": 1e-3}}]
    got = [packing.schedule(n, **kw) for kw in forms]
    assert all("Generate" not in x._jdf.queryExecution().toString() for x in (*got, packing.pack(odd, BPE), packing.packed_digest(odd, BPE)))
    monkeypatch.setattr(packing, "FEW", 0)
    want = [sorted(map(tuple, packing.schedule(n, **kw).collect())) for kw in forms]
    assert [sorted(map(tuple, x.collect())) for x in got] == want
    rows = lambda d: sorted(map(str, d.collect()))
    many = rows(packing.packed_digest(odd, BPE))
    monkeypatch.undo()
    assert rows(packing.packed_digest(odd, BPE)) == rows(packing.digest(packing.pack(odd, BPE))) == many


@pytest.mark.parametrize("packets", [1, 7, 1 << 16])
def test_a_long_document_is_cut_in_parts(packets, monkeypatch):
    monkeypatch.setattr(packing, "_PACKETS", packets)
    c, n, rank = [0, 0, 300, 3], [300, 3, 500, 0], [0, 1, 0, 1]
    quanta = [800 / 803 * 16, 3 / 803 * 16]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (c, n, [quanta[i] for i in rank], rank)], names=["c", "n", "quantum", "rank"])
    got = [x for cut in packing._pieces(batch, [(800, quanta[0]), (3, quanta[1])], 16) for x in zip(*(v.tolist() for v in cut), strict=True)]
    at, order = defaultdict(int), []
    for doc, start, length, sequence, offset in got:
        assert start == at[doc] and 0 < length <= 16 - offset
        at[doc] += length
        order += [(sequence, offset + i) for i in range(length)]
    assert at == {0: 300, 1: 3, 2: 500} and [x[0] for x in got] == sorted(x[0] for x in got)
    assert sorted(order) == [divmod(i, 16) for i in range(803)]


def test_pieces_without_dropout_are_the_librarys():
    e = pieces.DropoutEncoder(PIECES, 0.0)
    for t in ("", "Hello  wörld\n\nx   ", "<s> </s>", "日本語 text ▁x", "a" * 80):
        assert np.frombuffer(e.encode(t, 1), "<u4").tolist() == e.model.encode(t)


def test_dropout_varies_and_decodes(odd, empty):
    e = pieces.DropoutEncoder(PIECES, 0.3, seed=5)
    text = "the information about segmentation " * 20
    ids = {e.encode(text, i) for i in range(4)}
    assert len(ids) > 1 and {e.decode(x) for x in ids} == {text} and e.encode(text, 1) == e.encode(text, 1)
    coded = pieces.encode(odd, PIECES, 0.2, 9)
    got = sorted((str(r.doc_id), r.text) for r in pieces.decode(coded, PIECES).collect())
    assert got == sorted((str(r.doc_id), e.normalised(r.text or "")) for r in odd.collect())
    assert pieces.digest(pieces.encode(empty, PIECES), PIECES).count() == 0


def test_dropout_is_drawn_for_each_occurrence():
    e, word = pieces.DropoutEncoder(PIECES, 0.1, seed=3), "segmentation"
    whole, came, _ = e.pieces("▁" + word)
    # Each of the merges alone is skipped in some document; segmentations are as frequent as with a coin for each candidate.
    want = {e._ids(whole)}
    for k in range(came):
        alone = pieces.DropoutEncoder(PIECES, 0.0)
        alone._passing = lambda x, n: pieces._NEVER
        want.add(e._ids(alone.pieces("▁" + word, k)[0]))
    got = [e.encode(word, i) for i in range(8000)]
    assert want <= set(got) and len(set(got)) > 4
    rng, coins = random.Random(6), pieces.DropoutEncoder(PIECES, 0.0)
    coins._passing = lambda x, n: next(i for i in range(1000) if rng.random() < 0.1)
    thrown = [e._ids(coins.pieces("▁" + word, coins._passing(0, 0))[0]) for _ in range(8000)]
    assert all(abs(got.count(x) - thrown.count(x)) < 240 for x in {*got, *thrown})
    # What else is in a batch changes nothing.
    text = "the information about segmentation is in a text with " + "x" * 90
    assert e.encode_many([text, "", "other"] * 100, list(range(300))) == [e.encode(t, i) for i, t in enumerate([text, "", "other"] * 100)]
    # Places in one text have draws of their own too.
    assert len({e.encode(word + " " + " ".join([word] * k), 1)[-40:] for k in range(50)}) > 4


def naive_agenda(e, word, first, x):
    """One candidate at a time: the best merge of neighbours that isn't skipped, the leftmost of equals."""
    symbols, skipped, came, due, times = [(i, c) for i, c in enumerate(word)], set(), 0, first, 0
    while True:
        found = [(e.cost[a + b], i, j, a + b) for j, ((i, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in e.cost and (i, a + b) not in skipped]
        if not found:
            return [s for _, s in symbols]
        _, i, j, both = min(found)
        came += 1
        if came > due:
            skipped.add((i, both))
            times += 1
            due = came + e._passing(x, times)
        else:
            symbols[j : j + 2] = [(i, both)]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 0.9])
def test_dropout_against_a_naive_agenda(dropout):
    e, rng = pieces.DropoutEncoder(PIECES, dropout, seed=8), random.Random(3)
    letters = "abcdeiorst-_9é漢😀"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 7, 12, 30, 90, 300]))) for _ in range(150)] + ["segmentation", "information"] * 20
    text = " ".join(words)
    keys = [(xxhash.xxh64_intdigest((5).to_bytes(8, "little"), 8) + at * 0x9E3779B97F4A7C15) % 2**64 for at in range(len(words))]
    want = b"".join(e._ids(naive_agenda(e, "▁" + w, e._passing(x, 0), x)) for w, x in zip(words, keys, strict=True))
    assert e.encode(text, 5) == want


def test_flac_round_trip(odd, empty):
    rng = np.random.default_rng(1)
    payloads = [flac.padded(r.text or "") for r in odd.collect()] + [bytes(192), bytes(range(192)), rng.integers(0, 256, 1920, dtype=np.uint8).tobytes(), b"\0\xff" * 96]
    streams = flac.encode_many(payloads)
    for decoded in (flac.decode_many(streams), [flac._one_by_one(s) for s in streams]):
        assert [(x.astype(np.int16) + 128).astype(np.uint8).tobytes() for x in decoded] == payloads
    big = flac.encode_many([flac.padded("seekable " * 9000)])[0]
    whole = flac.decode_many([big])[0]
    assert (flac.samples_from(big, 60_001, 700) == whole[60_001:60_701]).all()
    got = {(r.doc_id, r.n_bytes, r.payload_sha256) for r in flac.media_digest(flac.to_media(odd)).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), hashlib.sha256(flac.padded(r.text or "")).hexdigest()) for r in odd.collect()}
    blocks = sorted((r.first_sample, bytes(r.pcm)) for r in flac.pcm_blocks(flac.to_media(odd).filter("doc_id = 11"), 1000).collect())
    assert b"".join(b for _, b in blocks) == flac.padded(odd.filter("doc_id = 11").first().text)
    assert flac.media_digest(flac.to_media(empty)).count() == 0
    assert flac.last_seek_point(big) == 49_152


def test_flac_damage():
    s = bytearray(flac.encode_many([flac.padded("some words " * 60)])[0])
    for at in (70, len(s) - 3, 90):
        bad = bytearray(s)
        bad[at] ^= 1
        with pytest.raises(flac.BadStream):
            flac.decode_many([bytes(bad)])


def bits(*fields):
    out = "".join(format(v & ((1 << n) - 1), f"0{n}b") if n else v for v, n in fields)
    out += "0" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))


def test_general_predictor_partitions_and_escapes():
    """A subframe made by hand: order 2 with coefficients 2, -1 at shift 1, two partitions, the second one raw."""
    x = [3, -4]
    residuals = [1, -2, 5, 0, -3, 2]
    for r in residuals:
        x.append(r + ((2 * x[-1] - x[-2]) >> 1))
    rice = [((2 * r if r >= 0 else -2 * r - 1)) for r in residuals[:2]]
    fields = [(0, 1), (33, 6), (0, 1), (3, 8), (-4, 8), (3, 4), (1, 5), (2, 4), (-1, 4), (0, 2), (1, 4), (1, 4)]
    for u in rice:
        fields += [("0" * (u >> 1) + "1", 0), (u & 1, 1)]
    fields += [(15, 4), (5, 5)] + [(r, 5) for r in residuals[2:]]
    assert flac.decode_subframe(bits(*fields), 0, 8, 8)[0] == x


def test_shards(odd, empty):
    rows = sharding.assign_shards(odd, 4, sample_rows=64, ranges_per_shard=4).collect()
    assert len(rows) == odd.count()
    own = defaultdict(list)
    for r in rows:
        own[r.shard].append(r)
    assert sorted(sum(([(str(r.doc_id), r.size, r.text_crc32) for r in v] for v in own.values()), [])) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    for v in own.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    assert sharding.assign_shards(empty).count() == 0


def test_shards_are_even_and_a_hot_text_is_split(spark):
    d = spark.createDataFrame([(i, "the same text" if i % 2 else f"text {i}") for i in range(4000)], "doc_id long, text string")
    rows = sharding.assign_shards(d, 8).collect()
    size, of = defaultdict(int), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        of[r.text_crc32].add(r.shard)
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 8
    assert sum(len(x) > 1 for x in of.values()) == 1
    plan = sharding.assign_shards(d, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_hot_text_without_ids_is_split(spark):
    d = spark.createDataFrame([(None if i % 2 else i, "the same text" if i % 3 else f"text {i}") for i in range(4000)], "doc_id long, text string")
    rows = sharding.assign_shards(d, 8, ranges_per_shard=64).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.size
    assert len(rows) == 4000 and max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 8
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(8) for i in range(sum(r.shard == k for r in rows))]


def test_ranges_are_those_of_the_splitters(spark):
    rng = random.Random(4)
    splitters = sorted({(rng.randrange(-(2**63), 2**63), rng.choice([-(2**63), 7]), 0) for _ in range(300)} | {(5, d, 0) for d in range(9)} | {(9, -(2**63), r) for r in range(9)})
    keys = splitters[::3] + [(h, d + 1, r) for h, d, r in splitters[::5]] + [(rng.randrange(-(2**63), 2**63), 0, 0) for _ in range(300)] + [(-(2**63), 0, 0), (2**63 - 1, 0, 0)]
    df = spark.createDataFrame([(k,) for k in keys], "key struct<h: long, d: long, r: long>")
    got = [(tuple(r.key), r.x) for r in df.select("key", sharding._range_of(df["key"], splitters).alias("x")).collect()]
    assert got == [(k, sum(s <= k for s in splitters)) for k in keys]


def test_written_shards(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}", i % 5) for i in range(500)], "doc_id long, text string, kind long")
    sharding.write_shards(d, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    placed = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(d, 4).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == placed
    assert sorted((r.doc_id, r.text, r.kind) for r in back.collect()) == sorted(map(tuple, d.collect()))
    with pytest.raises(ValueError):
        sharding.write_shards(d.withColumnRenamed("kind", "slot"), f"file://{tmp_path}/t")


def test_queries_as_registered(spark, sf):
    """Each on the whole table, against what the contract says."""
    docs = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t = Tokenizer.from_file(BPE)
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    start, want = 0, []
    for i in sorted(docs):
        own = [*ids[i], 2]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    got = token_files.op2_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    pieces_of, places = defaultdict(list), defaultdict(list)
    for r in packing.op4_deficit_packing(spark, sf).collect():
        own = [*ids[r.doc_id], 0]
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length]) and r.doc_tokens == len(own)
        pieces_of[r.doc_id].append((r.start, r.start + r.length))
        places[r.sequence_id].append((r.offset, r.offset + r.length))
    assert set(pieces_of) == set(docs)
    for spans, whole in [(v, len(ids[i]) + 1) for i, v in pieces_of.items()] + [(v, 1024 if k < max(places) else max(b for _, b in v)) for k, v in places.items()]:
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == whole <= max(1024, whole) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    e = pieces.DropoutEncoder(PIECES)
    got = {r.doc_id: r for r in pieces.op6_merge_dropout(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, x in docs.items():
        own, text = e.encode(x, i), e.normalised(x).encode()
        assert (got[i].n_pieces, got[i].ids_crc32, got[i].n_bytes, got[i].text_sha256) == (len(own) // 4, zlib.crc32(own), len(text), hashlib.sha256(text).hexdigest())
    for r in flac.op9_flac(spark, sf).collect():
        raw = flac.padded(docs[r.doc_id])
        stream = flac.encode_many([raw])[0]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest()) and r.pcm_blocks == -(-len(raw) // 65536)
    rows = sharding.op10_sampled_splitters(spark, sf).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in docs.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} == set(range(8))


def test_struct_is_little_endian():
    assert struct.pack("<I", 2) == b"\2\0\0\0"
