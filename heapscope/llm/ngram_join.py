"""Similarity join of documents by n-gram Jaccard, as a blocked sparse matrix product.

The matrix has a row for each distinct set of n-grams and a column for each n-gram. Two sets of sizes x and y that reach
the similarity overlap in at least z n-grams, z given by x and y; so in any common order of n-grams they share one
that is among the first x - z + 1 of one and the first y - z + 1 of the other. Only such entries choose what is
multiplied. The order puts n-grams first that a count sketch of fixed size, added up over all documents, shows to be rare.

1. Each document gives its set's hash, size and parity signature; equal sets become one row.
2. Entries go to blocks of columns. In each column, rows that have no partner at a place that their sizes allow are
   dropped. The others join the group of the column's smallest row, its centre. Two rows that link share a column that
   counts, so they share a group; a row is in few groups, as most of its columns have the same centre.
3. Rows whose sizes, places and signatures allow a link with the centre are verified against it; these links make components.
   Signatures of sets that link differ in no more bits than their sizes allow the sets to differ in.
4. A group with rows of several components is a block of the product: rows by n-grams, multiplied with its own transpose.
   Overlap counts are accumulated for all pairs of rows at once, in memory; pairs below the bound that their sizes give
   are discarded there, and only links that join components leave the block. A large group is cut into tiles of rows, by
   component, size and hash; pairs of tiles of one component, or of sizes that can't link, are left out. Rows that no signature
   of another component in their block allows a link with leave it before texts are fetched.

So no pair is made into a row but those of step 3 (rows of the matrix with their few centres) and links that join. A
group of thousands of near copies costs its size in step 3, and is of one component in step 4. link_counts() asks for
every link: then all groups are multiplied and all links returned, within components too.

Candidates come by hashes of 64 bits. Every link is decided on the words themselves. Fewer than n words: the whole sequence
is the one n-gram. No words or null text: an empty set, linked with nothing. Repeated rows: one set. Very long texts: whole,
a set of any size; tiles hold fewer of them. Null doc_id: takes part in links but is no component's smallest id, unless all
are null. Ties: a component's smallest doc_id may stand in several rows; all have it as their component. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.llm.common import batches_of, counter_slices, out_batch, rows, small_batches, spread, staged, summed_counters, tidied
from heapscope.llm.graph import components
from heapscope.llm.word_hash import hashed_words, mixed, ngrams

WORDS, PERCENT = 5, 80
#: Counters of the sketch, and the slices in which they are added up.
SKETCH, SLICES = 1 << 22, 64
#: Words of 64 bits in a signature: a bit is the parity of how many n-grams fall to it, so two sets differ in at least as
#: many n-grams as their signatures in bits.
SIGNATURE = 16
#: The most rows and n-grams in a tile; larger groups have several.
TILE, TILE_GRAMS = 1024, 2_000_000
#: Bits of the filter that chooses texts before they are dealt out, and its slices.
FILTER, FILTER_SLICES = 1 << 27, 64
#: Columns of at most so many rows are looked through pair by pair for rows without a partner.
SHORT = 16


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """For each text the distinct n-grams of its words as sorted hashes; A-Z count as a-z."""
    w, n = hashed_words(texts, fold=True)
    whole = ngrams(w, k)
    out, a = [], 0
    for m in n.tolist():
        out.append(np.unique(whole[a : a + m - k + 1] if m >= k else ngrams(w[a : a + m], m) if m else w[:0]))
        a += m
    return out


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    return shingle_sets([text], k)[0]


def set_hash(s: np.ndarray) -> int:
    return int(mixed(np.array([mixed(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def signature(s: np.ndarray) -> list[int]:
    bits = np.bincount((s & np.uint64(64 * SIGNATURE - 1)).astype(np.intp), minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def needed(na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap with 100 * overlap >= percent * union."""
    return -((-percent * (na + nb)) // (100 + percent))


def prefix(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of a set's first n-grams take part."""
    return n + (-percent * n) // 100 + 1


def _keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def _batch_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    texts = batch.column("text").to_pylist()
    for a, b in batches_of([len(t) for t in texts]):
        yield from shingle_sets([t.encode("utf-8", "replace") for t in texts[a:b]], k)


_SETS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("sig", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())])


def _sets(keyed: DataFrame, k: int) -> DataFrame:
    """doc_id, t (the text's hash), g (the set's hash), n and sig of each row; and from each task its sketch of n-gram counts, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int32)
        for batch in batches:
            g, n, sig, held = [], [], [], []
            for s in _batch_sets(batch, k):
                held.append((s >> np.uint64(42)).astype(np.int32))
                g.append(set_hash(s))
                n.append(len(s))
                sig.append(signature(s))
            if held:
                np.add(sketch, np.bincount(np.concatenate(held), minlength=SKETCH), out=sketch, casting="unsafe")
            yield out_batch(_SETS, [batch.column("doc_id"), batch.column("t"), g, n, sig, pa.nulls(len(g), pa.int32()), pa.nulls(len(g), pa.binary())])
        parts = counter_slices(sketch.astype(np.int64), SLICES)
        none = pa.nulls(len(parts), pa.int64())
        yield out_batch(_SETS, [none, none, none, [-1] * len(parts), pa.nulls(len(parts), pa.list_(pa.int64())), list(range(len(parts))), parts])

    return keyed.mapInArrow(tidied(run), "doc_id long, t long, g long, n long, sig array<long>, slice int, counts binary")


def _levels(sets: DataFrame) -> np.ndarray:
    """A level for each counter of the summed sketch: 0 up to what chance explains, then two more for each doubling."""
    total = summed_counters(sets.filter("n = -1"), SKETCH, SLICES)
    # Counters hold some mean of n-grams that share them, with a spread of its root; what stands out by four times that is common.
    spread_ = 4 * np.sqrt(total.mean()) + 4
    over = (total - total.mean()) / spread_
    return np.where(over <= 1, 0, np.ceil(2 * np.log2(np.maximum(over, 1)))).clip(0, 63).astype(np.uint8)


#: Entries of a document batch for one block: documents (g, n), and of each entry column, document and place.
_DOC = np.dtype([("g", "<i8"), ("n", "<i4")])


def _entries(keyed: DataFrame, levels, k: int, percent: int, blocks: int) -> DataFrame:
    schema = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("columns", pa.binary()), ("which", pa.binary()), ("place", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = np.array([(g, n) for g, n, _ in held], _DOC)
            columns = np.concatenate([c for *_, c in held])
            lengths = [len(c) for *_, c in held]
            which = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
            place = np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])
            block = (mixed(columns) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            edges = np.searchsorted(block[order], np.arange(blocks + 1))
            out: list[list] = [[], [], [], [], []]
            for b in range(blocks):
                own = order[edges[b] : edges[b + 1]]
                if len(own):
                    used, local = np.unique(which[own], return_inverse=True)
                    for c, v in zip(out, (b, table[used].tobytes(), columns[own].tobytes(), local.astype("<i4").tobytes(), place[own].tobytes()), strict=True):
                        c.append(v)
            return out_batch(schema, out)

        for batch in batches:
            for s in _batch_sets(batch, k):
                if not len(s):
                    continue
                g = set_hash(s)
                if g in seen:
                    continue
                seen.add(g)
                if len(seen) > 200_000:
                    seen.clear()
                key = level[(s >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
                first = int(prefix(np.array(len(s)), percent))
                held.append((g, len(s), np.sort(np.partition(key, first - 1)[:first])))
                size += first
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return keyed.select("text").mapInArrow(tidied(run), "block int, docs binary, columns binary, which binary, place binary")


def grouped(columns: np.ndarray, row: np.ndarray, place: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the centres of their groups, and whether a place they share allows a link with the centre.

    Entries are sorted by column, then size; rows are numbered, n is their size. A row is left out of a column where no other
    row's size and place allow a link.
    """
    edge = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1], [True]]))
    count = np.diff(edge)
    size = n[row]
    alive = np.zeros(len(row), bool)

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        need = needed(size[a], size[b], percent)
        return (place[a] <= size[a] - need) & (place[b] <= size[b] - need)

    for m in range(2, SHORT + 1):
        starts = edge[:-1][count == m]
        for i in range(m) if len(starts) else ():
            for j in range(i + 1, m):
                ok = fits(starts + i, starts + j)
                alive[starts[ok] + i] = True
                alive[starts[ok] + j] = True
    # In longer columns: the smaller of two rows that link is at a place that a row of its own size could link at. So a row
    # has a partner if it is at such a place and the next one is not too large, or if the last such one before is not too small.
    column = np.repeat(np.arange(len(count)), count)
    early = place <= size - needed(size, size, percent)
    long = (count > SHORT)[column]
    following = np.append((column[1:] == column[:-1]) & (percent * size[1:] <= 100 * size[:-1]), False) if len(row) else early
    last = np.maximum.accumulate(np.where(early, np.arange(len(row)), -1))
    before = np.concatenate([[-1], last[:-1]]) if len(row) else last
    has = (before >= edge[:-1][column]) & (percent * size <= 100 * size[before])
    alive |= long & ((early & following) | has)
    at = np.flatnonzero(alive)
    new = np.concatenate([[True], column[at][1:] != column[at][:-1]]) if len(at) else alive[:0]
    centre = at[np.flatnonzero(new)][np.cumsum(new) - 1] if len(at) else at
    code = row[centre] * np.int64(len(n)) + row[at]
    pairs, which = np.unique(code, return_inverse=True)
    ok = np.zeros(len(pairs), bool)
    ok[which[fits(centre, at)]] = True
    keep = pairs // len(n) != pairs % len(n) if len(pairs) else ok
    return pairs[keep] % len(n), pairs[keep] // len(n), ok[keep]


_GROUPS = pa.schema([("z", pa.int64()), ("g", pa.int64()), ("nz", pa.int64()), ("n", pa.int64()), ("fits", pa.bool_())])


def _groups(entries: DataFrame, blocks: int, percent: int) -> DataFrame:
    """z (a centre), g, their sizes, and whether a link is possible between them, for every row of a group but its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_block: dict[int, list] = {}
        for batch in batches:
            for b, *x in rows(batch, "block", "docs", "columns", "which", "place"):
                by_block.setdefault(b, []).append(x)
        while by_block:
            _, parts = by_block.popitem()
            docs = [np.frombuffer(x[0], _DOC) for x in parts]
            base = np.cumsum([0, *(len(d) for d in docs)])
            columns = np.concatenate([np.frombuffer(x[1], np.uint64) for x in parts])
            which = np.concatenate([np.frombuffer(x[2], "<i4") + o for x, o in zip(parts, base.tolist(), strict=False)])
            place = np.concatenate([np.frombuffer(x[3], "<i4") for x in parts]).astype(np.int64)
            table = np.concatenate(docs)
            del parts, docs
            # A set that several tasks have seen has one row.
            g, first, number = np.unique(table["g"], return_index=True, return_inverse=True)
            n = table["n"][first].astype(np.int64)
            row = number[which]
            order = np.lexsort((g[row], n[row], columns))
            columns, row, place = columns[order], row[order], place[order]
            new = np.concatenate([[True], (columns[1:] != columns[:-1]) | (row[1:] != row[:-1])])
            member, centre, ok = grouped(columns[new], row[new], place[new], n, percent)
            for i in range(0, len(member), 100_000):
                x, z = member[i : i + 100_000], centre[i : i + 100_000]
                yield out_batch(_GROUPS, [g[z], g[x], n[z], n[x], ok[i : i + 100_000]])

    found = entries.repartition(blocks, "block").mapInArrow(tidied(run), "z long, g long, nz long, n long, fits boolean")
    return found.groupBy("z", "g", "nz", "n").agg(F.bool_or("fits").alias("fits"))


def _near(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, na, nb) those whose signatures allow a link."""
    of = lambda end: signatures.select(F.col("g").alias(end), F.col("sig").alias(f"s{end}"))
    signed = pairs.join(of("a"), "a").join(of("b"), "b")
    bits = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SIGNATURE)), F.lit(0))
    # Sizes x and y that link overlap in `need`; they differ in at most x + y - 2 * need.
    need = F.expr(f"({percent} * (na + nb) + {100 + percent - 1}) div {100 + percent}")
    return signed.filter(bits <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")


def word_ngrams(text: bytes, k: int = WORDS) -> set[tuple[bytes, ...]]:
    """The n-grams themselves; A-Z count as a-z."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _alike(x: set, y: set, percent: int) -> bool:
    same = len(x & y)
    return 100 * same >= percent * (len(x) + len(y) - same)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of sets those that link, by their words; pairs that a task already has in one component are left out.

    texts: g and z, a row for each set.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        last, of_last, up = None, set(), {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            out: list[list] = [[], []]
            for a, b, za, zb in rows(batch, "a", "b", "za", "zb"):
                if top(a) == top(b):
                    continue
                if b != last:
                    last, of_last = b, word_ngrams(zstd.decompress(zb), k)
                if _alike(word_ngrams(zstd.decompress(za), k), of_last, percent):
                    up[top(a)] = top(b)
                    out[0].append(a)
                    out[1].append(b)
            yield out_batch(schema, out)
            if len(up) > 1_000_000:
                up.clear()

    with_a = pairs.join(texts.select(F.col("g").alias("a"), F.col("z").alias("za")), "a")
    both = with_a.join(texts.select(F.col("g").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(tidied(run), "a long, b long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of rows: how many n-grams each set of a shares with each of b.

    Columns with many entries are multiplied as matrices, a slice of columns at a time; the others pair by pair.
    """
    out = np.zeros(len(a) * len(b), np.int64)
    columns = np.concatenate([*a, *b])
    _, number = np.unique(columns, return_inverse=True)
    size = sum(len(s) for s in a)
    x, y = number[:size], number[size:]
    kinds = int(number.max()) + 1 if len(number) else 0
    in_a, in_b = np.bincount(x, minlength=kinds), np.bincount(y, minlength=kinds)
    row_a, row_b = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (a, b))
    pairs = in_a * in_b
    dense = pairs * 32 > len(out)
    if dense.any():
        place = np.cumsum(dense) - 1
        keep_a, keep_b = dense[x], dense[y]
        xa, ra, yb, rb = place[x[keep_a]], row_a[keep_a], place[y[keep_b]], row_b[keep_b]
        total = np.zeros((len(a), len(b)), np.float32)  # whole numbers below 2^24 are exact
        for lo in range(0, int(dense.sum()), 2048):
            left, right = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
            own = (xa >= lo) & (xa < lo + 2048)
            left[ra[own], xa[own] - lo] = 1
            own = (yb >= lo) & (yb < lo + 2048)
            right[rb[own], yb[own] - lo] = 1
            total += left @ right.T
        out += total.ravel().astype(np.int64)
    sparse = (pairs > 0) & ~dense
    if sparse.any():
        keep_a, keep_b = sparse[x], sparse[y]
        order_a, order_b = np.argsort(x[keep_a], kind="stable"), np.argsort(y[keep_b], kind="stable")
        xa, ra, rb = x[keep_a][order_a], row_a[keep_a][order_a], row_b[keep_b][order_b]
        first_b = np.cumsum(np.where(sparse, in_b, 0)) - in_b
        times = in_b[xa]
        edges = np.cumsum(times)
        lo = 0
        while lo < len(xa):
            hi = max(lo + 1, int(np.searchsorted(edges, (edges[lo - 1] if lo else 0) + 2_000_000, "right")))
            t = times[lo:hi]
            partner = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t) + np.repeat(first_b[xa[lo:hi]], t)
            out += np.bincount(np.repeat(ra[lo:hi], t) * len(b) + rb[partner], minlength=len(out))
            lo = hi
    return out.reshape(len(a), len(b))


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a and b reach the similarity, by their hashes."""
    same = overlaps(a, b)
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    return 100 * same >= percent * (na[:, None] + nb[None, :] - same)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _multiplied(blocks_: DataFrame, texts: DataFrame, k: int, percent: int, every: bool) -> DataFrame:
    """Links (a, b) found by multiplying blocks: those that join components, or every link.

    blocks_: of each row z, x, y (the group and the pair of tiles), side (0: first tile, 1: second, 2: both are this one), g and c.
    """

    def links(own: list[tuple]) -> Iterator[tuple[int, int]]:
        zstd = zstandard.ZstdDecompressor()
        sides = [[(g, c, zstd.decompress(z)) for side, g, c, z in own if side != skip] for skip in (1, 0)]
        a, b = (sorted(x) for x in sides)
        if not a or not b:
            return
        found = linked_pairs(*(shingle_sets([t for *_, t in x], k) for x in (a, b)), percent)
        up = {c: c for x in (a, b) for _, c, _ in x}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kept: dict[bytes, set] = {}

        def words(t: bytes) -> set:
            if len(kept) > 64:
                kept.clear()
            if t not in kept:
                kept[t] = word_ngrams(t, k)
            return kept[t]

        same_tile = own[0][0] == 2
        of = np.array([c for _, c, _ in b], np.int64)
        for i, (ga, ca, ta) in enumerate(a):
            at = np.flatnonzero(found[i])
            at = at[at > i] if same_tile else at
            if not every:
                at = at[of[at] != ca]
            for j in at.tolist():
                gb, cb, tb = b[j]
                if ga != gb and (every or top(ca) != top(cb)) and _alike(words(ta), words(tb), percent):
                    up[top(ca)] = top(cb)
                    yield min(ga, gb), max(ga, gb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (r for batch in batches for r in rows(batch, "z", "x", "y", "side", "g", "c", "text"))
        out: list[list] = [[], []]
        for _, own in groupby(given, key=lambda r: r[:3]):
            for x, y in links([r[3:] for r in own]):
                out[0].append(x)
                out[1].append(y)
            if len(out[0]) > 10_000:
                yield out_batch(_LINKS, out)
                out = [[], []]
        yield out_batch(_LINKS, out)

    dealt = blocks_.join(texts.withColumnRenamed("z", "text"), "g").repartition(spread(texts.sparkSession), "z", "x", "y").sortWithinPartitions("z", "x", "y")
    return dealt.select("z", "x", "y", "side", "g", "c", "text").mapInArrow(tidied(run), "a long, b long")


def _tiles(members: DataFrame, tile: int, grams: int, every: bool) -> DataFrame:
    """z, x, y, side, g, c: the rows of every pair of tiles (x and y of the group z) that is to be multiplied.

    members: z, g, n, c, all rows of groups that have several components (or of all groups). Tiles of one component, and of
    sizes that differ by more than the similarity allows, aren't paired.
    """
    sized = members.join(members.groupBy("z").agg(F.count("*").alias("m"), F.sum("n").alias("s")), "z")
    fits = (F.col("m") <= tile) & (F.col("s") <= grams)
    zero = F.lit(0).cast("long")
    small = sized.filter(fits).select("z", zero.alias("x"), zero.alias("y"), F.lit(2).alias("side"), "g", "c")
    large = sized.filter(~fits).select("z", "g", "n", "c")
    # Components with rows enough for half a tile have their own; the others share tiles.
    big = large.groupBy("z", "c").agg(F.count("*").alias("mc")).filter(F.col("mc") * 2 >= tile).select("z", "c", F.col("c").alias("own"))
    own = F.lit(None).cast("long") if every else F.col("own")
    # Sizes that link differ by a quarter at most, so they are of one band or of neighbouring ones.
    band = F.floor(F.log("n") / F.log(F.lit(1.26)))
    banded = large.join(big, ["z", "c"], "left").select("z", "g", "n", "c", own.alias("own"), band.alias("band"))
    key = ["z", F.coalesce("own", F.lit(0)).alias("of"), F.col("own").isNull().alias("mixed"), "band"]
    parts = F.ceil(F.greatest(F.count("*") / F.lit(float(tile)), F.sum("n") / F.lit(float(grams)), F.lit(1.0))).cast("long").alias("parts")
    shape = banded.groupBy(*key).agg(parts)
    number = F.xxhash64("of", "mixed", "band", "part").alias("t")
    named = banded.select("g", "c", *key).join(shape, ["z", "of", "mixed", "band"]).withColumn("part", F.pmod(F.xxhash64("g"), "parts")).select("z", "g", "c", number)
    tiles = shape.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("z", "of", "mixed", "band", number)
    left, right = (tiles.select("z", *(F.col(c).alias(c + i) for c in ("of", "mixed", "band", "t"))) for i in "12")
    pairs = left.join(right, "z").filter("t1 <= t2 and abs(band1 - band2) <= 1 and (mixed1 or mixed2 or of1 != of2)").select("z", F.col("t1").alias("x"), F.col("t2").alias("y"))
    end = lambda side, t: F.struct(F.lit(side).alias("side"), F.col(t).alias("t"))
    ends = pairs.select("z", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(end(2, "x"))).otherwise(F.array(end(0, "x"), end(1, "y")))).alias("e"))
    return small.unionByName(named.join(ends.select("z", "x", "y", "e.*"), ["z", "t"]).select("z", "x", "y", "side", "g", "c"))


_ROWS = pa.schema([("z", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("side", pa.int32()), ("g", pa.int64()), ("c", pa.int64())])


def promising(side: np.ndarray, c: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a block may link with a row of another component there, by sizes and signatures."""
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    hit = np.zeros(len(side), bool)
    for i in range(0, len(a), 256):
        own = a[i : i + 256]
        apart = np.zeros((len(own), len(b)), np.int64)
        for w in range(sig.shape[1]):
            apart += np.bitwise_count(sig[own, w][:, None] ^ sig[b, w][None, :])
        na, nb = n[own][:, None], n[b][None, :]
        need = needed(na, nb, percent)
        ok = (c[own][:, None] != c[b][None, :]) & (np.minimum(na, nb) >= need) & (apart <= na + nb - 2 * need)
        hit[own] |= ok.any(axis=1)
        hit[b] |= ok.any(axis=0)
    return hit


def _promising(blocks_: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The rows of _tiles() less those that link with no row of another component in their block; only the others need their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (r for batch in batches for r in rows(batch, "z", "x", "y", "side", "g", "c", "n", "sig"))
        out: list[tuple] = []
        for _, block in groupby(given, key=lambda r: r[:3]):
            own = list(block)
            side, c, n = (np.array([r[i] for r in own], np.int64) for i in (3, 5, 6))
            sig = np.array([r[7] for r in own], np.int64).view(np.uint64)
            out += [own[i][:6] for i in np.flatnonzero(promising(side, c, n, sig, percent)).tolist()]
            if len(out) > 10_000:
                yield out_batch(_ROWS, list(zip(*out, strict=True)))
                out = []
        if out:
            yield out_batch(_ROWS, list(zip(*out, strict=True)))

    dealt = blocks_.join(signatures.select("g", "n", "sig"), "g").repartition(spread(blocks_.sparkSession), "z", "x", "y").sortWithinPartitions("z", "x", "y")
    found = dealt.select("z", "x", "y", "side", "g", "c", "n", "sig").mapInArrow(tidied(run), "z long, x long, y long, side int, g long, c long")
    return staged(found, "blocks")


def _filter(hashes: DataFrame) -> bytes:
    """A bit for each of the hashes t, by its last digits. Slices are made by a task each; the driver gets them compressed."""
    each = FILTER // FILTER_SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("t").to_numpy().astype(np.int64) & (FILTER - 1)
            for i in np.unique(at // each).tolist():
                bits = held.setdefault(i, np.zeros(each, bool))
                bits[at[at // each == i] % each] = True
        zstd = zstandard.ZstdCompressor(level=1)
        for i, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zstd.compress(np.packbits(bits).tobytes())], pa.binary())], ["slice", "bits"])

    dealt = hashes.select("t").repartition(min(FILTER_SLICES, spread(hashes.sparkSession)), F.shiftright(F.col("t").bitwiseAND(FILTER - 1), each.bit_length() - 1))
    total, unzip = np.zeros((FILTER_SLICES, each // 8), np.uint8), zstandard.ZstdDecompressor()
    for r in dealt.mapInArrow(tidied(run), "slice int, bits binary").collect():
        total[r["slice"]] = np.frombuffer(unzip.decompress(bytes(r["bits"])), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(total.tobytes())


def _texts_of(keyed: DataFrame, sets: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """g and z, the compressed text of one document, for the sets in wanted (g).

    Of each set the text of the least hash is taken; a filter of fixed size leaves few others to be dealt out, and the join drops those.
    """
    schema = pa.schema([("g", pa.int64()), ("z", pa.binary())])
    least = sets.select("g", "t").join(wanted, "g", "left_semi").groupBy("g").agg(F.min("t").alias("t"))
    given = keyed.sparkSession.sparkContext.broadcast(_filter(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(given.value), np.uint8)
        zstd = zstandard.ZstdCompressor(level=3)
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("t").to_numpy().astype(np.int64) & (FILTER - 1)
            some = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            out: list[list] = [[], []]
            for (text,), s in zip(rows(some, "text"), _batch_sets(some, k), strict=True):
                g = set_hash(s)
                if g not in seen:
                    seen.add(g)
                    out[0].append(g)
                    out[1].append(zstd.compress(text.encode("utf-8", "replace")))
            if len(seen) > 200_000:
                seen.clear()
            yield out_batch(schema, out)

    packed = keyed.select("text", "t").mapInArrow(tidied(run), "g long, z binary")
    return staged(packed.join(wanted, "g", "left_semi").dropDuplicates(["g"]), "pair-texts")


def linked_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, tile: int = TILE, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (doc_id, t, g, n), the verified links between sets (a, b), and components (v, c).

    The links are enough of them to join what belongs together; or every link, whose number grows with the square of a group.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    first = staged(_sets(keyed, k), "sets")
    sets = first.filter("n >= 0").select("doc_id", "t", "g", "n")
    blocks = spread(spark)
    levels = spark.sparkContext.broadcast(_levels(first))
    groups = staged(_groups(_entries(keyed, levels, k, percent, blocks), blocks, percent), "groups")
    centres = groups.select("z", F.col("z").alias("g"), F.col("nz").alias("n")).distinct()
    members = groups.select("z", "g", "n").unionByName(centres)
    own = members.select("g").distinct()
    signatures = staged(first.filter("n > 0").select("g", "n", "sig").join(own, "g", "left_semi").dropDuplicates(["g"]), "signatures")
    if every:
        blocks_ = _promising(_tiles(members.withColumn("c", F.col("g")), tile, TILE_GRAMS, every), signatures, percent)
        texts = _texts_of(keyed, sets, blocks_.select("g").distinct(), k)
        links = staged(_multiplied(blocks_, texts, k, percent, every).distinct(), "links")
        return sets, links, staged(components(links), "labels")
    near = staged(_near(groups.filter("fits").select(F.col("g").alias("a"), F.col("z").alias("b"), F.col("n").alias("na"), F.col("nz").alias("nb")), signatures, percent), "near")
    texts = _texts_of(keyed, sets, near.select(F.explode(F.array("a", "b")).alias("g")).distinct(), k)
    links = staged(_verified(near, texts, k, percent), "links")
    label = staged(components(links), "labels").select(F.col("v").alias("g"), "c")
    # Groups with rows of several components; of two rows, the one pair has been looked at.
    labelled = staged(members.join(label, "g", "left").select("z", "g", "n", F.coalesce("c", "g").alias("c")), "members")
    several = labelled.groupBy("z").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("m > 2 and lo < hi").select("z")
    still = staged(labelled.join(several, "z"), "open-members")
    blocks_ = _promising(_tiles(still, tile, TILE_GRAMS, every), signatures, percent)
    if blocks_.isEmpty():
        return sets, links, label.withColumnRenamed("g", "v")
    more = staged(_multiplied(blocks_, _texts_of(keyed, sets, blocks_.select("g").distinct(), k), k, percent, every), "links")
    if more.isEmpty():
        return sets, links, label.withColumnRenamed("g", "v")
    # Links between components join components; only these are gone through again.
    ends = more.select(F.explode(F.array("a", "b")).alias("g")).distinct().join(label, "g", "left").withColumn("c", F.coalesce("c", "g"))
    ends = staged(ends, "ends")
    lifted = more.join(ends.withColumnsRenamed({"g": "a", "c": "ca"}), "a").join(ends.withColumnsRenamed({"g": "b", "c": "cb"}), "b")
    joined = components(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("v").alias("c"), F.col("c").alias("top"))
    whole = label.unionByName(ends).distinct().join(joined, "c", "left").select(F.col("g").alias("v"), F.coalesce("top", "c").alias("c"))
    return sets, links.unionByName(more), whole


def _classed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t, g, n and c, the least set of the component."""
    sets, _, comps = linked_sets(docs, k, percent)
    return sets.join(comps.select(F.col("v").alias("g"), "c"), "g", "left").withColumn("c", F.coalesce("c", "g"))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and g (the class of equal sets)."""
    sets, _, comps = linked_sets(docs, k, percent)
    label = comps.select(F.col("v").alias("g"), "c")
    smallest = sets.filter("n > 0").groupBy("g").agg(F.min("doc_id").alias("m")).join(label, "g", "left").withColumn("c", F.coalesce("c", "g"))
    of_set = smallest.join(smallest.groupBy("c").agg(F.min("m").alias("component_id")), "c")
    known = sets.join(of_set.select("g", "component_id"), "g", "left")
    alone = F.col("n") == 0
    return known.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "g")


def link_counts(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, g (the class of equal sets) and n_links, the number of other classes that the class links with, of each row."""
    sets, links, _ = linked_sets(docs, k, percent, tile, every=True)
    degree = links.select(F.explode(F.array("a", "b")).alias("g")).groupBy("g").agg(F.count("*").alias("n_links"))
    return sets.join(degree, "g", "left").select("doc_id", "g", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each component, with its columns; the smallest doc_id's, or among nulls and ties the least text hash's.

    A document goes only if another of its own component stays, so rows that share a doc_id, or have none, but are of other
    components all stay. Of rows with the same doc_id and text one stays. Documents without words stay.
    """
    found = _classed(docs, WORDS, PERCENT).filter("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("k2"), F.coalesce("doc_id", F.lit(0)).alias("k1"), "t")).alias("x"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = F.coalesce(docs["text"].cast("string"), F.lit("")), docs["doc_id"].cast("long")
    key = [F.coalesce(doc_id, F.lit(0)).alias("k1"), doc_id.isNull().alias("k2"), F.xxhash64(text).alias("t")]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], text.alias("text"), *key)
    has_words = F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    # Both the join and the choice of one row deal rows out by the same key.
    kept = plain.filter(has_words).join(found.select("x.*"), ["k1", "k2", "t"], "left_semi").dropDuplicates(["k1", "k2", "t"])
    both = kept.select(*names).unionByName(plain.filter(~has_words).select(*names))
    return both.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
