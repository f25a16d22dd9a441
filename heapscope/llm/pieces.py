"""SentencePiece BPE with seeded merge-dropout: varied segmentations that decode to the same text.

Encoding works through an agenda of candidate merges, best score first. Each candidate that comes up is skipped with
the dropout rate. The draws are keyed by the seed, doc_id and the word's place in the text, so every occurrence of a
word has its own: a draw says how many candidates pass until one is skipped, the next one how many pass after that.
Merges never cross a word's start. The same text with the same doc_id and seed always gives the same ids; decode() gives
back the normalised text, byte for byte. Characters without a piece become their bytes' pieces. At dropout 0 the result is
that of the sentencepiece library.

The agendas of a batch's words are worked through together, one candidate of each word at a time, in arrays: for each
place the piece that begins there, its neighbours, and the cost of its merge with the next one. A batch's forms are first
merged without dropout; occurrences whose first skip comes after their last candidate have that result, and the others an
agenda of their own. Nothing is kept from one batch to the next. Words of over 256 characters have an agenda of their own in a heap.

Null text: no pieces. Null doc_id: hashed as -1. Repeated rows: equal ids, as doc_id and place are equal. Very long texts are
encoded whole; a batch is a text at least. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from heapscope.llm.common import batches_of, out_batch, rows, text_only, tidied

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MIX = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1342543DE82EF95
#: No word has so many candidates.
_NEVER = 1 << 40


class _Pairs:
    """The piece that two pieces make together, by their numbers: a hash table in arrays."""

    def __init__(self, ids: dict[str, int], size: int):
        found = [(ids[p[:i]] * size + ids[p[i:]], m) for p, m in ids.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        key, made = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        bits = max(4, int(4 * len(key) + 1).bit_length())
        self.size, self.shift, self.mask = size, np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.key[slot[left]] == -1]
            self.key[slot[free]] = key[free]
            put = self.key[slot[left]] == key[left]
            self.made[slot[left[put]]] = made[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(_MIX)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where they make none, or one of them is -1."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        k = self.key[slot]
        out = np.where(k == key, self.made[slot], np.int32(-1))
        rest = np.flatnonzero((k != key) & (k >= 0) & (key >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            k = self.key[slot[rest]]
            hit = k == key[rest]
            out[rest[hit]] = self.made[slot[rest[hit]]]
            rest = rest[~hit & (k >= 0)]
        return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, then from starts[1] on, and so forth."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class DropoutEncoder:
    #: Words of up to so many characters are worked through in arrays of these widths.
    WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)

    def __init__(self, model_path: str, dropout: float = 0.1, seed: int = 1):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_byte(i))]
        self.ids = {self.model.id_to_piece(i): i for i in plain}
        self.cost = {self.model.id_to_piece(i): -self.model.get_score(i) for i in plain}
        self.byte = {int(self.model.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        self.bytes_of = [self.model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word's start")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that isn't a piece")
        self.prefix = self.model.normalize("a") == SPACE + "a"
        self.dropout, self.seed = dropout, seed
        #: A draw's logarithm over this is how many candidates pass.
        self.scale = math.log1p(-dropout) if dropout < 1 else -math.inf
        self.first_unknown = n
        self.pairs = _Pairs(self.ids, n + 0x110000)
        #: Costs by piece; the last one is of the piece -1, of no merge.
        self.cost_of = np.full(n + 1, np.inf, np.float32)
        self.cost_of[plain] = [-self.model.get_score(i) for i in plain]
        #: Characters' pieces; those without one have numbers beyond the pieces, and their bytes' pieces at the end.
        self.char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _passing(self, x: int, k: int) -> int:
        """How many candidates pass before the k-th that is skipped, by a hash keyed by the occurrence x."""
        return int(self._passing_of(np.array([x], np.uint64), np.array([k], np.uint64))[0])

    def _passing_of(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """_passing of many."""
        x = x + k * np.uint64(_STEP)
        x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX_1)
        x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX_2)
        u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * -(2.0**-53)
        return np.minimum(np.log1p(u) / self.scale, _NEVER).astype(np.int64)

    def pieces(self, word: str, first: int = _NEVER, x: int = 0) -> tuple[list[str], int, list[int]]:
        """The agenda in a heap: candidates by score, then place; symbols linked to their neighbours. The candidate of number
        `first` is the first to be skipped, the others follow from x. Also how many candidates came up and which were skipped."""
        came, skipped, due = 0, [], first
        symbols: list[str | None] = list(word)
        n, score = len(symbols), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, both) for i in range(n - 1) if (c := score.get(both := word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            own = symbols[i]
            if own is None or (j := after[i]) >= n or len(own) + len(symbols[j]) != len(both) or own + symbols[j] != both:
                continue
            came += 1
            if came > due:
                skipped.append(due)
                due = came + self._passing(x, len(skipped))
                continue
            symbols[i], symbols[j] = both, None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                c = score.get(new := both + symbols[j])
                if c is not None:
                    heapq.heappush(agenda, (c, i, new))
            k = before[i]
            if k >= 0:
                c = score.get(new := symbols[k] + both)
                if c is not None:
                    heapq.heappush(agenda, (c, k, new))
        return [s for s in symbols if s is not None], came, skipped

    def _ids(self, pieces: list[str]) -> bytes:
        ids = self.ids
        out: list[int] = []
        for p in pieces:
            i = ids.get(p)
            if i is None:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(i)
        return array("I", out).tobytes()

    def _merged(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, x: np.ndarray, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all words (their characters' pieces lie in chars), how many each has, and how many candidates came up.

        first: the number of each word's first skip; x: what its other skips are drawn from, unless it is to be the only one.
        """
        total, came = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        found, low = [], 0
        for width in self.WIDTHS:
            own = np.flatnonzero((length > low) & (length <= width))
            low = width
            for a in range(0, len(own), (1 << 16) // width):
                rows = own[a : a + (1 << 16) // width]
                out, alive, came[rows] = self._agendas(chars, start[rows], length[rows], first[rows], x[rows], width, once)
                total[rows] = alive.sum(axis=1)
                found.append((rows, out[alive]))
        offset = np.cumsum(total) - total
        flat = np.zeros(int(total.sum()), np.int32)
        for rows, out in found:
            flat[_spread(offset[rows], total[rows])] = out
        return flat, total, came

    def _agendas(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, x: np.ndarray, width: int, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of words of up to width characters; column `width` stands for no neighbour."""
        n, place = len(start), np.arange(width)
        alive = place < length[:, None]
        piece = np.full((n, width + 1), -1, np.int32)
        piece[:, :width][alive] = chars[_spread(start, length)]
        after = np.full((n, width + 1), width, np.int32)
        after[:, : width - 1] = place[1:]
        after[after >= length[:, None]] = width
        before = np.full((n, width + 1), width, np.int32)
        before[:, 1:width] = place[:-1]
        both = np.full((n, width + 1), -1, np.int32)
        both[:, : width - 1] = self.pairs(piece[:, : width - 1].ravel(), piece[:, 1:width].ravel()).reshape(n, width - 1)
        cost = self.cost_of[both]
        came, due, times = np.zeros(n, np.int64), first.copy(), np.zeros(n, np.uint64)
        # Flat from here on: row r's column i is at r * wide + i.
        wide = width + 1
        piece_, after_, before_, both_, cost_ = (v.reshape(-1) for v in (piece, after, before, both, cost))
        active = np.arange(n)
        while len(active):
            i = (cost if len(active) == n else cost[active]).argmin(axis=1)
            at = active * wide + i
            there = cost_[at] < np.inf
            if not there.all():
                active, i, at = active[there], i[there], at[there]
            skip = came[active] == due[active]
            came[active] += 1
            row = active
            if skip.any():
                row = active[skip]
                cost_[at[skip]] = np.inf
                times[row] += np.uint64(1)
                due[row] = _NEVER if once else came[row] + self._passing_of(x[row], times[row])
                row, i, at = active[~skip], i[~skip], at[~skip]
            base = row * wide
            new, j = both_[at], base + after_[at]
            piece_[at] = new
            piece_[j], cost_[j] = -1, np.inf
            k = after_[j]
            after_[at] = k
            k = base + k
            before_[k] = i
            h = base + before_[at]
            made = self.pairs(np.concatenate([new, piece_[h]]), np.concatenate([piece_[k], new]))
            at = np.concatenate([at, h])
            both_[at], cost_[at] = made, self.cost_of[made]
        piece = piece[:, :width]
        alive = piece >= 0
        return piece, alive, came

    def encode_many(self, texts: list[str], doc_ids: list[int | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words."""
        number: dict[str, int] = {}
        which: list[int] = []
        counts = []
        for text in texts:
            words = _WORD.findall(self.model.normalize(text)) if text else []
            counts.append(len(words))
            which += [number.setdefault(w, len(number)) for w in words]
        if not which:
            return [b""] * len(texts)
        forms, of, many = list(number), np.array(which, np.int64), np.array(counts, np.int64)
        length = np.fromiter(map(len, forms), np.int64, len(forms))
        chars = self.char[np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4")]
        start = np.cumsum(length) - length
        plain = length <= self.WIDTHS[-1]
        # All forms without dropout.
        never = np.full(len(forms), _NEVER, np.int64)
        whole, size, came = self._merged(chars, start, np.where(plain, length, 0), never, never.astype(np.uint64))
        offset = np.cumsum(size) - size
        # Draws of all occurrences; those with a skip.
        key = np.array([xxhash.xxh64_intdigest((-1 if d is None else d).to_bytes(8, "little", signed=True), self.seed) for d in doc_ids], np.uint64)
        x = np.repeat(key, many) + _spread(np.zeros(len(many), np.int64), many).astype(np.uint64) * np.uint64(_MIX)
        first = self._passing_of(x, np.zeros(1, np.uint64)) if self.dropout else np.full(len(of), _NEVER, np.int64)
        odd = np.flatnonzero(~plain[of])
        # Occurrences of a form that skip the same candidate first have the same agenda until the next skip, if there is one.
        skips = np.flatnonzero(plain[of] & (first < came[of]))
        code, kind = np.unique(of[skips] << 16 | first[skips], return_inverse=True)
        form, never = code >> 16, np.full(len(code), _NEVER, np.int64)
        once, once_size, once_came = self._merged(chars, start[form], length[form], code & 0xFFFF, never.astype(np.uint64), once=True)
        second = first[skips] + 1 + self._passing_of(x[skips], np.ones(1, np.uint64)) if len(skips) else skips
        again = second < once_came[kind]
        more, skips, kind = skips[again], skips[~again], kind[~again]
        own, own_size, _ = self._merged(chars, start[of[more]], length[of[more]], first[more], x[more])
        by_heap = [self._numbers(self.pieces(forms[of[i]], int(first[i]), int(x[i]))[0]) for i in odd.tolist()]
        total = size[of]
        total[skips], total[more] = once_size[kind], own_size
        total[odd] = [len(v) for v in by_heap]
        to = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), "<u4")
        same = plain[of]
        same[skips] = same[more] = False
        same = np.flatnonzero(same)
        out[_spread(to[same], total[same])] = whole[_spread(offset[of[same]], total[same])]
        once_at = np.cumsum(once_size) - once_size
        out[_spread(to[skips], once_size[kind])] = once[_spread(once_at[kind], once_size[kind])]
        out[_spread(to[more], own_size)] = own
        for i, v in zip(odd.tolist(), by_heap, strict=True):
            out[to[i] : to[i] + len(v)] = v
        edges = np.concatenate([[0], np.cumsum(total)])[np.concatenate([[0], np.cumsum(many)])]
        out, edges = self._with_bytes(out, edges)
        return [out[a:b].tobytes() for a, b in pairwise(edges.tolist())]

    def _with_bytes(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the bytes' pieces of characters that have none of their own, and where edges are then."""
        unknown = np.flatnonzero(ids >= self.first_unknown)
        if not len(unknown):
            return ids, edges
        chars, which = np.unique(ids[unknown] - self.first_unknown, return_inverse=True)
        parts = [np.array([self.byte[b] for b in chr(c).encode("utf-8", "replace")], "<u4") for c in chars.tolist()]
        size = np.array([len(p) for p in parts])
        count = np.ones(len(ids), np.int64)
        count[unknown] = size[which]
        to = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(to[-1]), "<u4")
        out[to[:-1]] = ids
        out[_spread(to[unknown], count[unknown])] = np.concatenate(parts)[_spread((np.cumsum(size) - size)[which], count[unknown])]
        return out, to[edges]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        return np.array([self.ids[p] if p in self.ids else self.first_unknown + ord(p) for p in pieces], "<u4")

    def encode(self, text: str, doc_id: int | None = None) -> bytes:
        return self.encode_many([text], [doc_id])[0]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        text = b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        plain = self.model.normalize(text).replace(SPACE, " ")
        return plain[1:] if self.prefix and plain.startswith(" ") else plain


_encoders: dict[tuple, DropoutEncoder] = {}


def _encoder(*key) -> DropoutEncoder:
    if key not in _encoders:
        _encoders[key] = DropoutEncoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id and ids of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_path, dropout, seed)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in batches_of([len(t) for t in texts], 1 << 21):
                yield out_batch(schema, [doc_ids[a:b], enc.encode_many(texts[a:b], doc_ids[a:b])])

    return text_only(docs).mapInArrow(tidied(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_path, 0.0, 0)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield out_batch(schema, [part.column("doc_id"), [enc.decode(x) for (x,) in rows(part, "ids")]])

    return encoded.mapInArrow(tidied(run), "doc_id long, text string")


def digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, and of the decoded text n_bytes and text_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_path, 0.0, 0)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, ids in rows(batch, "doc_id", "ids"):
                text = enc.decode(ids).encode("utf-8", "replace")
                for c, v in zip(out, (doc_id, len(ids) // 4, zlib.crc32(ids), len(text), hashlib.sha256(text).hexdigest()), strict=True):
                    c.append(v)
            yield out_batch(schema, out)

    return encoded.mapInArrow(tidied(run), "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, text_sha256 string")


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
