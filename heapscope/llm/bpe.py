"""Byte-level BPE of whole texts with the tokenizers library, one call for each new word form."""

from __future__ import annotations

import os
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex

from heapscope.llm.common import STORES

#: The word pattern of byte-level BPE tokenizers (a fixed value): merges never cross its matches.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters are cut alike by the regex library and by tokenizers, whatever their Unicode versions.
PLAIN = regex.compile(r"[\x01-\x7e\xa0-˿Α-ΡΣ-ώА-я‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*").fullmatch
#: Of these, texts whose only signs and white space are those of ASCII.
LETTERS = regex.compile(r"[\x01-\x7eÀ-ÖØ-öø-ɏΑ-ΡΣ-ώА-яぁ-ゖァ-ヺ一-龥가-힣]*").fullmatch
#: Bytes as kinds: letters and digits, white space, signs.
_KINDS = bytes(32 if chr(b).isspace() and b < 128 else 97 if b >= 128 or chr(b).isalnum() else 46 for b in range(256))
#: Bytes that begin a form where there are no runs.
_BEGINS = np.isin(np.arange(256), list(b" \n.,"))


#: Byte-level BPE writes a byte as the character of its number if that is a sign to be seen, else as the next one from 256 on.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SIGNS = dict(zip(_SEEN, _SEEN, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class Encoder:
    """Ids of texts as little-endian words of 32 bits, or of 16.

    A text is cut where WORDS would cut it: if it has no run of white space or signs and no space before a sign,
    that is before each space, line end, full stop and comma; else by WORDS itself. The forms of many texts are numbered at once
    and looked up once each. Their ids are kept and used again; the store is emptied when it holds over max_forms. Texts with characters outside PLAIN, or with an added
    token, which is one id, go to the library whole; forms of letters go to its model, as they are one word; forms of over max_form characters aren't kept.
    """

    def __init__(self, path: str, max_forms: int = 1_200_000, max_form: int = 64, short: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = regex.compile("|".join(map(regex.escape, added))).search if added else lambda _: None
        self.model = self.tokenizer.model
        #: Whether a form of letters is one word to the tokenizer, so that its model can be asked at once.
        self.at_once = all(self._word(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in (" the", "The", " größer", "naïve", " 漢字", " Информация"))
        self.forms: dict[str, bytes] = {}
        self.max_forms, self.max_form = max_forms, max_form
        self.code = "H" if short else "I"

    def _without_runs(self, text: str) -> bytes | None:
        """The text's bytes if it is to be cut before each of _BEGINS."""
        if not self.has_added(text) and ((text.isascii() and "\0" not in text and "\x7f" not in text) or LETTERS(text)):
            kinds = (raw := text.encode()).translate(_KINDS)
            if b"  " not in kinds and b".." not in kinds and b" ." not in kinds:
                return raw
        return None

    def _cut(self, text: str) -> list[str]:
        return WORDS.findall(text) if PLAIN(text) and not self.has_added(text) else [text]

    def _word(self, form: str) -> list[int]:
        """Ids of a form of letters, maybe after a space."""
        return [t.id for t in self.model.tokenize(form.encode().decode("latin-1").translate(_SIGNS))]

    def many(self, texts: list[str]) -> list[bytes]:
        forms = self.forms
        if len(forms) > self.max_forms:
            forms.clear()
        # Texts without runs first, as one string with the places of its forms; then the others' forms.
        raws = [self._without_runs(t) for t in texts]
        data = b"".join(r for r in raws if r is not None)
        edges = np.concatenate([[0], np.cumsum([len(r) for r in raws if r is not None], dtype=np.int64)])
        begins = _BEGINS[np.frombuffer(data, np.uint8)]
        begins[edges[edges < len(data)]] = True
        at = np.flatnonzero(begins)
        cut = [self._cut(t) for t, r in zip(texts, raws, strict=True) if r is None]
        bounds = np.concatenate([np.searchsorted(at, edges), len(at) + np.cumsum([len(x) for x in cut], dtype=np.int64)])
        found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        if cut:
            found = pa.concat_arrays([found, pa.array([w for x in cut for w in x], pa.large_string())])
        numbered = found.dictionary_encode()
        own = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded, code = list(map(forms.get, own)), self.code
        new = [i for i, x in enumerate(coded) if x is None]
        fresh = [own[i] for i in new]
        others = fresh
        if self.at_once:
            others = []
            for w in fresh:
                if w.removeprefix(" ").isalpha() and len(w) <= self.max_form:
                    forms[w] = array(code, self._word(w)).tobytes()
                else:
                    others.append(w)
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            forms[w] = array(code, e.ids).tobytes()
        for i in new:
            coded[i] = forms[own[i]]
        ids = pa.array(coded, pa.large_binary()).take(numbered.indices)
        for w in fresh:
            if len(w) > self.max_form:
                del forms[w]
        _, ends, joined = ids.buffers()
        ends, joined = np.frombuffer(ends, np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds), memoryview(joined or b"")
        parts = [bytes(joined[a:b]) for a, b in pairwise(ends)]
        first, second = iter(parts[: len(edges) - 1]), iter(parts[len(edges) - 1 :])
        return [next(second if r is None else first) for r in raws]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, short: bool = False) -> Encoder:
    """One encoder for each Python worker, file and width; workers serve many tasks."""
    if (path, short) not in _encoders:
        _encoders[path, short] = Encoder(path, short=short)
    STORES["bpe"] = _clear
    return _encoders[path, short]


def _clear() -> None:
    for e in _encoders.values():
        e.forms.clear()
