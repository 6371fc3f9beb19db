"""Exact token ids by the tokenizers library, with a memo of blank-separated pieces.

In the tokenizer used here white space always ends a token (it is dropped, nothing composes across
it), so the ids of a text are those of its blank-separated pieces one after the other; a test
compares both. New words of letters are encoded many at a time, as one text, and cut apart where a token ends a
word. Pieces that hold an added token go to the tokenizer as they are. The memo has two generations: what was not
used since the last turn is forgotten."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

MEMO_PIECES = 300_000
WORDS_AT_ONCE = 2048
CUT_CHARS = 4_000_000
WORD_END = "</w>"
#: ASCII punctuation but the apostrophe, which may open a token with the letters behind it.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Above these characters, and at the dotted capital I, lower-casing may look around or marks may compose.
_ODD = re.compile("[^\x00-\u024f]|\u0130")


def _is_plain(piece: str) -> bool:
    return piece.isascii() or not _ODD.search(piece)


def _cuts(text: str) -> Iterator[str]:
    """The text in parts of about ``CUT_CHARS`` that begin at a blank or line end, where no token can span."""
    start = 0
    while len(text) - start > CUT_CHARS:
        places = [p for p in (text.find(" ", start + CUT_CHARS), text.find("\n", start + CUT_CHARS)) if p > 0]
        if not places:
            break
        yield text[start : min(places)]
        start = min(places)
    yield text[start:]


class Encoder:
    """Ids as packed little-endian unsigned integers of ``dtype`` (16 bits if the vocabulary fits).

    ``special``: special tokens written in a text get their own id, as the library does by default; otherwise they are
    split like other words."""

    def __init__(self, path: str, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self.memo[p] = np.array(e.ids, self.dtype).tobytes()

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters, each one token run that ends in a token with a word end."""
        width = self.dtype.itemsize
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i : i + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(cuts) != len(part):
                self._encode(part)
                continue
            packed, start = ids.tobytes(), 0
            for w, end in zip(part, cuts):
                self.memo[w] = packed[start:end]
                start = end

    def _learn(self, new: list[str]) -> None:
        """Fill the memo; a capital or closing punctuation costs no second encoding of the word."""
        memo, older = self.memo, self.older
        parts, words, rest = {}, set(), set()
        for p in new:
            if p in older:
                memo[p] = older[p]
                continue
            own = (p,)
            low = p.lower()
            if any(a in low for a in self.added):  # an added token stands for itself, as it is written
                rest.add(p)
                continue
            if len(p) < 200 and _is_plain(p):
                core = low.rstrip(PUNCTUATION)
                own = (core, low[len(core) :]) if len(core) < len(low) and core[-1:].isalnum() else (low,)
            parts[p] = own
            for q in own:
                if q not in memo:
                    if q in older:
                        memo[q] = older[q]
                    elif q.isalpha() and len(q) < 200 and _is_plain(q):
                        words.add(q)
                    else:
                        rest.add(q)
        self._encode_words(list(words))
        if rest:
            self._encode(list(rest))
        for p, own in parts.items():
            if len(own) > 1:
                memo[p] = memo[own[0]] + memo[own[1]]
            elif own[0] is not p:
                memo[p] = memo[own[0]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty. A very long text is encoded in cuts at its blanks."""
        if any(t and len(t) > CUT_CHARS for t in texts):
            return [b"".join(self._encode_lot([c])[0] for c in _cuts(t or "")) for t in texts]
        return self._encode_lot(texts)

    def _encode_lot(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {"": b""}, self.memo
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        new = [p for p in set(chain.from_iterable(split)) if p not in memo]
        if new:
            self._learn(new)
        get = memo.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(2)
def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder per worker process, file and way of special tokens."""
    return Encoder(path, special)


def in_lots(texts: list, chars: int = 2_000_000):
    """Slices of a batch of about ``chars`` characters, so that split pieces stay few."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
