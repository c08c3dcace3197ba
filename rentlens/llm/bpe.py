"""Byte-level BPE by prefix-sharing trie traversal, and decoding.

An encoding of a string is the encoding of a prefix plus one last token, so a
string's whole encoding follows from the last token of each of its prefixes.
The distinct words of a batch, sorted, are a trie in depth-first order: the
path's last-token states lie on a stack, and a word only computes the states
below the prefix that it shares with the word before it.  A prefix's last token
is the one token ``t`` at its end that is *stable* after the last token of what
remains: undoing the merges of the two along their border shows no merge across
it that byte-pair encoding would have made earlier.

``vocabulary`` is a file of the tokenizers library (byte-level BPE without
normalizer).  Results equal that library's ``encode(add_special_tokens=False)``
and ``decode(skip_special_tokens=False)``; strings of special tokens in a text
become those tokens, as there.

Null text is taken as empty; an empty text has no ids and decodes to an empty
text.  Texts are encoded whole, piece by piece, so a very long one needs no
more than its own ids.  Other columns pass through unchanged; ``ids`` and
``n_tokens`` (or ``decoded``) are added, replacing input columns of these names.
A worker's word cache is emptied at ``CACHE_WORDS`` words; this changes no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rentlens.llm.common import carried, mapped, sliced

CACHE_WORDS = 500_000
#: Bytes of text that are encoded together.
SLICE = 3 << 20
#: The white space of the pre-tokenizer's pattern (Unicode White_Space).
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Letters and numbers below U+0180.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_GAP = f"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The pre-tokenizer's words, for texts without an ``UNUSUAL`` character.
WORDS = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|{_GAP}")
UNUSUAL = re.compile("[^\x00-\u017f\u2000-\u2027\u202a-\u205e]")
#: For other texts: pieces between which the pre-tokenizer always cuts.
PIECES = re.compile(f" ?[^{SPACE}]+|{_GAP}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self._bytes_of = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {self._bytes_of(t): i for t, i in vocab.items()}
        self._state_of = {b"": 0}  # every beginning of a token is a state
        for token in self.ids:
            for i in range(1, len(token) + 1):
                self._state_of.setdefault(token[:i], len(self._state_of))
        self._states = list(self._state_of)
        self._ends: dict[int, list[tuple[int, int]]] = {}  # state -> tokens that end there, longest first
        self._moves: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self.merges: dict[tuple[int, int], int] = {}  # pair -> order of the merge
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> order, left, right
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merges[a, b] = order
            self.made.setdefault(c, (order, a, b))
        self._text = {i: t for t, i in self.ids.items()}
        self._stable: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pre = Tokenizer.from_file(path).pre_tokenizer
        self._known: dict[str, bytes] = {}
        self.table = [b""] * (max([*self._text, *self.special.values()]) + 1)
        for i, t in self._text.items():
            self.table[i] = t
        for t, i in self.special.items():
            self.table[i] = t.encode()

    def stable(self, a: int, b: int) -> bool:
        """Whether byte-pair encoding of ``a``'s and ``b``'s bytes together gives exactly [a, b]."""
        key = a << 20 | b
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 400_000:
                self._stable.clear()
            known = self._stable[key] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        # undo the merges that touch the border, latest first; ``before``: a merge across it of a lower order came first
        before = len(self.merges)
        while True:
            if self.merges.get((a, b), before) < before:
                return False
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                before, a = left[0], left[2]
            else:  # equal pairs merge from the left, so the border's came before this one
                before, b = right[0] + 1, right[1]

    def _step(self, state: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        """Next state, and the tokens that end there, longest first.

        A state is the longest end of the path that begins some token.
        """
        path = self._states[state] + bytes((byte,))
        while path not in self._state_of:
            path = path[1:]
        here = self._state_of[path]
        ends = self._ends.get(here)
        if ends is None:
            ends = self._ends[here] = [(self.ids[path[i:]], len(path) - i) for i in range(len(path)) if path[i:] in self.ids]
        if len(self._moves) > 250_000:
            self._moves.clear()
        self._moves[state << 8 | byte] = here, ends
        return here, ends

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Each distinct word's ids (little-endian 32-bit), by one depth-first pass over their trie."""
        out, moves, step, known, stable = {}, self._moves, self._step, self._stable, self.stable
        path = b""
        states, last, size = [0], [-1], [0]  # per depth of the path: state, last token and its length
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1:], last[shared + 1:], size[shared + 1:]
            state = states[shared]
            for end in range(shared + 1, len(word) + 1):
                move = moves.get(state << 8 | word[end - 1])
                state, ends = move if move is not None else step(state, word[end - 1])
                for token, n in ends:
                    if n == end:
                        break
                    before = last[end - n]
                    ok = known.get(before << 20 | token)
                    if ok or ok is None and stable(before, token):
                        break
                states.append(state)
                last.append(token)
                size.append(n)
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at -= size[at]
            tokens.reverse()
            out[word] = pack(f"<{len(tokens)}I", *tokens)
            path = word
        return out

    def _split(self, piece: str) -> list[bytes]:
        return [self._bytes_of(w) for w, _ in self._pre.pre_tokenize_str(piece)]

    def _learned(self, words: set[str], pieces: set[str]) -> dict[str, bytes]:
        """Ids of words and pieces that are not in the cache, which takes them up."""
        split = {w: [w.encode()] for w in words} | {p: self._split(p) for p in pieces}
        done = self.encode_words(list({w for ws in split.values() for w in ws}))
        fresh = {p: done[ws[0]] if len(ws) == 1 else b"".join([done[w] for w in ws]) for p, ws in split.items()}
        if len(self._known) + len(fresh) > CACHE_WORDS:
            self._known = {}
        self._known.update(fresh)
        return fresh

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit values."""
        found: list[list] = []
        words: set[str] = set()
        pieces: set[str] = set()
        for t in texts:
            parts = []
            for i, part in enumerate([] if not t else [t] if self._cut is None else self._cut.split(t)):
                if i % 2:
                    parts.append(self.special[part])
                elif UNUSUAL.search(part):
                    parts.append(PIECES.findall(part))
                    pieces.update(parts[-1])
                else:
                    parts.append(WORDS.findall(part))
                    words.update(parts[-1])
            found.append(parts)
        cache = self._known
        pieces -= cache.keys()
        words -= cache.keys()
        words -= pieces
        fresh = self._learned(words, pieces)
        cache = self._known if self._known is cache else {**cache, **fresh}
        for parts in found:
            yield b"".join([pack("<I", p) if isinstance(p, int) else b"".join(map(cache.__getitem__, p)) for p in parts])

    def decode(self, ids: bytes | None) -> str:
        at = self.table.__getitem__
        return b"".join(map(at, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _with(df: DataFrame, source: str, added: list[tuple[str, str]], fn) -> DataFrame:
    names = carried(df, [a for a, _ in added])
    types = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, rows=1000, chars=SLICE, text=source):
            yield {**{c: part.column(c) for c in names}, **fn(part.column(source).to_pylist())}

    return mapped(df, run, ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{c} {t}" for c, t in added]))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``."""

    def fn(texts: list[str | None]) -> dict:
        ids = list(encoder(vocabulary).encode(texts))
        return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    return _with(docs, text, [("ids", "binary"), ("n_tokens", "long")], fn)


def bpe_decode(coded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``coded`` with the text of its ids as ``decoded`` (bytes that are no UTF-8 become U+FFFD)."""
    return _with(coded, ids, [("decoded", "string")],
                 lambda rows: {"decoded": [encoder(vocabulary).decode(x) for x in rows]})
