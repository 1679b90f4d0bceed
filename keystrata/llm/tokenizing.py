"""Encoding by the pieces of a text, each distinct piece encoded once by the library.

Byte-pair encoding works on pre-tokens, so a text cut where the pre-tokenizer
always cuts has the ids of its pieces one after another.  Natural text repeats
its words, so a task keeps the ids of the pieces it has met.  The memory is
bounded by bytes and changes no result.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from .shared import kept_for_an_operator

#: Bytes of a generation of a task's memory, unless given; there are two generations of pieces and two of symbols and lower-case words.
CACHE_BYTES = 48 << 20
#: Bytes that a dict entry, a short str and a bytes object take besides their contents.
ENTRY_BYTES = 190
#: Text whose spaces are only these four is cut at them; any other is encoded whole.
_OTHER_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")
_RUNS = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Letters below this are letters in every Unicode version, and one letter in lower case.
LATIN_END = "\u0100"
#: ASCII symbols but the apostrophe, which begins contractions.
SYMBOLS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Longer runs are not kept.
MAX_PIECE = 64
#: Ids that are turned into bytes at once.
RUN = 1 << 16

_loaded: dict = {}
kept_for_an_operator(_loaded.clear)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker; truncation and padding off."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _loaded[path] = own
    return _loaded[path]


def _byte_alphabet() -> dict[int, str]:
    """The character of each byte in the byte-level alphabet.

    It gives each printable Latin-1 byte its own character and counts the others up from U+0100 in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def _byte_letters() -> dict[int, str]:
    """Letters below LATIN_END as the byte-level alphabet writes their UTF-8 bytes."""
    shown = _byte_alphabet()
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(ord(LATIN_END)) if chr(c).isalpha()}


class Memory:
    """A dict of two generations: entries met again move from the older to the younger, and the older is dropped when the younger is full."""

    def __init__(self, limit: int):
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(key) > MAX_PIECE:
            return
        self.held += len(key) + len(value) + ENTRY_BYTES
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = value


class Pieces:
    """Ids of texts by cached pieces.

    ``spaces`` says whether white space counts (byte-level vocabularies: a piece
    is the white space before a word and the word) or is dropped by the
    tokenizer, which also lower-cases (a piece is a word).  Ids are little-endian
    32-bit numbers.

    A piece of Latin-1 letters followed by ASCII symbols other than the apostrophe is two
    pre-tokens.  Letters alone (with one space before them, the same) go straight to
    the library's merge step; all else takes the library's whole way.
    """

    def __init__(self, path: str, spaces: bool, limit: int = CACHE_BYTES):
        self.own, self.spaces = tokenizer(path), spaces
        self.model, self.letters = self.own.model, _byte_letters()
        self.pieces, self.parts = Memory(limit), Memory(limit)

    def _known(self, piece: str) -> bytes:
        return self.pieces.young.get(piece) or self._learn(piece)

    def _word(self, word: str) -> bytes:
        """The value of Latin-1 letters, for ``spaces`` perhaps after a space."""
        shown = word.replace(" ", "\u0120")
        return id_bytes([t.id for t in self.model.tokenize(shown if word.isascii() else shown.translate(self.letters))])

    def _lower(self, word: str) -> bytes:
        """The value of a lower-case word, which several pieces share."""
        value = self.parts.get(word)
        if value is None:
            value = self._word(word)
            self.parts.put(word, value)
        return value

    def _whole(self, text: str) -> bytes:
        return id_bytes(self.own.encode(text, add_special_tokens=False).ids)

    def _symbols(self, tail: str) -> bytes:
        value = self.parts.get(tail)
        if value is None:
            value = self._whole(tail)
            self.parts.put(tail, value)
        return value

    def _learn(self, piece: str) -> bytes:
        """The value of a piece not in the young generation."""
        value = self.pieces.old.get(piece)
        if value is None:
            head = piece.rstrip(SYMBOLS)
            first = head[:1] if self.spaces and head[:1] in (" ", "\n") else ""
            word = head[1:] if first else head
            if word.isalpha() and (word.isascii() or max(word) < LATIN_END):
                if not self.spaces:
                    value = self._lower(word.lower())
                    if len(head) < len(piece):
                        value += self._symbols(piece[len(head) :])
                elif len(head) < len(piece):
                    value = self._known(head) + self._symbols(piece[len(head) :])
                elif first == "\n":
                    value = self._symbols("\n") + self._known(word)
                else:
                    value = self._word(head)
            else:
                value = self._whole(piece)
        self.pieces.put(piece, value)
        return value

    def values(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its pieces in order."""
        out = []
        for text in texts:
            if _OTHER_SPACE.search(text):
                out.append([self._whole(text)])
                continue
            runs = _RUNS.findall(text) if self.spaces else text.split()
            found = list(map(self.pieces.young.get, runs))
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self.pieces.young.get(runs[at]) or self._learn(runs[at])
            out.append(found)
        return out


class Bytes:
    """The bytes and the decimal form of each token of a byte-level vocabulary, by id."""

    def __init__(self, path: str):
        plain = {c: b for b, c in _byte_alphabet().items()}
        own = tokenizer(path)
        shown = [own.id_to_token(i) for i in range(own.get_vocab_size(with_added_tokens=True))]
        # a special token is written as it is
        self.of = [bytes(map(plain.__getitem__, s)) if s is not None and all(c in plain for c in s) else (s or "").encode() for s in shown]
        self.sizes = np.fromiter(map(len, self.of), np.int64, len(self.of))
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.of), np.uint8)
        # padded by numpy with zero bytes to one size
        self.names = np.array([b"%d," % i for i in range(len(self.of))])

    def _raw(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] + sizes - np.cumsum(sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes()

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self._raw, _runs(ids))).decode("utf-8", "replace")

    def decimal(self, ids) -> bytes:
        """The decimal ids joined by commas."""
        return b"".join(self.names[x].tobytes().translate(None, b"\0") for x in _runs(ids))[:-1]


def byte_tokens(path: str) -> Bytes:
    """The ``Bytes`` of a file, made once in a worker."""
    if (path, Bytes) not in _loaded:
        _loaded[path, Bytes] = Bytes(path)
    return _loaded[path, Bytes]


def _runs(ids) -> list[np.ndarray]:
    """Ids in runs of ``RUN``, so that arrays by the byte stay small."""
    ids = np.asarray(ids, np.int64)
    return [ids[at : at + RUN] for at in range(0, len(ids), RUN)]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers.tobytes()
