"""Token ids of whole texts, put together from pieces cut where no token can cross.

Both vocabularies split a text before they merge. For the one that drops white space any
space is such a place. For the byte-level one it is a space that follows a character other
than white space: a token may begin with white space but never holds any after something
else. Marks after a word and single line ends inside a piece are split off too, so that what is
left is mostly words. Pieces repeat, so a worker keeps what the tokenizer gave for them in a
store of two generations, each bounded in bytes: what is asked for again moves from the old one
to the young one, the rest goes when the young one is full. Long pieces are not kept. The store
changes time only. Texts of a tokenizer of another build are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

from .shared import per_worker

_AFTER_WORD = re.compile(r"(?<=\S)(?= )")
_LATIN_END = "ɐ"
ASCII_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CHUNK = 1 << 20
STORE_BYTES = 64 << 20
#: What an entry takes beside the letters of its piece and its ids.
ENTRY_BYTES = 200
KEPT_PIECE = 256


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they
    are, the others counted up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Store(dict):
    """Values by piece, worked out by ``make`` where missing, in two generations."""

    def __init__(self, make: Callable, sized: int):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0
        self.entry = ENTRY_BYTES + KEPT_PIECE // 16 * sized

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        # White space at the end of a piece has to be noticed each time it comes.
        if len(piece) <= KEPT_PIECE and not piece[-1:].isspace():
            self[piece] = value
            self.held += self.entry + len(piece)
            if self.held > STORE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
        return value

    def kept(self, piece: str, make: Callable):
        if piece not in self:
            self[piece] = make()
        return self[piece]


class Pieces:
    """Ids (packed little-endian unsigned, 16-bit if ``narrow``, else 32-bit) or counts of ids
    of texts.

    ``direct`` hands pieces of plain Latin letters straight to the tokenizer's own merge
    model, for which normalising and splitting change nothing; all other pieces, and all
    pieces without ``direct``, go through batch encoding.
    """

    def __init__(self, path: str, counts: bool, direct: bool, narrow: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        self._counts, self._direct, self._unit = counts, direct, "H" if narrow else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        parts = split.get("pretokenizers") or [{}]
        spaced = any(re.search(r"\s", a["content"]) or a.get("lstrip") or a.get("rstrip")
                     for a in spec["added_tokens"])
        if spaced or spec["model"]["type"] != "BPE" or spec["post_processor"]:
            self._kind = "whole"
        elif split.get("type") == "ByteLevel" and split["use_regex"] and not (
                split["add_prefix_space"] or spec["normalizer"]):
            self._kind = "spaces kept"
        elif parts[0].get("type") == "Split" and parts[0]["invert"] and (
                parts[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in
                parts[0]["pattern"].get("Regex", "")):
            self._kind = "spaces dropped"
        else:
            self._kind = "whole"
        keeps = self._kind == "spaces kept"
        self._marks = "".join(c for c in ASCII_MARKS if not any(
            c in a["content"] for a in spec["added_tokens"]))
        self._after = self._store(" " if keeps else "")
        self._begin = self._store("") if keeps else self._after
        self._open: set = {""}   # pieces of a slice after which a space is no safe place
        self.nothing = 0 if counts else b""

    def _store(self, lead: str) -> "Store":
        """A store of pieces that come after ``lead``."""
        lower, direct, counts = self._kind == "spaces dropped", self._direct, self._counts
        marks, unit = self._marks, self._unit
        tokenize, mark = self._model.tokenize, lead and _LETTERS[ord(lead)]

        def make(piece: str):
            # What is new is mostly words, or words with marks after them: few calls on their way.
            if piece.isalpha():
                if direct and piece.isascii():
                    tokens = tokenize(piece.lower() if lower else mark + piece)
                    return len(tokens) if counts else array(unit, [t.id for t in tokens]).tobytes()
                return self._word(piece, lead)
            word = piece.rstrip(marks)
            # A mark after a Latin letter is always split off, so the two add up.
            if word != piece and word.isalpha() and word[-1] < _LATIN_END:
                return store[word] + self._begin[piece[len(word):]]
            return self._piece(piece, lead, store)

        store = Store(make, 0 if counts else 1)
        return store

    def _value(self, ids):
        return len(ids) if self._counts else array(self._unit, ids).tobytes()

    def _encode(self, texts: list[str]):
        for i in range(0, len(texts), 2000):
            for e in self._tok.encode_batch_fast(texts[i:i + 2000], add_special_tokens=False):
                yield self._value(e.ids)

    def _piece(self, piece: str, lead: str, store: Store):
        """The value of a piece that is no word; ``lead`` is the space before it."""
        if self._kind == "spaces kept":
            lines = piece.split("\n")
            # A line end between other characters is a token of its own.
            if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace()
                                      for x in lines):
                end = self._begin.kept("\n", lambda: next(self._encode(["\n"])))
                parts = [store[lines[0]]]
                for line in lines[1:]:
                    parts += end, self._begin[line]
                return self._joined(parts)
            if piece[-1:].isspace():
                self._open.add(piece)
        return next(self._encode([lead + piece]))

    def _joined(self, values: list):
        return sum(values) if self._counts else b"".join(values)

    def _word(self, word: str, lead: str):
        plain = self._direct and max(word) < _LATIN_END
        if plain and not lead and self._kind == "spaces dropped":
            low = word.lower()
            plain = word.isascii() or (word == low and unicodedata.is_normalized("NFC", word))
            word = low if plain else word
        if not plain:
            return next(self._encode([lead + word]))
        word = lead + word
        if lead or not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return self._value([t.id for t in self._model.tokenize(word)])

    def _chunks(self, text: str):
        """(at the start, chunk); later chunks come without the space they begin with."""
        at = 0
        while len(text) - at > CHUNK:
            k = text.find(" ", at + CHUNK)
            while k > 0 and text[k - 1].isspace():
                k = text.find(" ", k + 1)
            if k < 0:
                break
            yield at == 0, text[at:k]
            at = k + 1
        yield at == 0, text[at:]

    def encode(self, texts: list[str]) -> list:
        """One value for each text."""
        if self._kind == "whole":
            return list(self._encode(texts))
        keeps = self._kind == "spaces kept"
        self._open = {""}
        after, begin = self._after.__getitem__, self._begin.__getitem__
        got = [[] for _ in texts]
        for i, text in enumerate(texts):
            for start, chunk in self._chunks(text):
                if not keeps:
                    # White space of any kind is dropped; line ends are the common other kind.
                    got[i] += map(after, chunk.replace("\n", " ").split(" "))
                    continue
                pieces = chunk.split(" ")
                head = pieces.pop(0) if start else None
                values = [begin(head)] if start else []
                values += map(after, pieces)
                if (start and pieces and (not head or head[-1].isspace())
                        or not self._open.isdisjoint(pieces[:-1])):
                    values = map(begin, _AFTER_WORD.split(chunk if start else " " + chunk))
                got[i] += values
        return list(map(self._joined, got))


def pieces(path: str, counts: bool = False, direct: bool = True, narrow: bool = False) -> Pieces:
    """The worker's encoder for a vocabulary file."""
    return per_worker(("pieces", path, counts, direct, narrow),
                      lambda: Pieces(path, counts, direct, narrow))
