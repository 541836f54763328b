"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once a worker.

A space between two characters that aren't white space always starts a new piece in byte-level BPE:
every pattern of its pre-tokenizer takes a space only as its first character. So a text splits there,
each chunk is encoded alone, and the ids of the chunks follow one another as those of the text.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import regex

CACHE_ENTRIES = 400_000  # words in a generation of a worker's cache; the current and the last one are kept
SLICE_CHARS = 1 << 20  # longer texts are split slice by slice

#: Only words of these characters are split further by the pattern; their classes are the same in every engine.
PLAIN = regex.compile(r"[ -~\nÀ-ÖØ-öø-ſ]*")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the
    others follow from code point 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """Ids of a blank and a word; a word that is asked for the first time is encoded."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encoder._learn(word)
        return ids


class Encoder:
    """``batch(texts)``: ids as little-endian unsigned 32-bit bytes, equal to encoding each whole text.

    ``special_as_text``: strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = byte_letters()
        self.tokenize, self.blank = self.model.tokenize, self.letters[32]
        self.words = Words(self)
        self.old: dict[str, bytes] = {}  # the generation before
        self.chunks: dict[str, bytes] = {}  # ids of any other chunk

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of any chunk."""
        known = self.words.get(chunk[1:]) if chunk[0] == " " else self.chunks.get(chunk)
        if known is not None:
            return known
        if PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.specials):
            out = []
            for piece in self.pattern.findall(chunk):
                word = piece[1:]
                if piece[0] == " " and word.isalpha():
                    out.append(self.words[word])
                else:
                    if piece not in self.chunks:
                        self.chunks[piece] = self._piece(piece)
                    out.append(self.chunks[piece])
            return b"".join(out)
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and letters, one piece."""
        if not word.isascii():
            return self._piece(" " + word)
        return array("I", [t.id for t in self.tokenize(self.blank + word)]).tobytes()  # ASCII letters stand for themselves

    def _learn(self, word: str) -> bytes:
        """Ids of a blank and a word that isn't in this generation of the cache.

        An empty word, or one with white space at an end, is no chunk of its own: KeyError."""
        known = self.old.get(word)
        if known is not None:
            return known
        if word.isalpha():
            return self._word(word) if word.isascii() or PLAIN.fullmatch(word) else self._chunk(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        letters = word[:-1]
        if word[-1] in ",.;:!?" and letters.isalpha() and (word.isascii() or PLAIN.fullmatch(word)):
            return self.words[letters] + self._chunk(word[-1])  # letters and one sign are two pieces
        return self._chunk(" " + word)

    def _by_chunk(self, text: str) -> bytes:
        """A text in which a space stands beside other white space or at an end."""
        out: list[str] = []
        for i, part in enumerate(text.split(" ")):
            if i and part and out[-1] and not part[0].isspace() and not out[-1][-1].isspace():
                out.append(" " + part)
            elif i:
                out[-1] += " " + part
            else:
                out.append(part)
        return b"".join([self._chunk(c) for c in out if c])

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE_CHARS:
            cut = text.find(" ", start + SLICE_CHARS)
            while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= len(text) - 1:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        if len(self.words) > CACHE_ENTRIES:
            self.old, self.words = dict(self.words), Words(self)
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks = {}
        get, out = self.words.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif len(text) > SLICE_CHARS:
                out.append(b"".join([self._by_chunk(s) for s in self._slices(text)]))
            else:
                parts = text.split(" ")
                first = parts.pop(0)
                if not first or first[-1].isspace():
                    out.append(self._by_chunk(text))
                    continue
                try:
                    out.append(self._chunk(first) + b"".join(map(get, parts)))
                except KeyError:  # a space beside other white space
                    out.append(self._by_chunk(text))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file; its cache outlives a task."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]
