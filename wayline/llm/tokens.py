"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words already encoded.

Both tokenizer files cut a text before every space that stands between two non-space characters, so the ids of a text are
the ids of its space-separated words in a row. A text in which a space touches other white space goes through the library
with only its safe cuts. A word is encoded by the library once per worker and then looked up. Words that are one run of Latin
letters, with at most one full stop or comma, go straight to the library's model, since nothing is left to normalise or to cut.
"""

from __future__ import annotations

import os
import re
from array import array

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
WORDS_KEPT = 800_000  # words remembered per Python worker
LONGEST_KEPT = 64
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-^{-~]*)")  # letters, then punctuation but for apostrophes, _ and `
_LINES = re.compile(f"({_PLAIN.pattern})\n({_PLAIN.pattern})")
_encoders: dict[tuple[str, int | None], WordEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models write for each byte: printable Latin-1 bytes stay, the others follow from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, filled on demand.

    ``spaced``: the space before a word belongs to the word's first id; otherwise white space yields no id.
    """

    def __init__(self, path: str, end_id: int | None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = bool(self.library.encode(" ", add_special_tokens=False).ids)
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")
        self.letters = byte_letters()
        self.stops, self.begins, self.line_end = {"": b""}, {}, self.whole("\n") if self.spaced else b""

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, letters: str, space: str) -> bytes:
        written = (space + (letters if self.spaced else letters.lower())).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _stop(self, stop: str) -> bytes:
        if stop not in self.stops:
            self.stops[stop] = self.whole(stop)
        return self.stops[stop]

    def _begin(self, letters: str) -> bytes:
        """A word at the beginning of a line."""
        if letters not in self.begins:
            self.begins[letters] = self._letters(letters, "")
        return self.begins[letters]

    def __missing__(self, word: str) -> bytes | None:
        plain = _PLAIN.fullmatch(word)
        lines = None if plain else _LINES.fullmatch(word)
        if plain:
            letters, stop = plain.groups()
            ids = self[letters] + self._stop(stop) if stop else self._letters(letters, " " if self.spaced else "")
        elif lines:
            first, _, _, second, letters, stop = lines.groups()
            ids = self[first] + (self.line_end + self._begin(letters) + self._stop(stop) if self.spaced else self[second])
        elif self.spaced and (not word or word[0].isspace() or word[-1].isspace()):
            ids = None  # no place to cut
        else:
            ids = self.whole(" " + word if self.spaced else word)
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of one whole text with the end id; a null text counts as empty."""
        words = (text or "").split(" ")
        look = self.__getitem__
        if not self.spaced:
            return b"".join(map(look, words)) + self.end
        if len(words) == 1:
            return self.whole(words[0]) + self.end
        try:
            if words[0][-1:].isspace():
                raise TypeError
            return self.whole(words[0]) + b"".join(map(look, words[1:])) + self.end
        except TypeError:
            first, *others = _CUT.split(text)
            return self.whole(first) + b"".join(self.whole(" " + w) for w in others) + self.end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [self.ids(t) for t in texts]
        if len(self) + len(self.begins) + len(self.stops) > WORDS_KEPT:
            self.clear()
            self.begins.clear()
            self.stops = {"": b""}
        return out


def encoder(path: str, end_id: int | None) -> WordEncoder:
    """One encoder per Python worker."""
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, end_id)
    return _encoders[key]
