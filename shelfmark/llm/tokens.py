"""Token ids of texts with the public word BPE, read from a file whose path is a parameter.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a
row. A worker keeps the ids of words it has met; only new ones go through the model.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from shelfmark.llm.texts import kept

# Fixed: how the vocabulary's tokenizer cuts a normalized word into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Scripts whose letters and cases every Unicode version agrees on; other words take the library's whole path.
SETTLED = regex.compile(
    r"[\x21-\x7E\xA1-\u02AF\u0370-\u052F\u1E00-\u1EFF\u2010-\u2027\u2030-\u203A\u3041-\u30FE\u4E00-\u9FFF\uAC00-\uD7A3]*"
)
MOST_KEPT = 300_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + hidden.index(b)) for b in range(256)}


class PieceIds(dict):
    """The ids of each piece met, as 32-bit numbers in a row."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        # Printing ASCII stands for itself.
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = array("I", [token.id for token in self.tokenize(spelled)]).tobytes()
        return ids


class WordIds(dict):
    """Number of each word met; the 32-bit numbers ``starts[n]`` to ``starts[n + 1]`` of ``flat`` are the ids of word ``n``."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.starts = bytearray(), array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        # A word of ASCII letters is one piece. A word whose ids cannot be found is not kept.
        ids = self.pieces[word.lower().decode()] if word.isalpha() else self._ids(word.decode())
        number = self[word] = len(self)
        self.flat += ids
        self.starts.append(len(self.flat) // 4)
        return number

    def _ids(self, word: str) -> bytes:
        if "<|" in word or not SETTLED.fullmatch(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        # The library lower-cases letter by letter, hence without a final form of sigma.
        small = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        # Letters alone are one piece.
        return self.pieces[small] if small.isalpha() else b"".join(map(self.pieces.__getitem__, PIECES.findall(small)))

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """The ids of each text, closed by ``end``. Words, and pieces, are kept from call to call up to a bound."""
        if len(self) > MOST_KEPT:
            self.forget()
        if len(self.pieces) > MOST_KEPT:
            self.pieces.clear()
        numbered = []
        for text in texts:
            words = text.split()
            numbered.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        starts, flat = np.array(self.starts, np.int64), np.frombuffer(bytes(self.flat), np.uint32)
        result = []
        for numbers in numbered:
            first, sizes = starts[numbers], starts[numbers + 1] - starts[numbers]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(numbers) else 0
            ids = np.empty(total + 1, np.uint32)
            ids[:-1] = flat[np.repeat(first - ends + sizes, sizes) + np.arange(total)]
            ids[-1] = end
            result.append(ids)
        return result


def word_ids(path: str) -> WordIds:
    """The worker's ``WordIds`` of a file: the tasks that a worker runs share the words it has met, until it lets go of them."""
    return kept(f"word_ids {path}", lambda: WordIds(path))
