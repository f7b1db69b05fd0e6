"""Word splitting, term normalization and markup escaping as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks of the source language's regular expressions, the
# zero-width space that delimits pre-segmented text, and the punctuation
# classes that never take part in matching.
BLANKS = r"\s\x0B\p{Z}\x{FEFF}"
ZERO_WIDTH_SPACE = "​"
DROPPED_PUNCTUATION = r"\p{Pd}\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}"
# Connector characters that are always kept in a term.
KEPT_CHARACTERS = ["_", "‿", "⁀", "⁔", "︳", "︴", "﹍", "﹎", "﹏", "＿"]

# Stands in for a dropped character where positions must be kept: no text holds this code point,
# which is set aside for such use.
STAND_IN = "\ufdd0"

# A character that keeps a word from vanishing in normalization. Kept characters are solid, too,
# as long as they are no dropped punctuation, which holds for the ones above.
# Letters and digits of ASCII, like all of it that is printed below, are named first: they are found without asking for classes.
SOLID = f"[a-zA-Z0-9[^{BLANKS}{ZERO_WIDTH_SPACE}{DROPPED_PUNCTUATION}\\p{{M}}]]"

# BLANKS for Python; a line end of one character may follow the last blanks, as in the source's expressions.
_BLANK_CLASS = "[" + "".join(c for c in map(chr, range(0x10000)) if c in "\t\n\x0b\f\r\ufeff" or unicodedata.category(c)[0] == "Z") + "]"
_BLANK, _BLANK_RUN = re.compile(_BLANK_CLASS), re.compile(_BLANK_CLASS + "{2,}")
_OUTER_BLANKS = re.compile(f"^{_BLANK_CLASS}+|{_BLANK_CLASS}+(?=\x85?\\Z)")

# A text of characters on whose cases, classes and blanks all Unicode versions agree, each lower-cased by itself. Matched
# from its beginning in one run: searching for a character outside of the class takes forty times as long.
SETTLED = (
    r"\A[\x20-\x7E\x09-\x0D\xA1-\u012F\u0131-\u02AF\u0370-\u03A2\u03A4-\u052F\u1E00-\u1EFF\u2010-\u2027\u2030-\u203A\u3001-\u3029\u3041-\u30FE\u4E00-\u9FFF\uAC00-\uD7A3]*+\z"
)
_DROPPED_CLASSES = {"Pd", "Pe", "Pf", "Pi", "Po", "Ps"}

_HANGUL_BASE, _VOWELS, _TAILS = 0xAC00, 21, 28


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every letter whose decomposition minus marks is one other character, beside that character."""
    accented, plain = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char)[0] in "CM":
            continue
        rest = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c)[0] != "M")
        if len(rest) == 1 and rest != char:
            accented.append(char)
            plain.append(rest)
    return "".join(accented), "".join(plain)


def _split_hangul(text: Column) -> Column:
    """Hangul syllables as their letters, the one decomposition that yields several characters."""
    leads = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowels = F.array(*[F.lit(chr(0x1161 + i)) for i in range(_VOWELS)])
    tails = F.array(F.lit(""), *[F.lit(chr(0x11A7 + i)) for i in range(1, _TAILS)])

    def letters(char: Column) -> Column:
        # UTF-8 code point of a three-byte character, from its hex form.
        code = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int")
        index = code - _HANGUL_BASE
        parts = F.concat(
            F.element_at(leads, (index / (_VOWELS * _TAILS)).cast("int") + 1),
            F.element_at(vowels, ((index % (_VOWELS * _TAILS)) / _TAILS).cast("int") + 1),
            F.element_at(tails, index % _TAILS + 1),
        )
        return F.when(char.rlike("[가-힣]"), parts).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), letters), "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decompose(text: Column, mark: str = "") -> Column:
    """``text`` decomposed, every combining mark replaced by ``mark``."""
    accented, plain = _accent_table()
    bare = F.regexp_replace(F.translate(text, accented, plain), r"\p{M}" + ("" if mark else "+"), mark)
    return bind(bare, lambda t: F.when(t.rlike("[가-힣]"), _split_hangul(t)).otherwise(t))


def fold_accents(text: Column) -> Column:
    """``text`` decomposed and without combining marks; plain ASCII passes through untouched.

    Mentions ``text`` three times: give it a column, or a value under :func:`bind`.
    """
    return F.when(text.rlike(r"[^\x00-\x7F]"), decompose(text)).otherwise(text)


def character_list(characters: list[str]) -> str:
    """Characters by code point, for use inside a character class."""
    return "".join("\\x{%x}" % ord(c) for c in characters)


def strip_punctuation(text: Column, kept: list[str] | None = None, stand_in: str = "") -> Column:
    """Drop dash, bracket, quote and other punctuation, except the ``kept`` characters."""
    kept = [c for c in (KEPT_CHARACTERS if kept is None else kept) if unicodedata.category(c) != "Pc"]
    spared = f"&&[^{character_list(kept)}]" if kept else ""
    return F.regexp_replace(text, f"[{DROPPED_PUNCTUATION}{spared}]", stand_in)


def merge_blanks(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    merged = F.regexp_replace(text, f"[{BLANKS}]{{2,}}", " ")
    return F.regexp_replace(merged, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def bare_word(word: str) -> str:
    """A word without stand-ins; blanks inside, which occur only where another character delimits words, merged."""
    bare = word if word.isascii() else word.replace(STAND_IN, "")
    if not _BLANK.search(bare):
        return bare
    return _OUTER_BLANKS.sub("", _BLANK_RUN.sub(" ", bare))


@lru_cache(maxsize=None)
def _plain_character(char: str) -> str:
    kind = unicodedata.category(char)[0]
    if kind in "CM":
        return char if kind == "C" else ""
    parts = unicodedata.normalize("NFD", char)
    if "가" <= char <= "힣":
        return parts
    rest = "".join(c for c in parts if unicodedata.category(c)[0] != "M")
    return rest if len(rest) == 1 else char


def folded_word(word: str) -> str:
    """What :func:`decompose` makes of a bare word, blanks merged again."""
    return word if word.isascii() else bare_word("".join(map(_plain_character, word)))


class _Folded(dict):
    """What each character, by code point, becomes without accents."""

    def __missing__(self, code: int) -> str:
        plain = self[code] = _plain_character(chr(code))
        return plain


class Spellings:
    """The bare forms of words, with and without accents, for many words at once."""

    def __init__(self, kept: list[str] | None = None):
        spared = set(KEPT_CHARACTERS if kept is None else kept)
        every = [chr(code) for code in range(0x10000) if unicodedata.category(chr(code)) in _DROPPED_CLASSES]
        self.dropped = {ord(char): None for char in every if char not in spared}
        self.ascii_dropped = bytes(code for code in self.dropped if code < 0x80)
        self.ascii_lower = bytes(range(0x80)).lower() + bytes(range(0x80, 0x100))
        # Characters that stay in a word, though it takes others for it to count.
        self.hollow = {ord(char): None for char in every if char in spared}
        self.folded = _Folded()

    def forms(self, words: pa.Array, settled: bool) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Per word the number of its form; per number the form with and without accents, and whether ``count_terms`` counts it.

        Words stand as in a text that is ``settled`` (see ``SETTLED``), or else have lost their punctuation and cases already.
        """
        coded = words.dictionary_encode()
        bare = self._bare(coded.dictionary) if settled else pa.array([bare_word(word) for word in coded.dictionary.to_pylist()], pa.string())
        bare = bare.dictionary_encode()
        exact = bare.dictionary
        code = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        if settled:
            term = self._each(exact, lambda ascii: ascii, lambda other: other.translate(self.folded))
        else:
            term = pa.array([folded_word(word) for word in exact.to_pylist()], pa.string())
        solid = pc.not_equal(term, "").to_numpy(zero_copy_only=False)
        if self.hollow:
            solid = np.array([word.translate(self.hollow) != "" for word in term.to_pylist()], bool)
        return code, exact, term, solid

    def _bare(self, words: pa.Array) -> pa.Array:
        return self._each(words, lambda ascii: ascii.translate(self.ascii_lower, self.ascii_dropped), lambda other: other.translate(self.dropped).lower())

    @staticmethod
    def _each(words: pa.Array, ascii: Callable[[bytes], bytes], other: Callable[[str], str]) -> pa.Array:
        """Words without line ends, changed as one text: those of ASCII as bytes, others as a string."""
        plain = pc.string_is_ascii(words)
        result, parts = np.empty(len(words), np.int64), []
        for mask, change in ((plain, lambda found: ascii("\n".join(found).encode()).decode()), (pc.invert(plain), lambda found: other("\n".join(found)))):
            at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            result[at] = np.arange(len(at)) + sum(map(len, parts))
            parts.append(pa.array(change(words.take(pa.array(at)).to_pylist()).split("\n") if len(at) else [], pa.string()))
        return pa.concat_arrays(parts).take(pa.array(result))


def normalize_exact(text: Column, kept: list[str] | None = None) -> Column:
    """The term as compared with accents: punctuation gone, lower case, blank runs merged, trimmed."""
    return merge_blanks(F.lower(strip_punctuation(text, kept)))


def normalize_term(text: Column, kept: list[str] | None = None) -> Column:
    """The term as compared by default: as :func:`normalize_exact`, accents folded away."""
    return bind(normalize_exact(text, kept), fold_accents)


def split_words(text: Column) -> Column:
    """The words of ``text``; position in this array is a word's location everywhere else."""
    return F.when(text.contains(ZERO_WIDTH_SPACE), F.split(text, ZERO_WIDTH_SPACE)).otherwise(
        F.split(text, f"[{BLANKS}]+")
    )


def count_terms(text: Column) -> Column:
    """How many words of ``text`` survive normalization, in one regex pass."""
    blank_split = F.regexp_count(text, F.lit(f"{SOLID}[!-~[^{BLANKS}]]*"))
    zero_split = F.regexp_count(text, F.lit(f"{SOLID}[^{ZERO_WIDTH_SPACE}]*"))
    return F.when(text.contains(ZERO_WIDTH_SPACE), zero_split).otherwise(blank_split)


def escape_markup(text: Column) -> Column:
    """Angle brackets as entities."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def strip_zero_width(text: Column) -> Column:
    return F.replace(text, F.lit(ZERO_WIDTH_SPACE), F.lit(""))
