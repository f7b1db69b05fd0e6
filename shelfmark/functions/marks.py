"""Highlighting: options become one pattern per keyword, columns are marked with it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that stand for each other when accents are ignored,
# one group per letter, lower case.
ACCENT_GROUPS = [
    "aàáảãạăằắẳẵặâầấẩẫậäåāą",
    "cçćč",
    "dđď",
    "eèéẻẽẹêềếểễệëěēę",
    "iìíỉĩịîïī",
    "lł",
    "nñňń",
    "oòóỏõọôồốổỗộơởỡớờợöøō",
    "rř",
    "sšśșş",
    "tťțţ",
    "uùúủũụưừứửữựûüůū",
    "yýỳỷỹỵÿ",
    "zžżź",
]
# Invisible joiners, and the limiters of whole words.
JOINERS = "­​‌‍"
LIMITERS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿"
# Fixed value: the attribute that tells own wrappers from other tags.
WRAPPER_ATTRIBUTE = 'data-markjs="true"'

_SPECIAL = set("-[]/{}()*+?.\\^$|&~#<>\"'@:;=!,%`_ ")


@dataclass(frozen=True)
class MarkOptions:
    element: str = "mark"
    class_name: str = ""
    separate_words: bool = True
    case_sensitive: bool = False
    diacritics: bool = True
    accuracy: str = "partially"
    limiters: list[str] = field(default_factory=list)
    synonyms: dict[str, str] = field(default_factory=dict)
    wildcards: str = "disabled"
    ignore_joiners: bool = False
    ignore_punctuation: list[str] = field(default_factory=list)


def keywords_of(terms: list[str], separate_words: bool = True) -> list[str]:
    """Distinct non-blank keywords, longest first."""
    parts = [p for t in terms for p in (t.split(" ") if separate_words else [t])]
    return sorted(dict.fromkeys(p for p in parts if p.strip()), key=len, reverse=True)


def _quote(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL and c != " " else c for c in text)


def _class_of(char: str, options: MarkOptions) -> str:
    """Pattern of one literal character: itself or its accent group."""
    if options.diacritics:
        for group in ACCENT_GROUPS:
            if char in group:
                return f"[{group}]" if options.case_sensitive else f"[{group}{group.upper()}]"
            if char in group.upper():
                return f"[{group.upper()}]" if options.case_sensitive else f"[{group}{group.upper()}]"
    return _quote(char)


def _literal(text: str, options: MarkOptions) -> list[str]:
    """Pattern parts of plain text: one per character, blank runs as one part."""
    return [r"\s+" if part.isspace() else _class_of(part, options) for part in re.findall(r"\s+|\S", text)]


def _with_wildcards(text: str, options: MarkOptions) -> list[str]:
    """As :func:`_literal`; an unescaped ``?`` or ``*`` stands for other characters."""
    if options.wildcards == "disabled":
        return _literal(text, options)
    spaces = options.wildcards == "withSpaces"
    wild = {"?": r"[\S\s]?" if spaces else r"\S?", "*": r"[\S\s]*?" if spaces else r"\S*"}
    parts: list[str] = []
    for piece in re.findall(r"\\[?*]|[?*]|[^?*\\]+|\\", text):
        if piece in wild:
            parts.append(wild[piece])
        else:
            parts += _literal(piece[1] if len(piece) == 2 and piece[0] == "\\" and piece[1] in "?*" else piece, options)
    return parts


def _fillers(options: MarkOptions) -> str:
    ignored = "".join(_quote(c) for c in "".join(options.ignore_punctuation)) + (JOINERS if options.ignore_joiners else "")
    return f"[{ignored}]*" if ignored else ""


def keyword_pattern(keyword: str, options: MarkOptions) -> str:
    """What one keyword matches, before word boundaries: synonyms, wildcards, accents, joiners."""
    filler = _fillers(options)
    pairs = [(a, b) for a, b in options.synonyms.items() if a and b]
    flags = 0 if options.case_sensitive else re.IGNORECASE

    def build(text: str, pairs: list[tuple[str, str]]) -> list[str]:
        if not pairs:
            return _with_wildcards(text, options)
        (one, other), rest = pairs[0], pairs[1:]
        found = re.compile(f"{re.escape(one)}|{re.escape(other)}", flags)
        parts: list[str] = []
        at = 0
        for match in found.finditer(text):
            parts += build(text[at : match.start()], rest)
            either = [filler.join(_with_wildcards(x, options)) for x in (one, other)]
            parts.append(f"(?:{either[0]}|{either[1]})")
            at = match.end()
        return parts + build(text[at:], rest)

    return filler.join(build(keyword, pairs))


def mark_pattern(keywords: list[str], options: MarkOptions) -> str:
    """One pattern for all keywords; group 1 is kept before the mark, group 2 is marked."""
    either = "|".join(keyword_pattern(k, options) for k in keywords)
    head = "(?s)" if options.case_sensitive else "(?isu)"
    limits = "".join("|" + _quote(x) for x in options.limiters)
    if options.accuracy == "exactly":
        return f"{head}(^|\\s{limits})({either})(?=$|\\s{limits})"
    if options.accuracy == "complementary":
        stop = "\\s" + ("".join(_quote(x) for x in options.limiters) if options.limiters else
                        "".join(_quote(c) for c in LIMITERS))
        return f"{head}()([^{stop}]*(?:{either})[^{stop}]*)"
    if options.accuracy == "partially":
        return f"{head}()({either})"
    raise ValueError(f"unknown accuracy {options.accuracy!r}")


def opening_tag(options: MarkOptions) -> str:
    named = f' class="{options.class_name}"' if options.class_name else ""
    return f"<{options.element} {WRAPPER_ATTRIBUTE}{named}>"


def closing_tag(options: MarkOptions) -> str:
    return f"</{options.element}>"


def _replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def mark_keywords(text: Column, terms: list[str], options: MarkOptions = MarkOptions()) -> Column:
    """``text`` with every keyword wrapped, longest keyword first where several match."""
    keywords = keywords_of(terms, options.separate_words)
    if not keywords:
        return text
    wrapped = f"$1{_replacement(opening_tag(options))}$2{_replacement(closing_tag(options))}"
    return F.regexp_replace(text, mark_pattern(keywords, options), wrapped)


def count_marks(text: Column, terms: list[str], options: MarkOptions = MarkOptions()) -> Column:
    keywords = keywords_of(terms, options.separate_words)
    if not keywords:
        return F.lit(0)
    return F.regexp_count(text, F.lit(mark_pattern(keywords, options)))


def unmatched_keywords(text: Column, terms: list[str], options: MarkOptions = MarkOptions()) -> Column:
    """The keywords that occur nowhere in ``text``."""
    checks = [
        F.when(~text.rlike(mark_pattern([k], options)), F.lit(k)) for k in keywords_of(terms, options.separate_words)
    ]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def mark_regexp(text: Column, pattern: str, ignore_groups: int = 0, options: MarkOptions = MarkOptions()) -> Column:
    """Wrap the match of any pattern, or its first group behind ``ignore_groups`` leading ones.

    With ignored groups the pattern must consist of adjoining groups, as its match is rebuilt
    from them.
    """
    tags = _replacement(opening_tag(options)), _replacement(closing_tag(options))
    if ignore_groups == 0:
        return F.regexp_replace(text, pattern, f"{tags[0]}$0{tags[1]}")
    groups = re.compile(re.sub(r"\(\?[a-zA-Z]+\)", "", pattern)).groups
    before = "".join(f"${i}" for i in range(1, ignore_groups + 1))
    after = "".join(f"${i}" for i in range(ignore_groups + 2, groups + 1))
    return F.regexp_replace(text, pattern, f"{before}{tags[0]}${ignore_groups + 1}{tags[1]}{after}")


def accepted_ranges(ranges: Column) -> Column:
    """Ranges in order that reach beyond the ones before them, with where their mark starts.

    ``ranges`` is an array of struct(start, length). A partly overlapping range passes; its mark
    covers only what is not marked yet.
    """
    ordered = F.array_sort(F.filter(ranges, lambda r: r["start"].isNotNull() & (r["length"] > 0)))
    kind = "array<struct<start:int,stop:int>>"
    first = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("taken"))

    def step(state: Column, r: Column) -> Column:
        stop = (r["start"] + r["length"]).cast("int")
        begin = F.greatest(r["start"].cast("int"), state["last"])
        grown = F.concat(state["taken"], F.array(F.struct(begin.alias("start"), stop.alias("stop"))))
        return F.when(stop > state["last"], F.struct(stop.alias("last"), grown.alias("taken"))).otherwise(state)

    return F.aggregate(ordered, first, step, lambda s: s["taken"])


def markable_ranges(text: Column, ranges: Column) -> Column:
    """Accepted ranges cut to the text, without those that hold blanks only."""
    size = F.length(text)
    cut = F.transform(accepted_ranges(ranges), lambda r: F.struct(
        F.least(r["start"], size).alias("start"), F.least(r["stop"], size).alias("stop")))
    return F.filter(cut, lambda r: (r["start"] >= 0)
                    & F.substring(text, r["start"] + 1, r["stop"] - r["start"]).rlike(r"\S"))


def mark_ranges(text: Column, ranges: Column, options: MarkOptions = MarkOptions()) -> Column:
    """``text`` with its markable ranges wrapped."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, r: Column) -> Column:
        between = F.substring(text, state["at"] + 1, r["start"] - state["at"])
        marked = F.substring(text, r["start"] + 1, r["stop"] - r["start"])
        parts = F.array(between, F.lit(opening_tag(options)), marked, F.lit(closing_tag(options)))
        return F.struct(r["stop"].alias("at"), F.concat(state["parts"], parts).alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.substring(text, state["at"] + 1, F.length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    return F.aggregate(markable_ranges(text, ranges), start, step, finish)


def unmark(text: Column, options: MarkOptions = MarkOptions()) -> Column:
    """``text`` without own wrappers; their content stays."""
    element = options.element or r"[a-zA-Z][\w-]*"
    named = f'(?=[^>]*\\bclass="[^"]*\\b{re.escape(options.class_name)}\\b)' if options.class_name else ""
    own = f"<({element})\\b(?=[^>]*{WRAPPER_ATTRIBUTE}){named}[^>]*>(.*?)</\\1>"
    return F.regexp_replace(text, f"(?s){own}", "$2")


def url_terms(url: Column, parameter: str) -> Column:
    """Every value of a repeated query parameter, decoded."""
    query = F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), "^", "&")
    values = F.regexp_extract_all(query, F.lit(f"&{re.escape(parameter)}=([^&]*)"), 1)
    return F.transform(values, F.try_url_decode)
