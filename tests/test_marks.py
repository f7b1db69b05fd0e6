import random

import pytest
from pyspark.sql import functions as F
from shelfmark.functions import marks as M

O, C = '<mark data-markjs="true">', "</mark>"


def show(marked):
    return marked.replace(O, "[").replace(C, "]")


def marked(column, texts, terms, **options):
    return [show(t) for t in column(texts, "string", lambda c: M.mark_keywords(c, terms, M.MarkOptions(**options)))]


def test_keywords():
    assert M.keywords_of(["to be", "be  not", " "]) == ["not", "to", "be"]
    assert M.keywords_of(["to be", "to be"], separate_words=False) == ["to be"]


def test_partial_and_case(column):
    assert marked(column, ["The cat, concat."], ["cat"]) == ["The [cat], con[cat]."]
    assert marked(column, ["The the"], ["the"], case_sensitive=True) == ["The [the]"]
    assert marked(column, ["a  b\nc"], ["a b c"], separate_words=False) == ["[a  b\nc]"]
    assert marked(column, ["x (y) $1 \\"], ["(y)", "$1"]) == ["x [(y)] [$1] \\"]
    assert marked(column, ["same"], [" "]) == ["same"]


def test_accents(column):
    assert marked(column, ["Éte ete", "øre"], ["été"]) == ["[Éte] [ete]", "øre"]
    assert marked(column, ["Éte ete"], ["ete"], diacritics=False) == ["Éte [ete]"]


def test_accuracy(column):
    assert marked(column, ["cat concat cats, x-cat"], ["cat"], accuracy="complementary") == ["[cat] [concat] [cats], x-[cat]"]
    assert marked(column, ["cat cat concat cat. cat"], ["cat"], accuracy="exactly") == ["[cat] [cat] concat cat. [cat]"]
    assert marked(column, ["cat cat. cat,"], ["cat"], accuracy="exactly", limiters=["."]) == ["[cat] [cat]. cat,"]
    with pytest.raises(ValueError):
        M.mark_pattern(["x"], M.MarkOptions(accuracy="nearly"))


def test_variants(column):
    assert marked(column, ["one 1 ONE"], ["one"], synonyms={"1": "one"}) == ["[one] [1] [ONE]"]
    assert marked(column, ["tone ton t n tn"], ["t?n"], wildcards="enabled") == ["[ton]e [ton] t n [tn]"]
    assert marked(column, ["t n"], ["t?n"], wildcards="withSpaces") == ["[t n]"]
    assert marked(column, ["what? whatx"], ["what\\?"], wildcards="enabled") == ["[what?] whatx"]
    assert marked(column, ["lorem* loremipsum x"], ["lorem*"], wildcards="enabled") == ["[lorem*] [loremipsum] x"]
    assert marked(column, ["c­at c.a-t"], ["cat"], ignore_joiners=True) == ["[c­at] c.a-t"]
    assert marked(column, ["c­at c.a-t"], ["cat"], ignore_punctuation=[".", "-"]) == ["c­at [c.a-t]"]


def test_counts(column):
    texts = ["the cat", "a dog"]
    assert column(texts, "string", lambda c: M.count_marks(c, ["cat the"])) == [2, 0]
    assert column(texts, "string", lambda c: M.unmatched_keywords(c, ["cat dog"])) == [["dog"], ["cat"]]


def test_regexp_and_unmark(column):
    texts = ["v1 v22", "x"]
    assert [show(t) for t in column(texts, "string", lambda c: M.mark_regexp(c, r"\d+"))] == ["v[1] v[22]", "x"]
    assert [show(t) for t in column(texts, "string", lambda c: M.mark_regexp(c, r"(v)(\d)(\d?)", 1))] == ["v[1] v[2]2", "x"]
    options = M.MarkOptions(element="b", class_name="k")
    texts = ["red cat", '<b>cat</b> <b class="k">x</b>']
    assert column(texts, "string", lambda c: M.unmark(M.mark_keywords(c, ["cat"], options), options)) == texts
    assert column(texts, "string", lambda c: M.unmark(M.mark_keywords(c, ["cat"]), options)) != texts


def reference_ranges(text, ranges):
    out, last = [], 0
    for start, length in sorted(ranges):
        end = start + length
        if length > 0 and end > last:
            out.append((max(start, last), end))
            last = end
    marked, at = "", 0
    for start, end in out:
        start, end = min(start, len(text)), min(end, len(text))
        if text[start:end].strip() == "":
            continue
        marked += text[at:start] + O + text[start:end] + C
        at = end
    return marked + text[at:]


def test_ranges(spark):
    rng = random.Random(5)
    text = "ab  cd ef   gh é ij"
    cases = [[(rng.randint(0, 24), rng.randint(0, 8)) for _ in range(rng.randint(0, 6))] for _ in range(150)]
    rows = spark.createDataFrame([(i, text, c) for i, c in enumerate(cases)], "i int, t string, r array<struct<start:int,length:int>>")
    got = {r["i"]: r["m"] for r in rows.select("i", M.mark_ranges(F.col("t"), F.col("r")).alias("m")).collect()}
    assert got == {i: reference_ranges(text, c) for i, c in enumerate(cases)}


def test_url_terms(column):
    urls = ["http://x/y?hl=red+gear&a=1&hl=%C3%A9#hl=no", "http://x/y?whl=1"]
    assert column(urls, "string", lambda c: M.url_terms(c, "hl")) == [["red gear", "é"], []]
