"""Decontamination, spelling variants and hard negatives against brute force, with nulls, ties, hot keys and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate as D
from shelfmark.llm import negatives as H
from shelfmark.llm import queries
from shelfmark.llm import variants as V

CLASHING = "score string, row string, items string, words string, key string, at string"


@pytest.fixture
def docs(spark, tmp_path):
    def write(texts, name="docs", column="doc_id", first=0, ids=None):
        ids = ids or range(first, first + len(texts))
        rows = [(i, t, *"abcdef") for i, t in zip(ids, texts)]
        spark.createDataFrame(rows, f"{column} bigint, text string, {CLASHING}").repartition(3).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return write


# Wu-Manber search


def words_in(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contaminated(texts, items):
    strings = {}
    for name, text in items:
        words = words_in(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            strings.setdefault(tuple(words[i : i + size]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        words, hit, found = words_in(text), set(), set()
        for size in {len(s) for s in strings}:
            for i in range(len(words) - size + 1):
                owners = strings.get(tuple(words[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    found |= owners
        out.append((len(words), sorted(hit), sorted(found)))
    return out


def compared(spark, docs, texts, items):
    benchmark = docs([t for _, t in items], "items", "item_id", ids=[i for i, _ in items])
    got = {r.doc_id: r for r in D.contamination(docs(texts), benchmark).collect()}
    for i, (n, hit, found) in enumerate(contaminated(texts, items)):
        assert got[i].n_words == n and got[i]["items"] == found, i
        assert [p for r in got[i].ranges for p in range(r.start, r.end)] == hit, i
    return got


def test_occurrences_are_those_of_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = ["a", "Ab", "abc", "zürich", "日本", "x9", "the", "of", "lorem", "überlang" * 9]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(12)]
    # Two items of one text, rows that share an id, a null id, items without words.
    items += [(90, items[6][1]), (91, "..."), (92, None), (3, " ".join(words(25))), (None, " ".join(words(14)))]
    texts = [None, "", " .,;\n", items[6][1].upper(), "x" + items[7][1], items[8][1].replace(" ", " -- ")]
    texts += [" ".join(words(rng.randint(1, 400)) + items[rng.randrange(12)][1].split() + words(5)) for _ in range(60)]
    # A third of all texts hold one passage; one text is very long, and one is all passages.
    texts += [f"{i} {items[-1][1]}" for i in range(30)]
    texts += [" ".join(words(150_000) + items[9][1].split()), " ".join(t for _, t in items if t) * 3]
    compared(spark, docs, texts, items)


def test_texts_beyond_a_slice_are_searched_whole(spark, docs):
    passage = " ".join(f"word{i}" for i in range(12))
    long = "filler text " * 800_000 + passage
    got = compared(spark, docs, [long, "none", passage], [(1, passage)])
    assert [(r.start, r.end) for r in got[0].ranges] == [(1_600_000, 1_600_012)]


def test_no_items_and_no_texts(spark, docs):
    assert D.contamination(docs([]), docs(["a b"], "one", "item_id")).collect() == []
    assert [(r.n_words, r.ranges, r["items"]) for r in D.contamination(docs(["a b"], "two"), docs([], "three", "item_id")).collect()] == [(2, [], [])]


def test_the_scan_leaps(spark):
    strings = [D.plain(" ".join(f"w{i}x{j}" for j in range(10)).encode()) for i in range(50)]
    kind = D.Kind(10, 5, min(map(len, strings)))
    shift = np.full(1 << 16, kind.most, np.uint8)
    blocks = D.Blocks(b"".join(s[: kind.reach] for s in strings), kind.block)
    starts = np.arange(50) * kind.reach
    for place in range(kind.most):
        shift[D.slot(blocks.at(starts + place), 16)] = kind.most - 1 - place
    known = np.zeros(1 << 16, bool)
    known[D.slot(D.bucket(blocks, starts, kind), 16)] = True
    text = D.plain(b"some other words stand here and there " * 3000 + strings[7] + b" tail")
    places, _, looked = D.leaps(text, kind, shift, np.packbits(known, bitorder="little"))
    assert places.tolist() == [text.index(strings[7])] and looked < len(text) / 10


def test_contamination_query(spark, monkeypatch, docs):
    items = [(i, f"one two three four five six seven eight nine ten n{i}") for i in (9, 10)]
    tables = {"documents": docs(["x " + items[0][1], "nothing", None]), "benchmark": docs([t for _, t in items], "b", "item_id", ids=[9, 10])}
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: tables[name])
    got = {r.doc_id: r for r in queries.op11_contamination(spark, "").collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (12, 11, 2, True)
    assert got[0].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert [(got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in (1, 2)] == [(0, 0, hashlib.sha256(b"").hexdigest(), False)] * 2


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows, least=5):
    found = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            found[word] += 1
    words = {w: n for w, n in found.items() if len(w) >= 6 and n >= least}
    out, forms = {}, {}
    for word, n in words.items():
        near = [(-m, other) for other, m in words.items() if one_edit(word, other)]
        best = min(near) if near and -min(near)[0] >= 5 * n else None
        forms[word] = best[1] if best else None
        out[word] = [n, len(near), forms[word], -best[0] if best else None]
    for word in words:
        root = word
        while forms[root]:
            root = forms[root]
        out[word].append(root)
    return out


def test_variants_are_those_of_brute_force(spark, docs):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 14))) for _ in range(40)] + ["Ärmelkanal", "naïvement", "abcabc", "ÀÀÀÀÀÀ"]
    texts = []
    for base in bases:
        # Chains of forms: each step five times as rare.
        held, word = [], base
        for n in (250, 50, 10, 5):
            held += [word] * rng.choice([n, n, n - 1])
            at, letter = rng.randrange(len(word)), rng.choice("abcdeé")
            word = rng.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :] if len(word) > 6 else word])
        rng.shuffle(held)
        texts += [" ".join(held[i : i + 40]).capitalize() for i in range(0, len(held), 40)]
    texts += [None, "", "12 ... ", "Short abc", "abcdef×abcdef÷x " * 6, "palavra1palavra " * 2000]
    df = docs(texts)
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in V.variants(df).collect()}
    want = variants_of(enumerate(texts))
    assert got == want
    assert max(len(want), 1) > 60 and any(w[2] and want[w[2]][2] for w in want.values())


def test_groups_that_share_most_letters_are_cut_again(spark):
    rng = random.Random(2)
    # A third of all words have the same three quarters of their letters; most are more than an edit apart.
    words = {"abcdefghijkl" + "".join(rng.choice("mnop") for _ in range(4)) for _ in range(150)} | {"".join(rng.choice("xy") for _ in range(rng.randint(6, 9))) for _ in range(120)}
    rows = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if a < b and one_edit(a, b)}
    for bound in (1, 50, 10**9):
        assert {(r.a, r.b) for r in V.near(rows, bound).collect()} == want


def test_variants_of_nothing(spark, docs):
    assert V.variants(docs([])).collect() == []
    assert V.variants(docs([None, "a bc"], "few")).collect() == []


# Hard negatives


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], "vec_id bigint, embedding array<double>, label int, number string, bars string")


def mined(rows, every, k=5):
    whole = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows})
    out = []
    for i, label, vec in whole:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(vec, other)), j, own) for j, own, other in whole if j != i and len(other) == len(vec)]
        positives = sorted(s[:2] for s in scored if s[2] == label)[:k]
        for p, j in positives:
            inside = sorted(s[:2] for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m) in enumerate(inside)]
    return sorted(out)


BAD = [(5000, None, 1), (5001, [None, 1.0], 1), (5002, [math.nan, 1.0], 1), (5003, [math.inf, 0.0], 1), (5004, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]


@pytest.mark.parametrize("fragment,block", [(17, 5), (4096, 2048)])
def test_negatives_are_those_of_brute_force(spark, fragment, block):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 9))
    rows = [(i, [float(x) for x in np.round(centres[i % 4] * 0.7 + rng.normal(0, 0.5, 9), 2)], int(rng.choice([i % 4, 7]))) for i in range(260)]
    # A third of the rows share one vector, some are repeated, a label stands alone, and there are vectors of another length.
    rows = [(i, rows[0][1], 7) if i % 3 == 0 else r for i, r in enumerate(rows)] + rows[5:9] + [(300, rows[1][1], 55), (320, [1.0, 2.0], 1), (321, [1.0, 2.0], 1), (322, [0.9, 2.0], 2)]
    found = H.hard_negatives(H.usable(vectors(spark, rows + BAD)), F.col("vec_id") % 20 == 0, fragment=fragment, block=block)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == mined(rows, 20) and len(got) > 100


def test_large_components_are_exact(spark):
    rows = [(0, [2_000_000.0, 1.0], 1), (1, [1_000_000.0, 2.0], 1), (2, [999_999.0, 2.0], 2), (3, [1_000_000.0, 1.0], 2), (4, [900_000.0, -7.0], 3)]
    found = H.hard_negatives(H.usable(vectors(spark, rows)), F.col("vec_id") % 100 == 0)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect()) == mined(rows, 100)
    with pytest.raises(Exception, match="64 bits"):
        H.hard_negatives(H.usable(vectors(spark, [(0, [1e15], 1), (1, [1e15], 1)])), F.col("vec_id") % 100 == 0).collect()


def test_few_rows_and_none(spark):
    assert H.hard_negatives(H.usable(vectors(spark, [])), F.col("vec_id") % 100 == 0).collect() == []
    assert H.hard_negatives(H.usable(vectors(spark, [(0, [1.0], 1)])), F.col("vec_id") % 100 == 0).collect() == []


def test_the_vertical_scan_prunes():
    rng = np.random.default_rng(4)
    columns = np.floor(256 * (rng.normal(size=(64, 4000)) * np.geomspace(4, 0.02, 64)[:, None]))
    anchor = np.floor(256 * rng.normal(size=64) * np.geomspace(4, 0.02, 64))
    exact = anchor @ columns
    alive, score, read = H.descend(anchor, columns, columns.min(1), columns.max(1), np.arange(4000), H.best_rows(5))
    best = alive[H.ordered(score, alive, 5)]
    assert best.tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist() and read < columns.size / 2
    low = int(np.sort(exact)[-300])
    alive, score, read = H.descend(anchor, columns, columns.min(1), columns.max(1), np.arange(4000), H.best_in_windows([(low - 100, low)], 5))
    inside = np.flatnonzero((exact >= low - 100) & (exact <= low))
    assert set(inside[H.ordered(exact[inside], inside, 5)]) <= set(alive) and read < columns.size / 2
