import random
import unicodedata

from pyspark.sql import functions as F
from shelfmark.functions import text as T
from shelfmark.operators import index as X


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M")


def test_fold_accents_matches_decomposition(column):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00), *range(0x300, 0x340),
                             *range(0xAC00, 0xAD00), 0xD7A3, 0xD55C, 0x1F600, 0xFB1D, 0x304C]]
    texts = ["".join(rng.choice(pool) for _ in range(30)) for _ in range(200)] + ["", "plain"]
    assert column(texts, "string", T.fold_accents) == [fold(t) for t in texts]


def test_normalize_term(column):
    terms = ["  Été,  (Foo)  BAR ", "snake_case", "...", "“Quoted”—dash", "한글", ""]
    assert column(terms, "string", T.normalize_term) == ["ete foo bar", "snake_case", "", "quoteddash", fold("한글"), ""]
    assert column(["a-b.c"], "string", lambda c: T.normalize_term(c, kept=["-"])) == ["a-bc"]


def test_positions_count_every_word(spark):
    docs = spark.createDataFrame(
        [(1, "en", "A — b, ’ Ćafé d"), (2, "en", " lead"), (3, "ja", "猫​の​名 前​"), (4, "en", ""), (5, "en", "́ x")],
        "doc_id int, lang string, content string",
    )
    rows = X.document_terms(docs).orderBy("doc_id", "position").collect()
    got = [(r["doc_id"], r["position"], r["term_exact"], r["term"]) for r in rows]
    assert got == [
        (1, 0, "a", "a"), (1, 2, "b", "b"), (1, 4, docs.first()["content"].split(" ")[4].lower(), "cafe"), (1, 5, "d", "d"),
        (2, 1, "lead", "lead"), (3, 0, "猫", "猫"), (3, 1, "の", "の"), (3, 2, "名 前", "名 前"), (5, 1, "x", "x"),
    ]
    counts = {r["doc_id"]: r["n_terms"] for r in X.document_lengths(docs).collect()}
    assert counts == {1: 4, 2: 1, 3: 3, 4: 0, 5: 1}


def test_escape_markup(column):
    assert column(["a<b>c"], "string", T.escape_markup) == ["a&lt;b&gt;c"]
    assert column(["a​b"], "string", lambda c: T.strip_zero_width(c)) == ["ab"]
    assert column(["x y"], "string", lambda c: F.size(T.split_words(c))) == [2]
