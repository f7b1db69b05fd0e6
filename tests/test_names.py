from shelfmark.functions import labels as L
from shelfmark.functions import names as N


def test_split_name(column):
    names = ["a.png", "a.b.png", ".bashrc", "plain", "..", "a.", "...", "..a", ".a.b", "a\n.x"]
    assert column(names, "string", N.stem_of) == ["a", "a.b", ".bashrc", "plain", "..", "a", "..", ".", ".a", "a\n"]
    assert column(names, "string", N.extension_of) == [".png", ".png", "", "", "", ".", ".", ".a", ".b", ".x"]


def test_normalize_filename(column):
    expected = {
        "01 - Happy_Cat.PNG": "happy-cat.png",
        "__x__.gif": "x.gif",
        "a b.png": "ab.png",
        "!!!.jpg": "emoji.jpg",
        "12-34.png": "34.png",
        "é-.gif": "emoji.gif",
        "a--__b.webp": "a-b.webp",
        ".hidden": "hidden",
        "-a!-.png": "a.png",
        # Dashes are trimmed before symbols go, so one may be left at an end.
        "!-a-!.png": "-a-.png",
    }
    assert dict(zip(expected, column(list(expected), "string", N.normalize_filename))) == expected


def test_trim_numbered_name(column):
    names = ["cat_2.png", "cat-4.png", "cat 3.gif", "cat_12.png", "_1.png", "cat2.png"]
    assert column(names, "string", N.trim_numbered_name) == [
        "cat.png", "cat-4.png", "cat.gif", "cat_12.png", "emoji.png", "cat2.png"
    ]


def test_extensions(column):
    names = ["a.JPG", "a.svg", "a.jpg.txt", "jpg"]
    assert column(names, "string", lambda c: N.has_extension(c, N.IMPORT_TYPES)) == [True, True, False, False]
    assert column(names, "string", lambda c: N.has_extension(c, N.LABEL_TYPES, case_sensitive=True)) == [False] * 4


def test_urls(column):
    origin = "http://localhost:3000"
    assert column(["/emojis/a.png", "x.png", "https://h/y"], "string", lambda c: N.absolute_url(c, origin)) == [
        origin + "/emojis/a.png", origin + "/x.png", "https://h/y"
    ]
    assert column(["/a//b", "https://h/c", "//h/d"], "string", lambda c: N.result_url(c, "https://e.com/s/")) == [
        "https://e.com/s/a/b", "https://h/c", "//h/d"
    ]
    from pyspark.sql import functions as F

    made = column(["/a?x=1#top"], "string", lambda c: N.result_url(c, "", F.lit("red gear & co"), "mark"))
    assert made == ["/a?x=1&mark=red&mark=gear&mark=%26&mark=co#top"]


def test_labels(column):
    paths = ["/emojis/meow.png", "/emojis/cat-meow.png", "/emojis/catroo.gif", "/emojis/roo.gif", "/emojis/Dog.gif"]
    assert column(paths, "string", L.related_tags) == [
        ["cat", "kitten", "animal"], ["cat", "kitten", "animal"], ["meow", "kitten", "animal"], ["animal", "panda"], [],
    ]
    replies = ['{"categories":["a"],"tags":["b"]}', '```json\n{"categories":["a"]}\n```', '{"tags":["b"]}', "no labels", None, "{}"]
    parsed = column(replies, "string", L.parse_label_reply)
    assert [None if p is None else (p["categories"], p["tags"]) for p in parsed] == [
        (["a"], ["b"]), (["a"], []), ([], ["b"]), None, None, ([], [])
    ]
