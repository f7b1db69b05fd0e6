import random

from pyspark.sql import functions as F

from shelfmark.operators import export as E
from shelfmark.sources import sinks as K

ORIGIN = "http://localhost:3000"


def selected(spark):
    rows = [(1, 1, "1", "emoji1.png", "/emojis/emoji1.png"), (1, 2, "2", "emoji2.png", "/emojis/emoji2.png")]
    return spark.createDataFrame(rows, "user_id bigint, place bigint, id string, filename string, path string")


def lines(df):
    return [r["line"] for r in df.orderBy("place").collect()]


def test_renderings(spark, tmp_path):
    rows = selected(spark)
    assert lines(E.export_text(rows)) == ["emoji1.png", "emoji2.png"]
    assert "\n".join(lines(E.export_html(rows, ORIGIN))) == (
        f'<img src="{ORIGIN}/emojis/emoji1.png" alt="emoji1.png" />\n<img src="{ORIGIN}/emojis/emoji2.png" alt="emoji2.png" />'
    )
    assert lines(E.export_css(rows, ORIGIN))[0] == (
        f".emoji-1 {{\n  background-image: url('{ORIGIN}/emojis/emoji1.png');\n  background-size: contain;\n"
        "  background-repeat: no-repeat;\n  background-position: center;\n}"
    )
    assert "\n".join(lines(E.export_markdown(rows, ORIGIN))) == (
        "| Emoji | Filename |\n|---|---|\n"
        f"| ![emoji1.png]({ORIGIN}/emojis/emoji1.png) | emoji1.png |\n| ![emoji2.png]({ORIGIN}/emojis/emoji2.png) | emoji2.png |"
    )
    K.write_lines(E.export_text(rows), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "user_id=1").glob("*.txt"))
    assert "".join(p.read_text() for p in parts) == "emoji1.png\nemoji2.png\n"


def test_attribute_values_are_escaped(spark):
    rows = spark.createDataFrame([(1, 1, "1", 'a"<b>.png', "/x")], "user_id bigint, place bigint, id string, filename string, path string")
    assert lines(E.export_html(rows, None)) == ['<img src="/x" alt="a&quot;&lt;b&gt;.png" />']


def test_encoded_rows(spark):
    files = spark.createDataFrame([("a.JPG", b"x" * 100), ("b.svg", b"y"), ("c.webp", b"")], "filename string, content binary")
    got = {r["filename"]: tuple(r)[1:4] for r in E.base64_rows(files).collect()}
    assert got == {"a.JPG": (".jpg", 100, "image/jpeg"), "c.webp": (".webp", 0, "image/webp")}
    assert "\n" not in E.base64_rows(files).where("filename = 'a.JPG'").first()["base64"]


def greedy(rows, most):
    part, filled, out = 1, 0, {}
    for size, name in sorted(rows, key=lambda r: (-r[0], r[1])):
        if filled >= most:
            part, filled = part + 1, 0
        out[name] = part
        filled += size
    return out


def test_packing_is_the_greedy_fold(spark):
    rng = random.Random(8)
    for most in (100, 37, 1):
        rows = [(rng.choice([0, 1, 5, 5, 5, 5, 9, 30, rng.randint(0, 150)]), f"f{i:04d}") for i in range(300)]
        df = spark.createDataFrame(rows, "size bigint, filename string")
        for hot_rows in (20, 10_000):
            packed = E.pack_by_size(df, most, hot_rows=hot_rows)
            assert {r["filename"]: r["part"] for r in packed.collect()} == greedy(rows, most)
    assert {r["part"] for r in E.pack_by_size(df, 0).collect()} == {1}


def test_packing_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_BROADCAST_SIZES", 0)
    rows = [(i % 7, f"f{i:03d}") for i in range(120)]
    packed = E.pack_by_size(spark.createDataFrame(rows, "size bigint, filename string"), 20, hot_rows=10)
    assert {r["filename"]: r["part"] for r in packed.collect()} == greedy(rows, 20)


def test_bundle(spark):
    files = spark.createDataFrame([("1", "a", b"12"), ("2", "b", b"3")], "id string, filename string, content binary")
    selection = spark.createDataFrame([(1, 1, "2"), (2, 1, "2")], "user_id bigint, place bigint, item_id string")
    assert [tuple(r) for r in E.bundle_manifest(E.export_bundle(selection, files)).collect()] == [("2", "b", 1)]


def test_encoded_rows_are_counted_as_they_are_written(spark, tmp_path):
    rows = E.base64_rows(spark.createDataFrame([("a.png", bytearray(b"12345")), ("b.txt", bytearray(b"1")), ("c.gif", bytearray(b"123"))], "filename string, content binary"))
    for by_part in (False, True):
        out = str(tmp_path / str(by_part))
        counted = K.write_encoded(rows.withColumn("part", F.lit(1)), out, by_part)
        written = spark.read.json(out)
        assert counted == {"rows": written.count(), "bytes": written.agg(F.sum("size_bytes")).first()[0]} == {"rows": 2, "bytes": 8}
    empty = K.write_encoded(rows.where("filename = 'none'"), str(tmp_path / "empty"))
    assert empty == {"rows": 0, "bytes": 0}
