import struct

from shelfmark.functions.images import image_size
from shelfmark.operators import catalog as C
from shelfmark.sources import files as S
from shelfmark.sources import sinks as K


def existing(spark):
    return spark.createDataFrame(
        [
            (0, "a.png", ["old"], []), (1, "b.png", ["b1"], ["t"]), (2, "b.gif", ["b2"], []), (3, "a.png", ["new"], ["n"]),
            (4, "c.png", [], []), (5, "d.bmp", ["d"], []),
        ],
        "pos int, filename string, categories array<string>, tags array<string>",
    )


def test_label_precedence(spark):
    files = spark.createDataFrame([(n,) for n in ["a.png", "b.webp", "b.gif", "c.png", "c.webp", "d.gif", "e.png"]], "filename string")
    fresh = spark.createDataFrame(
        [("c.webp", ["f"], []), ("a.png", ["fa"], [])], "filename string, categories array<string>, tags array<string>"
    )
    got = {r["filename"]: (r["categories"], r["label_source"]) for r in C.carry_labels(files, existing(spark), fresh).collect()}
    assert got == {
        "a.png": (["new"], "same_name"), "b.webp": (["b1"], "same_stem"), "b.gif": (["b2"], "same_name"),
        "c.png": ([], "none"), "c.webp": (["f"], "fresh"), "d.gif": (["d"], "same_stem"), "e.png": ([], "none"),
    }
    forced = {r["filename"]: r["categories"] for r in C.carry_labels(files, existing(spark), fresh, force=True).collect()}
    assert forced["a.png"] == ["fa"] and forced["b.webp"] == [] and forced["b.gif"] == ["b2"]
    need = sorted(r["filename"] for r in C.unlabelled(files, existing(spark)).collect())
    assert need == ["c.png", "c.webp", "e.png"]


def test_first_place_of_a_repeated_name_counts_for_its_stem(spark):
    old = spark.createDataFrame(
        [(0, "x.png", ["first"], []), (1, "x.gif", ["gif"], []), (2, "x.png", ["last"], [])],
        "pos int, filename string, categories array<string>, tags array<string>",
    )
    files = spark.createDataFrame([("x.webp",)], "filename string")
    assert C.carry_labels(files, old).first()["categories"] == ["last"]


def test_labeller_failures_give_no_row(spark):
    files = spark.createDataFrame(
        [("a.png", b"1"), ("b.png", b"boom"), ("c.png", b"prose"), ("d.PNG", b"1")], "filename string, content binary"
    )

    def labeller(content):
        if content == b"boom":
            raise RuntimeError
        return "prose" if content == b"prose" else '{"categories": ["x"], "tags": []}'

    assert [r["filename"] for r in C.label_assets(files, labeller).collect()] == ["a.png"]


def test_image_sizes():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\x03"
    block = b"\x2c" + bytes(8) + b"\x00\x02\x01\xaa\x00"
    gif = b"GIF89a" + struct.pack("<HH", 3, 4) + b"\x80\x00\x00" + bytes(6) + b"\x21\xf9\x01\x00\x00" + block + block + b"\x3b"
    lossless = b"RIFF....WEBPVP8L....\x2f" + ((11 - 1) | ((12 - 1) << 14)).to_bytes(4, "little")
    # Two frames, in chunks of an odd size; what a frame holds is no chunk.
    frame = b"ANMF" + (5).to_bytes(4, "little") + b"ANMF.\0"
    extended = b"RIFF....WEBPVP8X" + (10).to_bytes(4, "little") + b"\x02\0\0\0" + (19).to_bytes(3, "little") + (29).to_bytes(3, "little") + 2 * frame
    assert image_size(png) == (7, 9, 1)
    assert image_size(jpeg) == image_size(jpeg[:2] + b"\xff\xff" + jpeg[2:]) == (6, 5, 1)
    assert image_size(gif) == (3, 4, 2)
    assert image_size(lossless) == (11, 12, 1)
    assert image_size(extended) == (20, 30, 2)
    assert image_size(b"plain text") is None and image_size(png[:18]) is None and image_size(None) is None


def test_catalog_files(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(
        '{"total": 2, "lastUpdated": "2024-01-01T00:00:00.000Z", "emojis": ['
        '{"id": "1", "filename": "b.png", "path": "/emojis/b.png", "categories": ["x"], "tags": [], "created": "2024-01-01T00:00:00.000Z", "size": 3},'
        '{"id": "2", "filename": "a.png", "path": "/emojis/a.png", "categories": [], "tags": ["y"], "created": "2024-01-02T00:00:00.000Z", "size": 4}]}'
    )
    (tmp_path / "broken.json").write_text("{nothing")
    catalog = S.read_catalog(spark, str(tmp_path / "catalog.json"))
    assert [(r["pos"], r["filename"], r["size"]) for r in catalog.orderBy("pos").collect()] == [(0, "b.png", 3), (1, "a.png", 4)]
    assert S.read_catalog(spark, str(tmp_path / "broken.json")).count() == 0
    assert S.read_catalog(spark, str(tmp_path / "absent.json")).count() == 0
    out = str(tmp_path / "out")
    stats = K.write_catalog(catalog, out, json=True)
    assert stats == C.catalog_stats(catalog).first().asDict()
    assert spark.read.json(f"{out}/stats").first()["total"] == 2
    lines = [r["filename"] for r in spark.read.json(f"{out}/records").coalesce(1).collect()]
    assert sorted(lines) == ["a.png", "b.png"]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ["a.PNG", "b.txt", "sub/c d+e.gif"]:
        (tmp_path / name).write_bytes(b"12345")
    flat = S.scan_assets(spark, str(tmp_path), ["png", "gif"])
    assert [r["filename"] for r in flat.collect()] == ["a.PNG"]
    deep = S.scan_assets(spark, str(tmp_path), ["png", "gif"], recursive=True, content=True)
    assert sorted((r["filename"], r["size"], bytes(r["content"])) for r in deep.collect()) == [
        ("a.PNG", 5, b"12345"), ("c d+e.gif", 5, b"12345")
    ]
