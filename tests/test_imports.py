import random

from shelfmark.operators import imports as I


def split(name):
    stem, dot, ext = name.rpartition(".")
    return (stem, "." + ext) if dot and stem else (name, "")


def one_by_one(files, existing):
    """Targets given in order, each file walking on until a name is free."""
    taken, out = set(existing), {}
    for name, file_id, target in sorted(files):
        stem, ext = split(target)
        final, n = target, 0
        while final in taken:
            n += 1
            final = f"{stem}-{n}{ext}"
        taken.add(final)
        out[file_id] = final
    return out


def test_names_are_given_as_if_one_by_one(spark):
    rng = random.Random(3)
    for trial in range(4):
        stems = ["a", "a-1", "a-2", "a-1-1", "b", "b-10", "c-01"]
        files = [(f"f{rng.randint(0, 60):02d}", f"id{i:03d}", f"{rng.choice(stems)}.{rng.choice(['png', 'gif'])}")
                 for i in range(60)]
        existing = sorted({f"{rng.choice(['a', 'a-3', 'a-4', 'b-1', 'c-01'])}.png" for _ in range(trial)})
        rows = spark.createDataFrame(files, "name string, file_id string, target string")
        present = spark.createDataFrame([(e,) for e in existing], "name string") if existing else None
        for hot_rows in (5, 10_000) if trial == 1 else (10_000,):
            named = I.resolve_name_clash(rows, ["name", "file_id"], present, hot_rows=hot_rows)
            got = {r["file_id"]: r["final_name"] for r in named.collect()}
            assert got == one_by_one(files, existing)
            assert len(set(got.values())) == len(got)


def test_long_chain_of_native_names_ends(spark):
    files = [("A.png", "0", "a.png")] + [(f"a-{i}.png", f"n{i}", f"a-{i}.png") for i in range(1, 9)] + [("a.png", "1", "a.png")]
    rows = spark.createDataFrame(files, "name string, file_id string, target string")
    got = {r["file_id"]: r["final_name"] for r in I.resolve_name_clash(rows, ["name", "file_id"]).collect()}
    assert got == one_by_one(files, [])
    assert got["1"] == "a-9.png"


def test_a_large_family_meets_as_many_taken_names(spark, monkeypatch):
    """Every other name is taken: the n-th file gets the n-th odd place, in blocks of any size and a bounded number of jobs."""
    n = 3_000
    files = spark.range(n).selectExpr("'x' AS name", "lpad(CAST(id AS STRING), 6, '0') AS file_id", "'a.png' AS target")
    present = spark.range(n).selectExpr("CASE WHEN id = 0 THEN 'a.png' ELSE concat('a-', 2 * id, '.png') END AS name")
    for rank_block, hot_rows in ((65_536, 10_000), (100, 500)):
        monkeypatch.setattr(I, "RANK_BLOCK", rank_block)
        got = I.resolve_name_clash(files, ["name", "file_id"], present, hot_rows=hot_rows).collect()
        assert {int(r["file_id"]): r["final_name"] for r in got} == {i: f"a-{2 * i + 1}.png" for i in range(n)}


def test_names_lost_to_other_groups_in_small_blocks(spark, monkeypatch):
    """Files named like the numbered ones stand between them: losses from a rank on, told block by block."""
    monkeypatch.setattr(I, "CLOSED_BLOCK", 3)
    monkeypatch.setattr(I, "RANK_BLOCK", 5)
    rng = random.Random(8)
    files = [(f"f{rng.randint(0, 99):02d}", f"id{i:03d}", "a.png" if i % 2 else f"a-{rng.randint(1, 60)}.png") for i in range(120)]
    existing = [f"a-{k}.png" for k in range(5, 60, 7)]
    rows = spark.createDataFrame(files, "name string, file_id string, target string")
    present = spark.createDataFrame([(e,) for e in existing], "name string")
    for hot_rows in (10, 10_000):
        named = I.resolve_name_clash(rows, ["name", "file_id"], present, hot_rows=hot_rows).collect()
        assert {r["file_id"]: r["final_name"] for r in named} == one_by_one(files, existing)


def test_duplicates(spark):
    files = spark.createDataFrame(
        [("b.png", "2", "h1"), ("a.png", "1", "h1"), ("c.png", "3", "h1"), ("d.png", "4", "h2")], "name string, file_id string, hash string"
    )
    for hot_rows in (2, 1000):
        report = I.duplicate_report(files, ["name", "file_id"], hot_rows).orderBy("name").collect()
        assert [(r["name"], r["survivor"]) for r in report] == [("b.png", "a.png"), ("c.png", "a.png")]
    kept = I.dedupe_exact(files, ["name", "file_id"])
    assert sorted(r["name"] for r in kept.collect()) == ["a.png", "d.png"]
    again = I.dedupe_exact(kept, ["name", "file_id"])
    assert sorted(r["name"] for r in again.collect()) == ["a.png", "d.png"]


def test_import_plan(spark):
    files = spark.createDataFrame(
        [
            ("01_Cat.PNG", "1", "h1"), ("cat.png", "2", "h2"), ("copy.png", "3", "h1"), ("dog_2.gif", "4", "h3"),
            ("notes.txt", "5", "h4"), ("Bird.png", "6", "h5"), ("lost.png", "7", None), ("lost2.png", "8", None),
            ("bird.png", "9", "h6"),
        ],
        "name string, file_id string, hash string",
    )
    existing = spark.createDataFrame(
        [("bird.png", "h0"), ("bird-1.png", "h5"), ("dog.gif", "h9")], "name string, hash string"
    )
    plan = I.import_plan(files, existing)
    got = {r["file_id"]: (r["status"], r["target"], r["final_name"], r["renamed"]) for r in plan.collect()}
    assert got == {
        "1": ("imported", "cat.png", "cat.png", True),
        "2": ("imported", "cat.png", "cat-1.png", False),
        "3": ("duplicate", "copy.png", None, False),
        "4": ("imported", "dog.gif", "dog-1.gif", True),
        "6": ("duplicate_existing", "bird.png", None, True),
        "7": ("error", "lost.png", None, False),
        "8": ("error", "lost2.png", None, False),
        "9": ("imported", "bird.png", "bird-2.png", False),
    }
    summary = I.import_summary(plan).first().asDict()
    assert summary == {"imported": 4, "skipped": 2, "duplicates": 2, "renamed": 3, "errors": 2}
    assert sorted(r["file"] for r in I.import_errors(plan).collect()) == ["lost.png", "lost2.png"]


def test_conversions(spark):
    files = spark.createDataFrame(
        [("a.png", 100), ("a.webp", 40), ("b.GIF", 10), ("B.webp", 1), ("c.WEBP", 5), ("c.png", 0)], "filename string, size bigint"
    )
    assert sorted(r["filename"] for r in I.pending_conversions(files).collect()) == ["b.GIF", "c.png"]
    assert sorted(r["filename"] for r in I.orphaned_originals(files).collect()) == ["a.png", "c.png"]
    saved = {r["filename"]: r["saved_percent"] for r in I.conversion_savings(files).collect()}
    assert saved == {"a.png": 60.0, "c.png": None}
