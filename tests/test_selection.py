import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark.operators import selection as O
from shelfmark.streaming import selection as R
from shelfmark.streaming import terms as D

SCHEMA = "user_id bigint, ts timestamp_ntz, seq bigint, op string, item_id string, items array<string>"


def events(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        op = rng.choice([O.TOGGLE] * 6 + [O.SELECT_ALL, O.RESET, "SET_GRID_SCALE"])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, n // 3))
        items = [f"i{rng.randint(0, 7)}" for _ in range(4)] if op == O.SELECT_ALL else None
        rows.append((0 if seq % 3 == 0 else rng.randint(1, 5), ts, seq, op, f"i{rng.randint(0, 7)}", items))
    return rows


def fold(rows, start=None):
    state = {u: list(s) for u, s in (start or {}).items()}
    for user, _, _, op, item, items in sorted(rows, key=lambda r: (r[1], r[2])):
        chosen = state.setdefault(user, [])
        if op == O.TOGGLE:
            state[user] = [i for i in chosen if i != item] if item in chosen else chosen + [item]
        elif op == O.SELECT_ALL:
            state[user] = list(items)
        elif op == O.RESET:
            state[user] = []
    return {u: s for u, s in state.items() if s}


def collected(df):
    out = {}
    for r in df.orderBy("user_id", "place").collect():
        out.setdefault(r["user_id"], []).append(r["item_id"])
    return out


def test_fold_is_the_event_by_event_result(spark):
    for seed, n in ((1, 40), (2, 200), (3, 400)):
        rows = events(n, seed)
        df = spark.createDataFrame(rows, SCHEMA)
        for hot_rows in (5, 10_000) if seed == 3 else (10_000,):
            assert collected(O.fold_selection(df, hot_rows=hot_rows)) == fold(rows)


def test_start_and_payload_rows(spark):
    rows = events(30, 7)
    start = {0: ["i1", "i9"], 99: ["i3"]}
    before = spark.createDataFrame([(u, p, i) for u, s in start.items() for p, i in enumerate(s)], "user_id bigint, place bigint, item_id string")
    assert collected(O.fold_selection(spark.createDataFrame(rows, SCHEMA), start=before)) == fold(rows, start)
    bare = [(u, t, s, op, i, None) for u, t, s, op, i, _ in rows]
    payload = [(r[0], r[2], p, i) for r in rows if r[3] == O.SELECT_ALL for p, i in enumerate(r[5])]
    lists = spark.createDataFrame(payload, "user_id bigint, seq bigint, place bigint, item_id string")
    assert collected(O.fold_selection(spark.createDataFrame(bare, SCHEMA), payloads=lists)) == fold(rows)


def test_toggling_twice_changes_nothing(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 0, O.TOGGLE, "a", None), (1, t, 1, O.TOGGLE, "b", None), (1, t, 2, O.TOGGLE, "b", None)]
    assert collected(O.fold_selection(spark.createDataFrame(rows, SCHEMA))) == {1: ["a"]}


def streamed(spark, folder, parts, **options):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        # Each run goes on from the state that the one before has left.
        R.selection_stream(source, f"{folder}/state", f"{folder}/check", full_every=3, **options).awaitTermination()
    return collected(R.read_selection(spark, f"{folder}/state"))


def test_stream_in_any_order_equals_the_batch(spark, tmp_path):
    rows = events(240, 11)
    random.Random(3).shuffle(rows)
    assert streamed(spark, str(tmp_path), [rows[i * 60 : (i + 1) * 60] for i in range(4)], lateness="1000 days") == fold(rows)


def test_stream_settles_behind_the_watermark(spark, tmp_path):
    rows = sorted(events(200, 12), key=lambda r: (r[1], r[2]))
    cut = next(i for i in range(100, 200) if rows[i][1] > rows[i - 1][1])
    late = [(0, dt.datetime(2023, 1, 1), 10_000, O.RESET, None, None)]
    # With no lateness each run folds all events of the runs before into the state, and drops what is older.
    assert streamed(spark, str(tmp_path), [rows[:cut], rows[cut:], late], lateness="0 seconds") == fold(rows)


def test_stream_touches_only_the_keys_of_its_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    first = [(u, t, u, O.TOGGLE, "a", None) for u in range(5)]
    streamed(spark, str(tmp_path), [first, [(3, t, 9, O.TOGGLE, "b", None)], [(3, t, 10, O.RESET, None, None)]])
    per_batch = {r["batch_id"]: r["users"] for r in spark.read.parquet(f"{tmp_path}/state").where("NOT is_full").groupBy("batch_id").agg(F.collect_set("user_id").alias("users")).collect()}
    assert sorted(map(sorted, per_batch.values()))[-1] == [3] and sorted(map(len, per_batch.values()))[-1] == 5
    assert collected(R.read_selection(spark, f"{tmp_path}/state")) == {u: ["a"] for u in range(5) if u != 3}


def test_snapshot(spark):
    rows = [("u", 1, 1, '["a"]'), ("u", 2, 2, '["b","c"]'), ("v", 1, 1, "[oops")]
    got = O.selection_snapshot(spark.createDataFrame(rows, "key string, ts int, seq int, payload string"))
    assert {r["key"]: r["items"] for r in got.collect()} == {"u": ["b", "c"], "v": []}


def test_debounce(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 2]), start + dt.timedelta(milliseconds=rng.randint(0, 9_000_000)), i, f"t{i}") for i in range(400)]
    rows += [(3, start + dt.timedelta(milliseconds=x), 1000 + x, "edge") for x in (0, 300, 599, 3_599_900, 3_600_100)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, seq bigint, term string")
    for gap in (300, 60_000):
        expected = {}
        for user in (1, 2, 3):
            own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == user)
            for (ts, seq, term), after in zip(own, own[1:] + [None]):
                expected[seq] = term if after is None or after[0] - ts >= dt.timedelta(milliseconds=gap) else None
        assert {r["seq"]: r["searched"] for r in O.debounce_terms(df, gap).collect()} == expected
        settled = D.settled_terms(df, gap)
        assert sorted(r["term"] for r in settled.collect()) == sorted(t for t in expected.values() if t)


def test_recent_items_and_size(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=i), i, O.TOGGLE, item, None) for i, item in enumerate("abcab")]
    recent = O.recent_items(spark.createDataFrame(rows, SCHEMA), 2).orderBy("place").collect()
    assert [r["item_id"] for r in recent] == ["b", "a"]
    selection = spark.createDataFrame([(1, 1, "1"), (1, 2, "2")], "user_id bigint, place bigint, item_id string")
    catalog = spark.createDataFrame([("1", 1024), ("2", 2048), ("3", 3072)], "id string, size bigint")
    assert O.selection_size(selection, catalog).first()[1:] == (2, 3.0)
