"""The merge table, and streams that keep state by key, held against runs over everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql.types import StructType

from tessera.operators.lifecycle import apply_lifecycle
from tessera.sinks import ConflictError, MergeTable, stream_into
from tessera.streaming.pipelines import claim_state, due_periods, resolve_stream, run_to_table

from .test_lifecycle import claim, frame

ROWS = StructType().add("source_id", "string").add("k", "integer").add("at", "integer").add("v", "string")


def table(spark, tmp_path, **more):
    return MergeTable(spark, str(tmp_path / "t"), ["source_id"], ROWS, **({"buckets": 8} | more))


def rows(spark, *items):
    return spark.createDataFrame(list(items), ROWS)


def content(t):
    return sorted(map(tuple, t.read().collect()), key=repr)


def test_last_write_wins_by_key(spark, tmp_path):
    t, kept, rng = table(spark, tmp_path), {}, random.Random(7)
    assert content(t) == [] and t.version == 0
    for n in range(4):
        batch = [(rng.choice(["a", "b", "c", None]), rng.randrange(3), i, f"{n}-{i}") for i in range(12)]
        for r in sorted(batch, key=lambda r: r[2]):
            kept[r[:2]] = r
        t.upsert(rows(spark, *batch, batch[0]), ["source_id", "k"], "at")
        assert content(t) == sorted(kept.values(), key=repr) and t.version == n + 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=64)
    t.upsert(rows(spark, *[(f"s{i}", 0, 0, "x") for i in range(40)]), ["source_id", "k"], "at")
    before = t._manifest()["files"]
    t.upsert(rows(spark, ("s3", 0, 0, "y")), ["source_id", "k"], "at")
    after = t._manifest()["files"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    assert t.read().where("v = 'y'").count() == 1 and t.read().count() == 40


def test_replace_and_delete(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("a", 1, 0, "x"), ("a", 2, 0, "x"), ("b", 1, 0, "x"), (None, 1, 0, "x")), ["source_id", "k"], "at")
    t.replace(rows(spark, ("a", 3, 0, "n"), (None, 5, 0, "n")))
    assert content(t) == sorted([("a", 3, 0, "n"), ("b", 1, 0, "x"), (None, 5, 0, "n")], key=repr)
    t.delete(rows(spark, ("b", 0, 0, ""), ("none", 0, 0, "")).select("source_id"))
    assert content(t) == sorted([("a", 3, 0, "n"), (None, 5, 0, "n")], key=repr)
    t.replace(rows(spark))
    assert len(content(t)) == 2


def test_repeated_numbers_count_once_and_conflicts_change_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.upsert(rows(spark, ("a", 1, 0, "x")), ["source_id", "k"], "at", "w", 0)
    assert not t.upsert(rows(spark, ("a", 1, 0, "y")), ["source_id", "k"], "at", "w", 0)
    assert t.upsert(rows(spark, ("a", 1, 0, "z")), ["source_id", "k"], "at", "other", 0)

    def slow(old, new):
        table(spark, tmp_path).upsert(rows(spark, ("b", 1, 0, "in between")), ["source_id", "k"], "at")
        return old.unionByName(new)

    with pytest.raises(ConflictError):
        t.change(rows(spark, ("c", 1, 0, "lost")), slow)
    assert content(t) == [("a", 1, 0, "z"), ("b", 1, 0, "in between")]


def test_wrong_changes_are_refused(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError):
        t.upsert(rows(spark, ("a", 1, 0, "x")), ["k"], "at")
    with pytest.raises(ValueError):
        t.change(rows(spark, ("a", 1, 0, "x")), lambda old, new: new.unionByName(rows(spark, *[(f"o{i}", 1, 0, "x") for i in range(20)])))
    t.upsert(rows(spark, ("a", 1, 0, "x")), ["source_id", "k"], "at")
    with pytest.raises(ValueError):
        table(spark, tmp_path, buckets=9)


def test_vacuum(spark, tmp_path):
    t = table(spark, tmp_path)
    for i in range(4):
        t.upsert(rows(spark, ("a", 1, i, str(i)), *([("b", 1, i, "b")] if i == 0 else [])), ["source_id", "k"], "at")
    before = content(t)
    assert t.vacuum(keep=1) >= 2 and content(t) == before and t.version == 4
    t.upsert(rows(spark, ("c", 1, 0, "c")), ["source_id", "k"], "at")
    assert t.version == 5 and len(content(t)) == 3


def test_stream_into_table(spark, tmp_path):
    src, t = str(tmp_path / "in"), table(spark, tmp_path)
    for part in ([("a", 1, 0, "x"), ("b", 1, 0, "x")], [("a", 1, 1, "y")], [("b", 1, 0, "x")]):
        rows(spark, *part).coalesce(1).write.mode("append").parquet(src)
        stream_into(spark.readStream.schema(ROWS).parquet(src), t, ["source_id", "k"], "at", str(tmp_path / "ck")).awaitTermination()
    assert content(t) == [("a", 1, 1, "y"), ("b", 1, 0, "x")] and t.version == 3


def test_claims_of_shuffled_and_repeated_batches_equal_one_run(spark, tmp_path):
    items = [claim(i, (i * 5) % 9, ("user", "assistant_inferred")[i % 2], subject=f"s{i % 5}", status="retracted" if i % 7 == 3 else "active") for i in range(30)]
    order = items + items[::3]
    random.Random(3).shuffle(order)
    schema = frame(spark, items).schema
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    for n in range(0, len(order), 14):
        frame(spark, order[n : n + 14]).coalesce(1).write.mode("append").parquet(src)
        resolve_stream(spark.readStream.schema(schema).parquet(src), state, str(tmp_path / "ck"), buckets=4).awaitTermination()
    got = claim_state(spark, state, schema, 4).read()
    whole = apply_lifecycle(frame(spark, items))
    assert sorted(got.where("status IN ('active', 'superseded')").select(*whole.columns).collect()) == sorted(whole.collect())
    assert {r.claim_id for r in got.where("status = 'retracted'").collect()} == {r["claim_id"] for r in items if r["status"] == "retracted"}


def test_periods_fall_due_once_when_they_end(spark, tmp_path):
    schema = "user_id string, ts timestamp"
    start = datetime(2023, 12, 29, 10)
    days = [start + timedelta(hours=7 * i) for i in range(60)]
    src = str(tmp_path / "in")
    touches = [("u" if i % 2 else None, d) for i, d in enumerate(days)] + [("u", None)]
    for n in range(0, len(touches), 10):  # in order of time, but each batch shuffled and repeated
        part = touches[n : n + 10] * 2
        random.Random(n).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = [(r.user_id, r.level, r.key) for r in run_to_table(due_periods(stream, "12 hours"), "due", "append").collect()]
    mark, want = max(days) - timedelta(hours=12), set()
    for user, d in touches:
        if d is None:
            continue
        monday = datetime(d.year, d.month, d.day) - timedelta(days=d.weekday())
        iso = d.isocalendar()
        ends = {("day", f"{d:%Y-%m-%d}"): datetime(d.year, d.month, d.day) + timedelta(days=1), ("week", f"{iso[0]}-W{iso[1]:02d}"): monday + timedelta(days=7),
                ("month", f"{d:%Y-%m}"): datetime(d.year + d.month // 12, d.month % 12 + 1, 1), ("year", str(d.year)): datetime(d.year + 1, 1, 1)}
        want |= {(user, *k) for k, end in ends.items() if end < mark}
    assert len(got) == len(set(got)) and set(got) == want and ("u", "year", "2023") in want


def test_waiting_periods_need_no_python(spark, tmp_path):
    """A group in Python for each waiting period takes milliseconds a row."""
    stream = spark.readStream.schema("user_id string, ts timestamp").parquet(str(tmp_path))
    plan = due_periods(stream)._jdf.queryExecution().logical().toString()
    assert "SessionWindow" in plan.replace("session_window", "SessionWindow") and "Pandas" not in plan and "Python" not in plan
