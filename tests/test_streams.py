import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stepforge.sources.versions import Memory, VersionedTable, VersionTaken
from stepforge.streaming import triggers, windows

STEPS = "trajectory string, step long, observation string, url string"


def run(stream, out, checkpoint, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_triggers_fire_once_across_restarts(spark, tmp_path):
    page = "[1] Shop page with a cart and a list of orders"
    targets = spark.createDataFrame([("a", page, ""), ("b", page, "http://u"), ("c", "never seen anywhere", "")], "trajectory string, target_observation string, target_url string")
    batches = [
        [("a", 0, "login", "x"), ("b", 0, "login", "x"), ("z", 1, page, "x"), (None, 1, page, "x")],
        [("a", 3, page.replace("[1]", "[77]"), "x"), ("a", 2, page, "x"), ("b", 1, "other", "http://u"), ("c", 2, page, "x")],
        [("a", 1, page, "x"), ("a", 9, page, "x"), ("b", 2, page, "x"), ("d", 1, page, "x")],
    ]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, STEPS).coalesce(1).write.mode("append").parquet(source)
        # Each time a new query from the checkpoint, as after a restart.
        run(triggers.once_triggers(spark.readStream.schema(STEPS).parquet(source), targets), out, checkpoint)
        seen.append(sorted(map(tuple, spark.read.schema(triggers.FIRED).parquet(out).collect())))
    assert seen == [[], [("a", 2), ("b", 1)], [("a", 2), ("b", 1)]]
    table = spark.read.parquet(source)
    assert sorted(map(tuple, triggers.first_triggers(table, targets).collect())) == [("a", 1), ("b", 1)]


def test_schedules(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, True), (10, None), (None, True)], "step int, asked boolean")
    found = {n: [r[0] for r in df.select(triggers.scheduled(n, F.col("step"), F.col("asked"), 10, 2)).collect()] for n in triggers.SCHEDULES}
    assert found == {
        "none": [False] * 5,
        "at_start": [True, False, False, False, False],
        "every": [True, False, False, True, False],
        "asked": [True, False, True, False, False],
        "asked_until": [True, False, False, False, False],
        "once_at": [False, False, True, False, False],
    }
    with pytest.raises(ValueError):
        triggers.scheduled("odd", F.col("step"))


def at(minute):
    return dt.datetime(2024, 5, 1, 8) + dt.timedelta(minutes=minute)


EVENTS = "ts timestamp, user_id long, event_type string, value double"


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_windows_of_a_stream_equal_those_of_a_table_without_late_rows(spark, tmp_path, kind):
    make = {"tumbling": lambda d: windows.tumbling(d, "10 minutes", "5 minutes"), "sliding": lambda d: windows.sliding(d, "10 minutes", "5 minutes", "5 minutes"), "sessions": lambda d: windows.sessions(d, "4 minutes", "5 minutes")}[kind]
    on_time = [[(at(1), 1, "a", 1.0), (at(3), 1, "a", 2.0), (at(2), 2, None, 4.0)], [(at(12), 1, "a", 8.0), (at(9), 2, "b", 16.0)], [(at(40), 1, "a", 32.0), (None, 1, "a", 9.0)], [(at(90), 3, "a", 64.0)], [(at(90), None, "a", 128.0)]]
    late = {2: [(at(2), 1, "a", 500.0)], 4: [(at(41), 1, "a", 700.0)]}  # behind the watermark when they come
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, batch in enumerate(on_time):
        spark.createDataFrame([*batch, *late.get(i, [])] if i != 2 else batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        run(make(spark.readStream.schema(EVENTS).parquet(source)), out, checkpoint)
        if i == 2:
            spark.createDataFrame(late[2], EVENTS).coalesce(1).write.mode("append").parquet(source)
            run(make(spark.readStream.schema(EVENTS).parquet(source)), out, checkpoint)
    table = make(spark.createDataFrame(sum(on_time, []), EVENTS))
    closed = sorted(map(str, table.filter(F.col("end") <= F.lit(at(85))).collect()))
    assert sorted(map(str, spark.read.schema(table.schema).parquet(out).collect())) == closed and len(closed) >= 4
    everything = make(spark.createDataFrame(sum(on_time, []) + late[2] + late[4], EVENTS))
    assert everything.agg(F.sum("total")).first()[0] > table.agg(F.sum("total")).first()[0]


def test_a_reader_sees_all_or_none_of_a_push(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "memory"))
    with pytest.raises(LookupError):
        table.version()
    schema = spark.createDataFrame([], "k int, v string").schema
    table.create(schema)
    with pytest.raises(VersionTaken):
        table.create(schema)
    memory = Memory(table)
    assert memory.rows().count() == 0
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], schema)
    opened = memory.rows()
    assert memory.push(batch, ["k", "v"]) == 1
    assert opened.count() == 0 and memory.rows().count() == 0  # still pinned
    assert memory.refresh() and memory.rows().count() == 2 and not memory.refresh()
    pinned = memory.rows()
    assert memory.push(spark.createDataFrame([(2, None), (3, "c")], schema), ["k", "v"]) == 2
    assert pinned.count() == 2 and table.read().count() == 3 and table.read(table.version(1)).count() == 2
    # A push that dies before it publishes leaves rows that no version names.
    batch.write.parquet(str(tmp_path / "memory" / "rows" / "half-done"))
    assert table.read().count() == 3 and table.numbers() == [0, 1, 2]
    with pytest.raises(ValueError):
        table.append(batch.drop("v"))
    with pytest.raises(LookupError):
        table.version(9)


def test_of_two_writers_one_publishes(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "memory"))
    rows = spark.createDataFrame([(1,)], "k int")
    first = table.create(rows.schema)
    table.append(rows, first)
    with pytest.raises(VersionTaken):
        table.append(rows, first)
    # One that meets a faster writer compares again and publishes the rest.
    memory, calls = Memory(table), []
    latest = table.version

    def behind(number=None):
        calls.append(number)
        return first if len(calls) == 1 else latest(number)

    monkeypatch.setattr(table, "version", behind)
    assert memory.push(spark.createDataFrame([(1,), (5,)], "k int"), ["k"]) == 2
    assert sorted(r.k for r in table.read(latest()).collect()) == [1, 5]


def test_window_queries_equal_sql(spark, sf_dir):
    found = __spark_entry__.queries()
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert found["session_windows"](spark, sf_dir).agg(F.sum("n")).first()[0] == total
    assert found["sliding_windows"](spark, sf_dir).agg(F.sum("n")).first()[0] == 2 * total
