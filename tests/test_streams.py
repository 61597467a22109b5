"""Streams against the same operators over tables, under shuffled arrival and with late rows."""

import pytest
from pyspark.sql import functions as F

from tarnwick.streaming import events

SCHEMA = "id int, user string, ts timestamp, kind int"


@pytest.fixture()
def rows(spark):
    base = "timestamp '2024-01-01 00:00:00'"
    return spark.range(400).selectExpr("cast(id as int) as id", "concat('u', id % 9) as user", f"{base} + make_interval(0, 0, 0, 0, 0, cast((id * 37) % 400 as int) * 20, 0) as ts", "cast(id * 7 % 5 as int) as kind")


def best(df, late=None):
    return events.best_rows(df, ["user"], [F.col("kind")], "1 day", late)


def key(r):
    return (str(r.start), r.user, r.id, r.kind)


def test_best_rows_of_a_stream_are_those_of_the_table(spark, rows, tmp_path):
    end = spark.createDataFrame([(9999, "end", None, 0)], SCHEMA).withColumn("ts", F.expr("timestamp '2024-02-01 00:00:00'"))
    rows.orderBy(F.xxhash64("id")).repartition(5).write.parquet(f"{tmp_path}/in")
    end.write.mode("append").parquet(f"{tmp_path}/last")
    stream = events.read_events(spark, f"{tmp_path}/in", SCHEMA, 1)
    events.write_stream(best(stream, "40 days"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    spark.read.parquet(f"{tmp_path}/last").withColumn("ts", F.expr("timestamp '2024-06-01 00:00:00'")).write.mode("append").parquet(f"{tmp_path}/in")
    events.write_stream(best(events.read_events(spark, f"{tmp_path}/in", SCHEMA, 1), "40 days"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = sorted(key(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(key(r) for r in best(rows).collect())
    assert got == want and len(want) > 40


def test_late_rows_go_aside_and_none_is_lost(spark, rows, tmp_path):
    parts = [rows.where("id % 4 = 0"), rows.where("id % 4 = 1 and ts > timestamp '2024-01-03'"), rows.where("id % 4 = 1 and ts <= timestamp '2024-01-03'"), rows.where("id % 4 > 1").withColumn("ts", F.when(F.col("id") != 2, F.col("ts")))]
    for n, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.split_late(events.read_events(spark, f"{tmp_path}/in", SCHEMA, 1), f"{tmp_path}/out", f"{tmp_path}/cp", "1 day").awaitTermination(120)
    kept, late = (spark.read.parquet(f"{tmp_path}/out/{k}").collect() for k in ("rows", "late"))
    newest, want = None, {}
    for p in parts:
        own = p.collect()
        for r in own:
            want[r.id] = r.ts is None or newest is not None and (newest - r.ts).total_seconds() > 86400
        newest = max([x for x in [newest, *[r.ts for r in own]] if x is not None])
    assert {r.id for r in kept} == {i for i, x in want.items() if not x} and {r.id for r in late} == {i for i, x in want.items() if x}
    assert len(kept) + len(late) == 400 and len(late) > 50
