import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import readers, stored

KEYS = ("symbol", "day")
SCHEMA = "symbol string, day date, v bigint, ingest bigint"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and stored.STAGED not in d}


def rows(spark, path):
    return sorted(map(tuple, stored.read_stored(spark, path, frame(spark, []).schema).select("symbol", "day", "v", "ingest").collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


D = [dt.date(2024, 1, i) for i in range(1, 6)]
FIRST = [("A", D[0], 1, 1), ("B", D[0], 2, 1), ("A", D[1], 3, 1), ("A", D[2], 4, 1), ("A", None, 5, 1)]


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert stored.upsert_stored(path, frame(spark, FIRST), "day", KEYS) == 4
    before = files(path)
    load = frame(spark, [("A", D[1], 30, 2), ("A", D[1], 31, 3), ("C", D[3], 9, 2), ("A", None, 50, 2)])
    want = sorted(map(tuple, readers.upsert(frame(spark, FIRST), load, KEYS).select("symbol", "day", "v", "ingest").collect()), key=repr)
    assert stored.upsert_stored(path, load, "day", KEYS) == 3
    after = files(path)
    same = {p for p in before if f"day={D[0]}" in p or f"day={D[2]}" in p}
    assert same and all(after[p] == before[p] for p in same)
    assert not any(p in after for p in set(before) - same)
    assert ("A", D[1], 31, 3) in want
    assert stored.upsert_stored(path, frame(spark, []), "day", KEYS) == 0
    assert sorted(rows(spark, path), key=repr) == want
    with pytest.raises(ValueError):
        stored.upsert_stored(path, load, "v", KEYS)


def test_a_stopped_writer_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    stored.upsert_stored(path, frame(spark, FIRST), "day", KEYS)
    was = rows(spark, path)
    load = frame(spark, [("A", D[0], 10, 2), ("A", D[1], 30, 2)])
    change = frame(spark, [("A", D[0], 10, 2), ("B", D[0], 2, 1), ("A", D[1], 30, 2)])
    stored.stage(change, path, "day")
    assert rows(spark, path) == was  # staged, not committed: readers see the old rows
    os.remove(os.path.join(path, stored.STAGED, os.listdir(os.path.join(path, stored.STAGED))[0], "_SUCCESS"))
    assert stored.recover(spark, path) == 0 and rows(spark, path) == was  # an unfinished job is dropped
    stored.stage(change, path, "day")
    inner, calls = stored._files, []

    def stops(s, *parts):
        calls.append(parts)
        if parts == (path, f"day={D[1]}"):
            raise KeyboardInterrupt
        return inner(s, *parts)

    monkeypatch.setattr(stored, "_files", stops)
    with pytest.raises(KeyboardInterrupt):
        stored.recover(spark, path)  # stopped between two partitions
    monkeypatch.setattr(stored, "_files", inner)
    assert stored.recover(spark, path) == 1 and stored.recover(spark, path) == 0
    want = sorted(map(tuple, readers.upsert(frame(spark, FIRST), load, KEYS).select("symbol", "day", "v", "ingest").collect()), key=repr)
    assert rows(spark, path) == want


def test_retention_drops_days_and_rewrites_the_edge(spark, tmp_path):
    path = str(tmp_path / "r")
    d = spark.range(240).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts")).withColumn("day", F.to_date("ts"))
    d.write.partitionBy("day").parquet(path)
    as_of = d.agg(F.max("ts")).first()[0]
    whole = files(path)
    assert stored.retain_stored(spark, path, d.schema, "ts", as_of - dt.timedelta(hours=12), 3) == (6, 1)
    left = files(path)
    later = {p for p in whole if p.split("day=")[1][:10] > "2024-01-07"}
    assert len(later) >= 3 and set(left) & set(whole) == later and all(left[p] == whole[p] for p in later)
    want = [r.id for r in d.filter(F.col("ts") > F.lit(as_of - dt.timedelta(hours=12, days=3))).orderBy("id").collect()]
    assert [r.id for r in stored.read_stored(spark, path, d.schema).orderBy("id").collect()] == want
    assert stored.retain_stored(spark, path, d.schema, "ts", as_of - dt.timedelta(hours=12), 3) == (0, 0)


def test_operators_as_table_functions(spark):
    from tapeloom.streaming.streams import register_tables

    rows = frame(spark, FIRST)
    register_tables(spark, rows, {"held": (lambda d: d.groupBy("symbol").agg(F.sum("v").alias("total")), "least bigint", "total >= least"), "whole": (lambda d: d, "", "true")})
    assert [tuple(r) for r in spark.sql("SELECT * FROM held(3)").collect()] == [("A", 13)]
    assert spark.sql("SELECT w.v FROM whole() w JOIN held(0) h ON w.symbol = h.symbol").count() == 5
    with pytest.raises(ValueError):
        register_tables(spark, rows, {"bad": (lambda d: d, "V bigint", "v > V")})
