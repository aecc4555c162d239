"""Partitioned Parquet stores: upsert of the touched partitions and retention by whole days.

A change is staged below the store in a hidden folder and then takes the place of the partitions it touches, one rename each. The staged folder is
a redo log: it counts from the moment its job marker stands, and whoever writes next finishes what a stopped writer left (`recover`). Work on the
driver is a listing of partitions, never of rows. One writer at a time; a reader that lists the store during a rename should retry.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeloom.sources.readers import SNAPSHOT_KEY, upsert

STAGED = "_staged"


def _files(spark: SparkSession, *parts: str):
    """The file system of a path and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, *parts: str) -> list[str]:
    fs, at = _files(spark, *parts)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders (``column=value``)."""
    return [n for n in _folders(spark, path) if "=" in n]


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows in the given columns; no rows where nothing is stored yet."""
    return spark.read.schema(schema).parquet(path) if partitions(spark, path) else spark.createDataFrame([], schema)


def stage(rows: DataFrame, path: str, partition: str) -> str:
    """Write what the touched partitions shall hold; it counts once the marker of the finished job is there."""
    name = uuid.uuid4().hex
    rows.repartition(F.col(partition)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy(partition).parquet(f"{path}/{STAGED}/{name}")
    return name


def recover(spark: SparkSession, path: str) -> int:
    """Finish staged changes whose job had ended and drop those whose had not; the number finished. Can be stopped and repeated at any point.

    A partition moves only after the folder it replaces is gone, and stays staged until then: at every moment its new rows are in one of the two places.
    """
    done = 0
    for name in _folders(spark, path, STAGED):
        fs, change = _files(spark, path, STAGED, name)
        if fs.exists(_files(spark, path, STAGED, name, "_SUCCESS")[1]):
            for part in partitions(spark, f"{path}/{STAGED}/{name}"):
                target = _files(spark, path, part)[1]
                fs.delete(target, True)
                if not fs.rename(_files(spark, path, STAGED, name, part)[1], target):
                    raise OSError(f"cannot move {part} into {path}")
            done += 1
        fs.delete(change, True)
    return done


def upsert_stored(path: str, incoming: DataFrame, partition: str = "chain_date", keys: Sequence[str] = SNAPSHOT_KEY, order: Sequence[str] = ("ingest",)) -> int:
    """Upsert a load into a store partitioned by ``partition``, which is one of the keys; the number of partitions written.

    Only partitions with incoming rows are read (the filter prunes the others) and written; files of the others are not touched.
    An empty load changes nothing. Null partition values are a partition like any other.
    """
    if partition not in keys:
        raise ValueError("the partition column must be a key, or an upsert could leave the old row in another partition")
    spark = incoming.sparkSession
    recover(spark, path)
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    if not touched:
        return 0
    values = [v for v in touched if v is not None]
    here = F.col(partition).isin(values) if values else F.lit(False)
    here = here | F.col(partition).isNull() if None in touched else here
    stage(upsert(read_stored(spark, path, incoming.schema).filter(here), incoming, keys, order).select(*incoming.columns), path, partition)
    recover(spark, path)
    return len(touched)


def retain_stored(spark: SparkSession, path: str, schema: StructType, ts: str, as_of: datetime.datetime, days: int = 30, partition: str = "day") -> tuple[int, int]:
    """Keep rows whose ``ts`` is within ``days`` before ``as_of``, in a store partitioned by the date of ``ts``: (days dropped, days rewritten).

    Whole days before the limit are dropped without being read; the day of the limit is rewritten if it holds rows on both sides of it.
    """
    recover(spark, path)
    limit = as_of - datetime.timedelta(days=days)
    date = spark.range(1).select(F.to_date(F.lit(limit))).first()[0]  # in the session's time zone, as the partitions are
    edge = f"{partition}={date.isoformat()}"
    names = [n for n in partitions(spark, path) if not n.endswith("=__HIVE_DEFAULT_PARTITION__")]
    old = [n for n in names if n < edge]
    for n in old:
        fs, at = _files(spark, path, n)
        fs.delete(at, True)
    if edge not in names:
        return len(old), 0
    day = read_stored(spark, path, schema).filter(F.col(partition) == F.lit(date))
    kept = F.col(ts) > F.lit(limit)
    n, stay = day.agg(F.count(F.lit(1)), F.count_if(kept)).first()
    if stay == n:
        return len(old), 0
    if stay == 0:
        fs, at = _files(spark, path, edge)
        fs.delete(at, True)
        return len(old) + 1, 0
    stage(day.filter(kept), path, partition)
    recover(spark, path)
    return len(old), 1
