"""Scratch tables in the folder that the cluster shares, and small helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest key set, in rows, that is offered for broadcast; beyond it joins stay shuffled.
BROADCAST_ROWS = 100_000
_own: dict[str, str] = {}
_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="helixframe-")
        _own[app] = found
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, survives lost executors, and
    gives the planner a measured size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    _written.append(path)
    return out


def remember(path: str) -> None:
    """Files written by other means, for :func:`discard_all`."""
    _written.append(path)


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a table made by :func:`stored`; others are left alone."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Deletes every table that this process has stored: once all results that were made from them are written."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of at most 2,000 rows from here on, unless the session sets its own size: rows hold whole texts, and
    a batch stands in memory on both sides of each Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "2000")
    return df


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast only if its counted rows are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in the whole table: sizes ranges and shards."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def range_number(ids: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below ``ids``, by binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    depth = len(bounds).bit_length()
    padded = bounds + [2**63 - 1] * (2**depth - 1 - len(bounds))
    table = F.lit(padded)
    steps = F.array(*[F.lit(2**k) for k in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) < ids, at + s).otherwise(at))


def id_bounds(docs: DataFrame, id_col: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` ascending ids that cut the table into ranges of about equal row counts."""
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * ranges)).alias("b")).first()["b"]
    return sorted(set(found or []))
