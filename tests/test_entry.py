"""Every query that SQL can express against DuckDB, on the smallest tables; the others for rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe import queries as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in out.collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    got = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in got.description]
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    assert sorted(names) == sorted(out.columns)
    key = lambda r: tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in sorted(names))
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_streamed_sums_equal_batch_sums(spark, tmp_path):
    from pyspark.sql import functions as F

    from helixframe.streaming import running_sums

    cells = spark.range(200).select((F.col("id") % 5).alias("snp"), F.lit("y").alias("trait"), (F.col("id") % 3).cast("double").alias("g"), (F.col("id") / 7).alias("y"))
    cells.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
    q = running_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = running_sums(cells)
    rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(spark.table("sums")) == rounded(batch)
