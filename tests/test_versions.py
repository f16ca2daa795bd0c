"""Versioned puts: whole or invisible, later ones win."""

import os

import pytest
from pyspark.sql import functions as F

from nutriyield.sources import io as IO


def test_put_and_read_latest(spark, tmp_path):
    root = str(tmp_path / "store")
    assert IO.published(spark, root).count() == 0 and IO.read_published(spark, root, "trips").columns == []
    one = spark.range(5).withColumn("v", F.lit(1))
    IO.put_version(one, root, "trips", "a")
    IO.put_version(one.withColumn("v", F.lit(2)), root, "trips", "b")
    IO.put_version(one.withColumn("v", F.lit(9)), root, "trips_other", "a")
    read = lambda **o: {r["v"] for r in IO.read_published(spark, root, "trips", extension="parquet", exact_match=True, **o).collect()}
    assert read() == {2} and read(version="a") == {1}
    IO.put_version(one.withColumn("v", F.lit(3)), root, "trips", "a")  # a name put again is the latest
    assert read() == {3} and read(version="a") == {3} and read(version="b") == {2}
    names = {r["name"] for r in IO.published(spark, root).collect()}
    assert names == {"trips__a__parquet", "trips__b__parquet", "trips_other__a__parquet"}


def test_failed_and_half_written_puts_stay_invisible(spark, tmp_path):
    root = str(tmp_path / "store")
    IO.put_version(spark.range(3), root, "t", "v1")
    before = sorted(os.listdir(f"{root}/_data"))
    bad = spark.range(3).withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        IO.put_version(bad, root, "t", "v2")
    assert sorted(os.listdir(f"{root}/_data")) == before
    # a writer that claimed a number and got no further, and one cut off in its entry
    open(f"{root}/_manifest/000000000002.json", "w").close()
    with open(f"{root}/_manifest/000000000003.json", "w") as f:
        f.write('{"number": 3, "name": "t__v3__parquet", "fol')
    assert IO.read_published(spark, root, "t").count() == 3
    IO.put_version(spark.range(7), root, "t", "v4")  # takes the next free number
    assert os.path.exists(f"{root}/_manifest/000000000004.json")
    assert IO.read_published(spark, root, "t").count() == 7 and IO.published(spark, root).count() == 2
