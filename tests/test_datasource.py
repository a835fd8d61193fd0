"""The archive format as a data source."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from webstrata.sources import datasource, wrr


def _value(k):
    head = [["Host", b"a.example"], ["X", b"\xff"]]
    return ["WEBREQRES/1", "t", "HTTP/1.1", [1000 + k, "GET", f"http://a.example/{k}", head, True, b""], None if k % 5 == 0 else [2000 + k, 200, "OK", head, True, b"body" * k], 3000 + k, {"n": str(k)}]


@pytest.fixture
def archive(tmp_path):
    for k in range(12):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        data = wrr.encode(_value(k))
        (tmp_path / f"d{k % 3}" / f"{k}.wrr").write_bytes(gzip.compress(data) if k % 2 else data)
    (tmp_path / "all.wrrb").write_bytes(b"".join(wrr.encode(_value(k)) for k in range(100, 140)))
    (tmp_path / "d0" / "busy.wrr.part").write_bytes(b"x")
    return tmp_path


def test_rows_are_those_of_the_reader(spark, archive):
    datasource.register(spark)
    rows = spark.read.format("wrr").option("partitionBytes", "300").load(str(archive))
    assert rows.rdd.getNumPartitions() > 3
    plain = lambda df: sorted(((r.element_num, r.request.url, r.response and bytes(r.response.body), r.finished_at_ms, str(r.extra), os.path.basename(r.source_path)) for r in df.collect()), key=repr)
    assert plain(rows) == plain(wrr.read(spark, str(archive)).drop("is_boring")) and rows.count() == 52


def test_conditions_choose_files(spark, archive):
    datasource.register(spark)
    (archive / "bad.wrr").write_bytes(b"\x00")
    rows = spark.read.format("wrr").load(str(archive))
    with pytest.raises(Exception, match="cannot load"):
        rows.collect()
    # the bad file is not opened
    assert rows.where(F.col("source_path").startswith(f"{archive}/d1")).count() == 4
    assert rows.where((F.col("source_path") == f"{archive}/all.wrrb") & (F.col("element_num") < 7)).count() == 7
    assert spark.read.format("wrr").option("errors", "skip").load(str(archive)).where("error is not null").count() == 1
    assert spark.read.format("wrr").option("errors", "ignore").option("pathGlobFilter", "*.wrr").load(str(archive)).count() == 12
    with pytest.raises(Exception, match="one of"):
        spark.read.format("wrr").option("errors", "never").load(str(archive)).count()


def test_empty_folders(spark, tmp_path):
    datasource.register(spark)
    assert spark.read.format("wrr").load(str(tmp_path)).count() == 0


def test_streams_take_each_file_once(spark, archive, tmp_path):
    datasource.register(spark)

    def run():
        stream = spark.readStream.format("wrr").load(str(archive)).select("request.url", "source_path")
        stream.writeStream.option("checkpointLocation", str(archive / ".state")).trigger(availableNow=True).format("parquet").start(str(archive / ".out")).awaitTermination()
        return spark.read.parquet(str(archive / ".out")).count()

    assert run() == 52
    (archive / "late.wrr").write_bytes(wrr.encode(_value(77)))
    assert run() == 53 and run() == 53
