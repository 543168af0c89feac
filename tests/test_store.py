"""Stores: published steps alone count, and are found again."""

import pytest
from pyspark.sql import functions as F

from riskspark import session
from riskspark.store import Store, bucket_count


def rows(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key long")


def test_unpublished_steps_do_not_count(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    store = Store(spark, at)
    assert store.steps == 0 and store.read("t", "key long").count() == 0
    store.buckets = 4
    store.begin()
    store.write(rows(spark, 1, 2, 3), "t", store.bucket(F.col("key")))
    assert store.read("t", "key long").count() == 0 and store.read("t", "key long", pending=True).count() == 3
    store.publish()
    broken = Store(spark, at)
    broken.begin()
    broken.write(rows(spark, 9), "t", broken.bucket(F.col("key")))  # and dies here
    store = Store(spark, at)
    assert store.steps == 1 and store.buckets == 4
    store.begin()
    store.write(rows(spark, 4), "t", store.bucket(F.col("key")))
    store.publish()
    assert sorted(r.key for r in Store(spark, at).read("t", "key long").collect()) == [1, 2, 3, 4]


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.buckets = 64
    store.begin()
    store.write(spark.range(10_000).withColumnRenamed("id", "key"), "t", store.bucket(F.col("key")))
    store.publish()
    some = rows(spark, 17, 23)
    touched = store.touched(some)
    got = store.read("t", "key long", touched)
    assert len(touched) <= 2 and got.count() < 600
    assert {r.key for r in got.join(some, "key").collect()} == {17, 23}
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().toString()


def test_bucket_count():
    assert bucket_count(0) == 1 and bucket_count(1_000_001) == 2 and bucket_count(10**13) == 4096


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    monkeypatch.setattr(session, "ship", lambda s: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
