"""The job store: look-ups by id, updates, compaction."""

import pytest
from pyspark.sql import functions as F

from tagmill.sources.jobstore import JobStore, MissingJob

UPDATE = "id string, at timestamp, status string, current_stage string, result_csv_path string, error_message string, payload_json string"


def made(spark, tmp_path, n=200):
    store = JobStore(spark, str(tmp_path / "jobs"), 8)
    store.create(spark.range(n).selectExpr("concat('j', id) AS id", "concat(id, '.mp4') AS filename", "concat('up/', id) AS upload_path", "'{}' AS payload_json", "timestamp_seconds(1000) AS at"))
    return store


def update(spark, store, *rows):
    at = [(r[0], r[1], *r[2:]) for r in rows]
    df = spark.createDataFrame(at, UPDATE.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))
    store.update(df)


def test_update_keeps_what_is_not_given(spark, tmp_path):
    store = made(spark, tmp_path)
    update(spark, store, ("j1", 2000, "processing", "ocr", None, "slow", None), ("j2", 2000, "", None, "r.csv", None, '{"a":1}'))
    update(spark, store, ("j1", 3000, None, "", "", None, None))
    for compacted in (False, True):
        if compacted:
            store.compact()
        one, two, three = (store.get(j).first() for j in ("j1", "j2", "j3"))
        assert (one.status, one.current_stage, one.result_csv_path, one.error_message, one.filename, one.payload_json) == ("processing", "ocr", "", None, "1.mp4", "{}")
        assert (two.status, two.current_stage, two.result_csv_path, two.payload_json) == ("queued", "detect", "r.csv", '{"a":1}')
        assert (three.status, three.upload_path) == ("queued", "up/3") and three.at == three.created_at
        assert store.get("nobody").first() is None and store.state().count() == 200
    update(spark, store, ("j2", 2500, None, None, None, "late", None))  # a later batch counts, whatever its time
    assert store.get("j2").first().error_message == "late" and store.compact() == 3
    assert store.lookup(spark.createDataFrame([("j2",), ("j2",), ("no",)], "id string")).count() == 1


def test_update_of_a_missing_job_raises_and_writes_nothing(spark, tmp_path):
    store = made(spark, tmp_path, 3)
    with pytest.raises(MissingJob, match="j7"):
        update(spark, store, ("j1", 2000, "failed", None, None, "x", None), ("j7", 2000, "failed", None, None, "x", None))
    assert store.get("j1").first().status == "queued" and store._numbers("log", "batch") == [0]


def test_a_look_up_opens_one_file_a_batch(spark, tmp_path):
    store = made(spark, tmp_path)
    whole = len(store._events().inputFiles())
    assert whole >= 8 and store.files_read("j5") == 1
    update(spark, store, *[(f"j{k}", 2000, "failed", None, None, "x", None) for k in range(50)])
    assert store.files_read("j5") == 2
    store.compact()
    assert store.files_read("j5") == 1
    plan = store.get("j5")._jdf.queryExecution().toString()
    assert "= j5)" in plan and store.get("j5").count() == 1


def test_a_write_that_died_is_not_read(spark, tmp_path):
    store = made(spark, tmp_path, 10)
    update(spark, store, ("j1", 2000, "failed", None, None, "x", None))
    (tmp_path / "jobs/log/batch=1/_SUCCESS").unlink()
    assert store.get("j1").first().status == "queued"
    update(spark, store, ("j1", 3000, "completed", None, None, None, None))  # takes the number again
    assert store.get("j1").first().status == "completed"
    assert JobStore(spark, str(tmp_path / "none")).get("j1").first() is None
