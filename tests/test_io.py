"""Scans and sinks."""

from pyspark.sql import functions as F

from tagmill.operators import contract
from tagmill.sources import readers, sinks


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿image_path,confidence,note\r\n"x ""q"", y",0.5,z\r\n\r\n,1,2\r\nshort\r\n'.encode())
    df = readers.csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["image_path", "confidence", "note"]
    assert [tuple(r) for r in df.collect()] == [('x "q", y', "0.5", "z"), ("", "1", "2"), ("short", "", "")]
    found = readers.detections(spark, str(tmp_path / "a.csv"))
    assert found.columns == readers.DETECTIONS and found.count() == 2
    assert readers.row_count(spark, str(tmp_path / "a.csv")) == 3 and readers.row_count(spark, str(tmp_path / "no.csv"), None) is None


def test_json_scans(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/tracking_manifest.json").write_text('[{"track_id": 1, "filename": "a.jpg", "frame_idx": 3, "bbox": [1, 2, 3, 4], "conf": 0.5}]')
    row = readers.manifest(spark, str(tmp_path / "t")).first()
    assert (row.filename, row.x_min, row.y_max, row.track_id) == ("a.jpg", "1", "4", 1)
    (tmp_path / "c").mkdir()
    (tmp_path / "c/crops_manifest.csv").write_text("crop_path,confidence\nd/e/a.jpg,0.5\n")
    assert readers.manifest(spark, str(tmp_path / "c")).first().filename == "a.jpg"
    (tmp_path / "l.jsonl").write_text('{"id": 1, "output": "{\\"a\\": 2}"}\n{"id": 2, "output": "no json"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "output", "a int").collect()
    assert [(r.id, r.output.a) for r in rows] == [("1", 2)]


def test_listings(spark, tmp_path):
    for p in ("one/a.JPG", "one/b.txt", "two/a.JPG", "two/deep/c.png", "two/v.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    one, two = (readers.listing(spark, str(tmp_path / d)) for d in ("one", "two"))
    assert one.count() == 1 and two.count() == 2 and readers.videos(spark, str(tmp_path)).count() == 1
    names = {r.name: r.folder for r in readers.first_by_name([one, two]).collect()}
    assert names == {"a.JPG": 0, "c.png": 1}
    (tmp_path / "list.txt").write_text("crops/a.JPG\tlabel\nno tab\ncrops/z.jpg\tother\n")
    assert readers.rec_list(spark, str(tmp_path / "list.txt")).count() == 2
    assert [r.label for r in readers.rec_list(spark, str(tmp_path / "list.txt"), one).collect()] == ["label"]
    (tmp_path / "data.yaml").write_text("path: 'x/y'\nnc: 1\n")
    assert readers.yaml_value(spark, str(tmp_path / "data.yaml"), "path") == "x/y" and readers.yaml_value(spark, str(tmp_path / "data.yaml"), "val") is None


def test_frames(spark):
    frames = spark.createDataFrame([("v", k, 40 * k) for k in range(10)], "video string, frame long, ms long")
    assert [(r.frame, r.nth) for r in readers.keep_stride(frames, "video", "frame", 4).orderBy("frame").collect()] == [(0, 0), (4, 1), (8, 2)]
    near = readers.nearest_frame(spark.createDataFrame([("v", 100)], "video string, ms long"), frames, "video").first()
    assert near.frame == 2  # 80 and 120 are as near


def test_result_sink(spark, tmp_path):
    rows = contract.result_rows(spark.createDataFrame([('a "b", c', "3.05")], "product_name string, price_card string"))
    sinks.write_result(rows, str(tmp_path / "r"))
    back = readers.csv(spark, str(tmp_path / "r"))
    assert back.columns == contract.COLUMNS and back.first().product_name == 'a "b", c'
    sinks.write_result(rows.limit(0), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == [sinks.header()]
    assert sinks.csv_lines(rows.select("product_name", "price_card")).first().value == '"a ""b"", c","305,00"'


def test_queue_sink(spark, tmp_path):
    df = spark.range(4).withColumnRenamed("id", "k")
    sinks.write_queues(df, F.array_compact(F.array(F.lit("all"), F.when(F.col("k") > 1, "big"))), str(tmp_path / "q"))
    assert {r.queue: r["count"] for r in spark.read.parquet(str(tmp_path / "q")).groupBy("queue").count().collect()} == {"all": 4, "big": 2}
    assert sinks.not_done(df, spark.range(2).withColumnRenamed("id", "k"), "k").count() == 2


def test_listing_flat_and_first(spark, tmp_path):
    for p in ("b.png", "a.JPG", "c.jpg", "deep/d.jpg"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    names = lambda df: [r.path.split("/")[-1] for r in df.collect()]
    assert sorted(names(readers.listing(spark, str(tmp_path), recursive=False))) == ["a.JPG", "b.png", "c.jpg"]
    assert names(readers.listing(spark, str(tmp_path), first=3)) == ["a.JPG", "c.jpg", "d.jpg"]


def test_client_csv_and_diagnostics_of_nothing(spark, tmp_path):
    def written(name):
        return b"".join(f.read_bytes() for f in sorted((tmp_path / name).glob("part-*")))

    df = spark.createDataFrame([(1, 'x"y'), (2, None)], "k int, t string").coalesce(1)
    sinks.write_client_csv(df, str(tmp_path / "some"))
    assert written("some") == b'\xef\xbb\xbfk,t\r\n1,"x""y"\r\n2,\r\n'
    sinks.write_client_csv(df.limit(0), str(tmp_path / "none"))
    assert written("none") == b"\xef\xbb\xbfk,t\r\n"
    maps = spark.createDataFrame([(2, {"b": "1", "a": "2"}), (1, {"c": "3"})], "n int, m map<string,string>")
    sinks.write_diagnostics(maps.coalesce(1), "n", "m", str(tmp_path / "maps"))
    assert written("maps").split(b"\n")[0].startswith(b"c,")
    sinks.write_diagnostics(maps.limit(0), "n", "m", str(tmp_path / "no_maps"))
    assert written("no_maps") == b""


def test_csv_folders_by_each_files_header(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.csv").write_bytes(b"\xef\xbb\xbfid,name\r\n1,x\r\n")
    (tmp_path / "a/b/two.csv").write_text('name,id,"odd,\nname"\n"y\nz",2,3\n')
    (tmp_path / "a/b/three.CSV").write_text("name,id\nw,4\n")
    (tmp_path / "a/b/empty.csv").write_text("")
    (tmp_path / "a/b/head.csv").write_text("id,name\n")
    (tmp_path / "a/note.txt").write_text("id\n9\n")
    got = readers.csv(spark, str(tmp_path / "a"), recursive=True)
    assert sorted((r.id, r.name, r["odd,\nname"]) for r in got.collect()) == [("1", "x", ""), ("2", "y\nz", "3"), ("4", "w", "")]
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "a"), ["name", "gone"], recursive=True).collect())) == [("w", ""), ("x", ""), ("y\nz", "")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/empty.csv").write_text("")
    assert readers.csv(spark, str(tmp_path / "none"), ["id"], recursive=True).count() == 0


def test_label_files_are_read_back_with_the_empty_ones_and_without_a_listing(spark, tmp_path):
    from tagmill.plans.files import snk_label_files

    spark.createDataFrame([(k,) for k in range(20)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 5) for k in range(40)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = snk_label_files(spark, str(tmp_path))
    assert "binaryFile" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("train", 18, 40, 13), ("val", 2, 0, 2)}


def test_files_are_read_by_name_once_each(spark, tmp_path):
    from tagmill.sources import storage

    for k in range(5):
        (tmp_path / f"{k}.txt").write_bytes(b"x" * k)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{k % 5}.txt",) for k in range(9)], "path string")
    found = storage.read_files(paths)
    assert found.rdd.getNumPartitions() >= 4
    assert sorted((r["path"][-5:], r["length"], bytes(r["content"])) for r in found.collect()) == [(f"{k}.txt", k, b"x" * k) for k in range(5)]
