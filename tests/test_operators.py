"""Operators against small models, and every registered query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tagmill.operators import graph, inference, matching, splits, suppression
from tagmill.plans import registry
from tagmill.streaming import jobs

BOX = "g long, i long, x1 long, y1 long, x2 long, y2 long, conf long"


def boxes(n, seed):
    r = random.Random(seed)
    return [(r.randrange(4), i, x := r.randrange(60), y := r.randrange(60), x + r.randrange(10, 40), y + r.randrange(10, 40), r.randrange(20)) for i in range(n)]


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    return max(0, w) * max(0, h) if w > 0 and h > 0 else 0


def area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def clash(a, b, num=1, den=2):
    o = overlap(a, b)
    return o > 0 and o * den >= num * (area(a) + area(b) - o)


@pytest.mark.parametrize("seed", range(3))
def test_nms(spark, seed):
    rows = boxes(80, seed)
    kept = []
    for b in sorted(rows, key=lambda b: (b[0], -b[6], b[1])):
        if not any(k[0] == b[0] and clash(k, b) for k in kept):
            kept.append(b)
    got = suppression.nms(spark.createDataFrame(rows, BOX), ["g"], [-F.col("conf"), F.col("i")], ["i", "x1", "y1", "x2", "y2", "conf"]).collect()
    assert {r.i for r in got} == {k[1] for k in kept}


def test_nms_of_nothing(spark):
    assert suppression.nms(spark.createDataFrame([], BOX), ["g"], [F.col("i")], ["i", "x1", "y1", "x2", "y2"]).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def same_thing(a, b, spatial):
    """The described rules, row by row: barcode, overlap, place with price."""
    from difflib import SequenceMatcher

    clean = lambda x: (x or "").strip().lower()
    if len(clean(a["barcode"])) >= 8 and clean(a["barcode"]) == clean(b["barcode"]):
        return True
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    inter = max(w, 0) * max(h, 0)
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    if inter and inter / (area(a) + area(b) - inter) >= 0.45:
        return True
    apart = ((a["x1"] + a["x2"] - b["x1"] - b["x2"]) ** 2 + (a["y1"] + a["y2"] - b["y1"] - b["y2"]) ** 2) ** 0.5 / 2
    price = any(clean(a[c]) and clean(a[c]) == clean(b[c]) for c in ("price_default", "price_card"))
    names = [clean(r["product_name"]) for r in (a, b)]
    alike = all(names) and SequenceMatcher(None, *names).ratio() >= 0.35
    return spatial > 0 and apart <= spatial and price and (alike or not clean(a["barcode"]) and not clean(b["barcode"]))


def plain_dedupe(rows, spatial):
    """One recording in input order: seeds of each frame absorb rows, then identities grow by passes; places of the best, in order."""
    best = lambda group: max(group, key=lambda i: rows[i]["quality"])
    frames, winners = {}, []
    for i, r in enumerate(rows):
        frames.setdefault(r["frame"], []).append(i)
    for pool in frames.values():
        while pool:
            near = lambda j: ((rows[pool[0]]["x1"] + rows[pool[0]]["x2"] - rows[j]["x1"] - rows[j]["x2"]) ** 2 + (rows[pool[0]]["y1"] + rows[pool[0]]["y2"] - rows[j]["y1"] - rows[j]["y2"]) ** 2) <= 256
            bare = lambda r: r | {"barcode": ""}
            group = [j for j in pool if j == pool[0] or near(j) or same_thing(bare(rows[pool[0]]), bare(rows[j]), 0)]
            winners.append(best(group))
            pool = [j for j in pool if j not in group]
    out, pool = [], sorted(winners)
    while pool:
        cluster, pool, changed = [pool[0]], pool[1:], True
        while changed:
            changed, rest = False, []
            for j in pool:
                if any(same_thing(rows[j], rows[m], spatial) for m in cluster):
                    cluster.append(j)
                    changed = True
                else:
                    rest.append(j)
            pool = rest
        out.append(best(cluster))
    return sorted(out)


def test_full_dedupe_against_the_rules_row_by_row(spark):
    r = random.Random(6)
    rows = []
    for g in range(12):
        for i in range(40):
            x, y = r.randrange(900), r.randrange(700)
            code = r.choice(["", "", "4600", "46000001", "46000002", None])
            price = [r.choice(["", "1,00", "2,00", " 2,00 ", "нет"]) for _ in range(2)]
            rows.append({"g": g, "frame": i // 8, "i": i, "x1": x, "y1": y, "x2": x + r.randrange(40, 140), "y2": y + r.randrange(40, 90), "quality": r.randrange(6), "barcode": code, "price_default": price[0], "price_card": price[1], "product_name": r.choice(["", "Milk 1l", "MILK 2l", "bread"])})
    df = spark.createDataFrame(rows)
    for spatial in (0, 200):
        got = suppression.dedupe(df, ["g"], "frame", ["i"], "quality", spatial=spatial).collect()
        assert {x.g for x in got} == set(range(12))
        for g in range(12):
            assert [x.i for x in got if x.g == g] == plain_dedupe([x for x in rows if x["g"] == g], spatial)


def test_one_to_one(spark):
    r = random.Random(4)
    edges = sorted({(0, r.randrange(8), r.randrange(8)): r.randrange(20) for _ in range(60)}.items(), key=lambda e: (e[0][0], e[1], e[0][1], e[0][2]))
    left, right, want = set(), set(), set()
    for (_, a, b), _d in edges:
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame([(*k, d) for k, d in edges], "g long, a long, b long, d long")
    got = matching.one_to_one(df, ["g"], "a", "b", "d").collect()
    assert {(x.a, x.b) for x in got} == want


def test_splits(spark):
    keys = spark.range(1000).withColumnRenamed("id", "k")
    got = splits.shuffle_split(keys, "k", 0.13, 1)
    assert got.filter("split = 'val'").count() == 130 and got.count() == 1000
    assert splits.shuffle_split(keys, "k", 0, 1).filter("split = 'val'").count() == 0
    assert splits.shuffle_split(keys.limit(0), "k", 0.5, 1).count() == 0
    numbered = splits.renumber(keys.withColumn("m", F.col("k") % 7), ["m", "k"]).orderBy("m", "k").collect()
    assert [r.position for r in numbered] == list(range(1000))


def test_models_behind_the_boundary(spark):
    images = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b""))], "path string, content binary")
    found = inference.detect(images, lambda: lambda image: [(0, "tag", 0.5, 0.0, 0.0, float(x), 1.0) for x in image]).collect()
    assert [r.x_max for r in found] == [49.0, 50.0]

    def broken():
        def read(image):
            raise ValueError("no")

        return read

    rows = inference.recognize(images, {"good": lambda: lambda image: [(bytes(image).decode(), 1.0)], "bad": broken}).collect()
    assert {(r.engine, r.error) for r in rows} == {("good", None), ("bad", "ValueError: no")}
    frames = inference.decode_frames(images, lambda: lambda video: iter([b"x"] * 5), stride=2).collect()
    assert [r.frame for r in frames] == [0, 2, 4] * 2
    q = spark.createDataFrame([(bytearray(range(16)), 4, 4)], "p binary, w int, h int").select(inference.quality(F.col("p"), F.col("w"), F.col("h")).alias("q")).first().q
    assert q.brightness_mean == 7.5 and q.blur_score == 0
    engines = inference.Registry()
    engines.add("x", lambda: 1)
    engines.add("y", lambda: 1 / 0)
    assert engines.installed() == ["x"]


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(j, f, (j * 7 + f * 3) % 11) for j in range(5) for f in (0, 1, 2, 9, 10, 30)]
    df = spark.createDataFrame(rows, "job long, frame long, score long").repartition(1)
    for lo, hi in ((0, 5), (5, 20), (20, 40)):
        df.filter((F.col("frame") >= lo) & (F.col("frame") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_best(stream, "job", "frame", "score", gap=4)
    q = out.writeStream.format("memory").queryName("best").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.job, r.first_frame, r.last_frame, r.best, r.n) for r in spark.table("best").collect()}
    want = {(j, a, b, max(s for jj, f, s in rows if jj == j and a <= f <= b), n) for j in range(5) for a, b, n in ((0, 2, 3), (9, 10, 2))}
    assert got <= want and len(got) >= 5


def test_stream_returns_last_runs_at_end_markers(spark, tmp_path):
    batches = [[(1, 0, 5, None), (1, 2, 9, False), (2, 7, 1, False)], [(1, 30, 4, False), (2, None, None, True)], [(1, 31, 6, False), (1, None, None, True), (3, None, None, True)], [(2, 8, 3, False), (2, 8, None, True)]]
    for rows in batches:
        spark.createDataFrame(rows, "job long, frame long, score long, ended boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, frame long, score long, ended boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_best(stream, "job", "frame", "score", gap=4, end="ended")
    q = out.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("ended").collect())
    assert got == [(1, 0, 2, 9, 2), (1, 30, 31, 6, 2), (2, 7, 7, 1, 1), (2, 8, 8, 3, 1)]


def test_stage_batches_and_next_stage(spark, tmp_path):
    spark.createDataFrame([("a", "detect"), ("b", "finalize"), ("c", "ocr")], "job string, stage string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, stage string").parquet(str(tmp_path / "in"))

    def process(df):
        done = df.withColumn("r", jobs.handled(F.col("stage"), F.col("job") == "c"))
        return done.select("job", "r.*", F.when(F.col("job") == "c", "boom").alias("error"))

    jobs.stage_batches(stream, process, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    ok = {(r.job, r.status, r.current_stage) for r in spark.read.parquet(str(tmp_path / "out/ok")).collect()}
    assert ok == {("a", "queued", "classify"), ("b", "completed", "finalize")}
    assert [r.job for r in spark.read.parquet(str(tmp_path / "out/failed")).collect()] == ["c"]


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in data)


def test_pixels_of_any_size(spark):
    rows = [(bytearray(range(16)), 4, 4), (None, 4, 4), (bytearray(b"123"), 2, 2), (bytearray(b"x"), None, 1), (bytearray(b""), 0, 0)]
    df = spark.createDataFrame(rows, "p binary, w int, h int").select(inference.quality(F.col("p"), F.col("w"), F.col("h")).alias("q"))
    assert [r.q.brightness_mean for r in df.collect()] == [7.5, None, None, None, 0.0]
    red, yellow, grey = bytes([220, 20, 20]), bytes([240, 208, 16]), bytes([128] * 3)
    images = [red * 2 + grey * 8, red * 2 + yellow * 3 + grey * 5, grey * 5 + b"\x01", b"", None]
    df = spark.createDataFrame([(bytearray(i) if i is not None else None,) for i in images], "p binary").select(inference.color_shares(F.col("p")).alias("s"))
    assert [r.s.red for r in df.collect()] == [0.2, 0.2, 0.0, None, None]
    assert [r.c for r in df.select(inference.panel_color(F.col("s.red"), F.col("s.yellow")).alias("c")).collect()] == ["red", "yellow", "", "", ""]


def test_fallback_of_engines(spark):
    images = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"x"))], "path string, content binary")
    strict = lambda: lambda image: [(str(int(image)), 1.0)]
    loose = lambda: lambda image: [("?", 0.1)]

    def absent():
        raise ImportError("no engine")

    engines = {"both": inference.with_fallback(strict, loose), "second": inference.with_fallback(absent, loose), "none": inference.with_fallback(strict, absent)}
    rows = {(r.image_path, r.engine): (r.full_text, r.error) for r in inference.recognize(images, engines).collect()}
    assert rows["a", "both"] == ("1", None) and rows["b", "both"] == ("?", None) and rows["a", "second"] == ("?", None)
    assert rows["a", "none"] == ("1", None) and rows["b", "none"] == ("", "ImportError: no engine")


def test_tracker_keeps_state_over_a_recording_only(spark):
    def tracker():
        seen = []

        def step(payload):
            seen.append(payload)
            return [(len(seen), payload)]

        return step

    frames = [(v, f, f"{v}{f}") for v in ("a", "b", "c") for f in (3, 1, 2)]
    df = spark.createDataFrame(frames, "video string, frame long, payload string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # recordings go over batches
    try:
        got = sorted(tuple(r) for r in inference.track(df, "video", "frame", "payload", lambda: tracker()).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((v, f, f, p) for v, f, p in frames)


def test_stages_in_one_run(spark, tmp_path):
    df = spark.range(10)
    out = jobs.run_stages(df, [("half", lambda d: d.filter("id % 2 = 0")), ("add", lambda d: d.withColumn("x", F.col("id") + 1))], [str(tmp_path)])
    assert sorted(r.x for r in out.collect()) == [1, 3, 5, 7, 9]
    with pytest.raises(FileNotFoundError):
        jobs.run_stages(df, [], [str(tmp_path / "none")])
    with pytest.raises(RuntimeError, match="stage bad failed"):
        jobs.run_stages(df, [("bad", lambda d: d.select("nothing"))])


def test_clusters_over_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in (1, 2):
        frame = 0
        for _ in range(60):
            frame += rng.choice((0, 0, 1, 1, 2, 6))
            x, y = rng.randrange(40), rng.randrange(40)
            rows.append((k, frame, x, y, x + 30, y + 30, rng.randrange(1000)))
    schema = "key long, frame long, x1 long, y1 long, x2 long, y2 long, score long"
    cut = sorted(r[1] for r in rows)[len(rows) // 2]
    (tmp_path / "in").mkdir()
    df = spark.createDataFrame([(*r, False) for r in rows] + [(k, None, 0, 0, 0, 0, 0, True) for k in (1, 2)], schema + ", end boolean")
    for n, test in enumerate((F.col("frame") < cut, F.coalesce(F.col("frame") >= cut, F.lit(True)))):
        df.filter(test).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        for f in (tmp_path / f"part{n}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema + ", end boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    best = jobs.stream_precluster(stream, "key", "frame", "score", gap=4, end="end")
    q = best.writeStream.format("memory").queryName("clusters").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    order = [F.col("frame"), -F.col("score"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]]
    batch = suppression.precluster(spark.createDataFrame(rows, schema), ["key"], "frame", order, ["frame", "x1", "y1", "x2", "y2", "score"], "score", gap=4)
    got = sorted(tuple(r) for r in spark.table("clusters").collect())
    assert got == sorted(tuple(r) for r in batch.select("key", "frame", "x1", "y1", "x2", "y2", "score").collect()) and got


def test_every_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    wrong = []
    sql = registry.oracle_sql()
    for name, q in registry.queries().items():
        df = q(spark, sf_dir)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        if name in sql:
            cur = con.execute(sql[name])
            columns = [c[0] for c in cur.description]
            if sorted(columns) != sorted(df.columns) or rows_of(columns, cur.fetchall()) != got:
                wrong.append(name)
    assert not wrong


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).columns) == 29
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clusters_of_a_recording_stream_in_order_and_none_is_gathered(spark):
    r = random.Random(12)
    rows = [(g, f, k, x, y, x + r.randrange(20, 60), y + r.randrange(20, 60), r.randrange(9)) for g in range(3) for f in range(60) for k in range(r.randrange(4)) for x, y in [(r.randrange(80), r.randrange(80))]]
    rows += [(0, None, 0, 1, 1, 9, 9, 5), (1, 7, 9, None, 1, 9, 9, 5)]
    want = [(0, *rows[-2][1:]), (1, *rows[-1][1:])]
    for g in range(3):
        clusters = []
        for row in sorted((x for x in rows[:-2] if x[0] == g), key=lambda x: (x[1], -x[7], x[2])):
            for c in clusters:
                b = c[1]
                w, h = min(b[5], row[5]) - max(b[3], row[3]), min(b[6], row[6]) - max(b[4], row[4])
                both = (b[5] - b[3]) * (b[6] - b[4]) + (row[5] - row[3]) * (row[6] - row[4]) - w * h
                if row[1] - c[0] <= 2 and w > 0 and h > 0 and 4 * w * h >= both:
                    c[0], c[1] = row[1], row if row[7] > b[7] else b
                    break
            else:
                clusters.append([row[1], row])
        want += [c[1] for c in clusters]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "g long, f long, k long, x1 long, y1 long, x2 long, y2 long, s long")
        out = suppression.precluster(df, ["g"], "f", [F.col("f"), -F.col("s"), F.col("k")], ["f", "k", "x1", "y1", "x2", "y2", "s"], "s", gap=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Window" not in plan
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_loss_funnel_gathers_no_recording(spark, sf_dir):
    from tagmill.plans.evaluation import agg_loss_funnel

    plan = agg_loss_funnel(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_identities_compare_rows_with_those_only_that_are_left():
    """A recording of 18,000 crowded rows, in a few seconds; each row against all others takes many times as long."""
    import time

    import numpy as np
    import pyarrow as pa

    g, n = np.random.default_rng(1), 18000
    x, y = g.integers(0, 300, n), g.integers(0, 200, n)
    cells = {c: [str(v) if v else "" for v in g.integers(0, k, n).tolist()] for c, k in (("_barcode", 3), ("_price_default", 20), ("_price_card", 20), ("_product_name", 6))}
    tags = suppression.Tags.of(pa.table({"x1": x, "y1": y, "x2": x + g.integers(60, 140, n), "y2": y + g.integers(50, 110, n), **cells}))
    began = time.process_time()
    of, best = suppression.grow_identities(tags, g.integers(0, 9, n), 9, 20, 40)
    assert time.process_time() - began < 4
    assert (of == 0).all() and best.sum() == 1


def test_identities_are_named_by_their_first_row_without_a_window(spark, sf_dir):
    from tagmill.plans.detections import dup_identity_components

    assert "Window" not in dup_identity_components(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_one_to_one_of_points_lists_no_pairs(spark, sf_dir, monkeypatch):
    import numpy as np

    from tagmill.plans.tables import joi_one_to_one

    for seed in range(40):
        g = np.random.default_rng(seed)
        monkeypatch.setattr(matching, "EDGES", int(g.choice([1, 30, 1 << 20])))
        n, k, size, most = int(g.integers(1, 60)), int(g.integers(1, 40)), int(g.choice([3, 30, 120])), int(g.choice([0, 50, 2000]))
        a, b = (g.integers(0, n, n), *g.integers(-size, size, (2, n))), (g.permutation(k), *g.integers(-size, size, (2, k)))
        left, right, want = set(), set(), []
        for d, x, y in sorted((int((ax - bx) ** 2 + (ay - by) ** 2), int(i), int(j)) for i, ax, ay in zip(*a, strict=True) for j, bx, by in zip(*b, strict=True)):
            if d <= most and x not in left and y not in right:
                left.add(x)
                right.add(y)
                want.append((x, y, d))
        assert sorted(zip(*map(list, matching._greedy_near(*a, *b, most)), strict=True)) == sorted(want)
    assert "Join" not in joi_one_to_one(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
