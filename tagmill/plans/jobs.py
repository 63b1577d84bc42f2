"""Queries over the job log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.plans.proxies import read
from tagmill.plans.registry import query
from tagmill.sources.jobstore import JobStore
from tagmill.sources.scratch import new_folder
from tagmill.streaming import jobs, timed


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: type as stage, user as job; errors carry a message, purchases a result."""
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "detect").when(kind == "view", "classify").when(kind == "click", "ocr").when(kind == "purchase", "finalize")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), "ts", "event_id", stage.alias("stage"), F.when(kind == "purchase", F.concat(F.lit("result_"), F.col("event_id").cast("string"))).alias("result"), F.when(kind == "error", F.get_json_object("props", "$.k")).alias("error"),
    )


_LOG = """log AS (SELECT user_id AS job, ts, event_id, CASE event_type WHEN 'signup' THEN 'detect' WHEN 'view' THEN 'classify' WHEN 'click' THEN 'ocr' WHEN 'purchase' THEN 'finalize' END AS stage,
 CASE WHEN event_type = 'purchase' THEN 'result_' || event_id::VARCHAR END AS result, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS error FROM events)"""


@query(f"WITH {_LOG}, a AS (SELECT job, count(*) AS n_events FROM log GROUP BY job), s AS (SELECT job, stage FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE stage IS NOT NULL) WHERE rn = 1), r AS (SELECT job, result FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE result IS NOT NULL) WHERE rn = 1), e AS (SELECT job, error FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1) SELECT a.job, stage, result, error, n_events FROM a LEFT JOIN s USING (job) LEFT JOIN r USING (job) LEFT JOIN e USING (job)")
def stm_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11, SNK12, SRC27, STM02: a job's fields, sticky but for the error."""
    return jobs.latest_state(_log(spark, sf_dir), "job", ["ts", "event_id"], ["stage", "result"], ["error"])


@query(f"WITH {_LOG} SELECT stage, count(*) AS n, count(DISTINCT job) AS n_jobs, CASE stage WHEN 'detect' THEN 'classify' WHEN 'classify' THEN 'ocr' WHEN 'ocr' THEN 'finalize' END AS following, CASE stage WHEN 'detect' THEN 0 WHEN 'classify' THEN 25 WHEN 'ocr' THEN 50 ELSE 75 END AS progress FROM log WHERE stage IS NOT NULL GROUP BY stage")
def stm_stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM01, PRJ16: events and jobs by stage, the stage after it, and its progress."""
    by_stage = _log(spark, sf_dir).filter("stage is not null").groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("job").alias("n_jobs"))
    return by_stage.withColumn("following", jobs.next_stage(F.col("stage"))).withColumn("progress", jobs.progress(F.col("stage"), F.lit("processing")))


@query("WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000) AS s, lag((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM e) SELECT user_id, k::BIGINT AS run, min(s) AS first_s, max(s) AS last_s, count(*) AS n FROM g GROUP BY user_id, k")
def stm_gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM07: runs of a job's events without a pause of over twelve hours."""
    by_time = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("long").alias("s"))
    before = F.lag("s").over(by_time)
    begins = F.when(before.isNull() | (F.col("s") - before > 43200), 1).otherwise(0)
    numbered = e.withColumn("b", begins).withColumn("run", F.sum("b").over(by_time))
    return numbered.groupBy("user_id", "run").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.count("*").alias("n"))


def _streamed(spark: SparkSession, sf_dir: str, table: str, clock: dict, out) -> DataFrame:  # noqa: ANN001
    """What a stream over a table's files gives, its watermark carried past the end by one row of another source (`clock`)."""
    folder, schema = new_folder(spark), read(spark, sf_dir, table).schema
    path = f"{sf_dir}/{table}[.]parquet"  # a pattern may name one file, a plain path only a folder
    spark.range(1).select(*[(F.lit(clock[f.name]).cast(f.dataType) if f.name in clock else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]).write.parquet(f"{folder}/clock")
    rows = spark.readStream.schema(schema).parquet(path).unionByName(spark.readStream.schema(schema).parquet(f"{folder}/clock"))
    found = out(rows)
    timed.started(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("WITH e AS (SELECT l_suppkey AS key, l_orderkey AS frame, CAST(round(l_extendedprice) AS BIGINT) AS score FROM lineitem), b AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY key ORDER BY frame, score) <= 40 THEN 0 ELSE 1 END AS begins FROM e), r AS (SELECT *, sum(begins) OVER (PARTITION BY key ORDER BY frame, score ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT key, min(frame) AS first_frame, max(frame) AS last_frame, max(score) AS best, count(*) AS n FROM r GROUP BY key, run")
def stm_timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM07: runs of a supplier's orders over a stream, closed by timers."""
    c = F.col

    def out(rows: DataFrame) -> DataFrame:
        seen = rows.select(c("l_suppkey").alias("key"), c("l_orderkey").alias("frame"), F.round("l_extendedprice").cast("long").alias("score"))
        return timed.runs(seen, "key", "frame", "score", gap=40)

    return _streamed(spark, sf_dir, "lineitem", {"l_orderkey": 9 * 10**12, "l_extendedprice": 0}, out)


_STEP = "e.error IS NULL AND e.stage IS NOT DISTINCT FROM (['detect', 'classify', 'ocr', 'finalize'])[h.here + 1]"


@query(f"""WITH RECURSIVE log AS (SELECT user_id * 100 + day(ts) AS job, epoch_us(ts) // 1000 AS ms, event_id, CASE event_type WHEN 'signup' THEN 'detect' WHEN 'view' THEN 'classify' WHEN 'click' THEN 'ocr' WHEN 'purchase' THEN 'finalize' END AS stage,
 CASE WHEN event_type = 'error' THEN 'error_' || event_id::VARCHAR END AS error FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ms, event_id) AS k FROM log),
h AS (SELECT DISTINCT job, 0::BIGINT AS k, 0 AS here, NULL::BIGINT AS done_at, NULL::VARCHAR AS error, false AS done, false AS live FROM e
 UNION ALL SELECT e.job, e.k, CASE WHEN {_STEP} THEN (h.here + 1) % 4 ELSE h.here END, CASE WHEN {_STEP} THEN e.ms ELSE h.done_at END, CASE WHEN e.error IS NOT NULL THEN e.error WHEN {_STEP} THEN NULL ELSE h.error END,
  {_STEP} AND h.here = 3, NOT ({_STEP} AND h.here = 3) FROM (SELECT job, k, here, CASE WHEN done THEN NULL ELSE done_at END AS done_at, error FROM h) h JOIN e ON e.job = h.job AND e.k = h.k + 1),
t AS (SELECT job, max(k) AS k FROM e GROUP BY job)
SELECT job, 'completed' AS status, 'finalize' AS current_stage, NULL AS error_message, done_at AS updated_ms FROM h WHERE done
UNION ALL SELECT h.job, CASE WHEN error IS NOT NULL THEN 'failed' ELSE 'queued' END, (['detect', 'classify', 'ocr', 'finalize'])[here + 1], error, done_at FROM h JOIN t ON h.job = t.job AND h.k = t.k WHERE live""")
def stm_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM02: a job's stages over a stream, each counted once and in order, until it completes or falls silent."""
    c, kind = F.col, F.col("event_type")

    def out(rows: DataFrame) -> DataFrame:
        stage = F.when(kind == "signup", "detect").when(kind == "view", "classify").when(kind == "click", "ocr").when(kind == "purchase", "finalize")
        error = F.when(kind == "error", F.concat(F.lit("error_"), c("event_id").cast("string")))
        seen = rows.select((c("user_id") * 100 + F.dayofmonth("ts")).alias("job"), c("ts").cast("timestamp").alias("ts"), "event_id", stage.alias("stage"), error.alias("error"))
        return timed.job_states(seen, "job", "ts", "event_id", "stage", "error", patience=10 * 24 * 3600 * 1000)

    return _streamed(spark, sf_dir, "events", {"ts": "2100-01-01 00:00:00"}, out)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, {'part': event_id % 3, 'us': epoch_us(ts), 'id': event_id} AS o, CASE event_type WHEN 'signup' THEN 'detect' WHEN 'view' THEN 'classify' WHEN 'click' THEN '' ELSE NULL END AS stage, CASE WHEN event_type = 'purchase' THEN 'r' || event_id::VARCHAR END AS result, CASE WHEN event_type = 'error' THEN 'e' || event_id::VARCHAR END AS error FROM events)
SELECT 'job_' || user_id::VARCHAR AS id, coalesce(arg_max(stage, o) FILTER (WHERE stage <> ''), 'detect') AS current_stage, arg_max(result, o) FILTER (WHERE result IS NOT NULL) AS result_csv_path, (arg_max(struct_pack(v := error), o)).v AS error_message, arg_max(ms, o) AS updated_ms FROM e GROUP BY user_id""")
def snk_job_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11, SNK12, SRC27: jobs created, updated in batches, compacted between them, and looked up by id."""
    c, kind = F.col, F.col("event_type")
    events = read(spark, sf_dir, "events").withColumn("id", F.concat(F.lit("job_"), c("user_id").cast("string")))
    store = JobStore(spark, new_folder(spark), 16)
    first = events.groupBy("id").agg(F.min("ts").cast("timestamp").alias("at"))
    store.create(first.withColumns({"at": c("at") - F.expr("interval 1 day"), "filename": F.concat("id", F.lit(".mp4"))}))
    given = events.select(
        "id", c("ts").cast("timestamp").alias("at"), F.when(kind == "signup", "detect").when(kind == "view", "classify").when(kind == "click", "").alias("current_stage"),
        F.when(kind == "purchase", F.concat(F.lit("r"), c("event_id").cast("string"))).alias("result_csv_path"), F.when(kind == "error", F.concat(F.lit("e"), c("event_id").cast("string"))).alias("error_message"),
        (c("event_id") % 3).alias("part"),
    )
    for part in range(3):
        store.update(given.filter(c("part") == part).drop("part"))
        if part == 1:
            store.compact()
    return store.lookup(events).select("id", "current_stage", "result_csv_path", "error_message", F.unix_millis("at").alias("updated_ms"))
