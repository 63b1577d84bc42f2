"""Jobs by id: a snapshot and the updates since, both in buckets of the id.

A store is a folder.  `log/batch=N` holds one append each, `snapshot/upto=N` the state of every
job after the batches up to N.  Reads merge the newest finished snapshot with the batches after
it; compact() writes the next snapshot.  Files are split by bucket (a hash of the id) and carry a
bloom filter of it, so the look-up of one job opens one file of the snapshot and at most one
of each later batch, and most of those are passed over by their filters.

An update keeps a job's status and stage where it gives none or a blank, its paths and payload
where it gives null, and always takes the update's error (null clears it).  Updates count in
the order of their batches, inside a batch in that of their times.  Two writers at once must agree on batch numbers: appends
are for one writer (the service's stage runner), reads for any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.sources.readers import exists
from tagmill.streaming.jobs import latest_state

COLUMNS = "id string, at timestamp, filename string, status string, current_stage string, upload_path string, result_json_path string, result_csv_path string, error_message string, payload_json string, created_at timestamp"
STICKY = ["filename", "status", "current_stage", "upload_path", "result_json_path", "result_csv_path", "payload_json", "created_at"]


class MissingJob(KeyError):
    """An update names a job that was never created."""


class JobStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schema = T.StructType.fromDDL(COLUMNS)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Finished batches or snapshots, by their _SUCCESS files; a write that died is not among them."""
        path = f"{self.folder}/{kind}"
        if not exists(self.spark, path):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{name}=")]
        return sorted(int(n.split("=")[1]) for n in found if exists(self.spark, f"{path}/{n}/_SUCCESS"))

    def _write(self, rows: DataFrame, path: str) -> None:
        split = rows.withColumn("bucket", self._bucket(F.col("id"))).repartition("bucket").sortWithinPartitions("bucket", "id")
        split.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", 100_000).parquet(path)

    def _events(self, job: str | None = None) -> DataFrame:
        """The newest snapshot and what came after; with `job`, only its bucket's files and its rows."""
        tops = self._numbers("snapshot", "upto")
        top = tops[-1] if tops else -1
        parts = [(f"{self.folder}/snapshot/upto={top}", top)] if tops else []
        parts += [(f"{self.folder}/log/batch={n}", n) for n in self._numbers("log", "batch") if n > top]
        if job is not None:
            # The bucket's folder itself is read, so that others are not even listed.
            bucket = self.spark.sql("SELECT pmod(xxhash64(:job), :buckets) AS b", {"job": job, "buckets": self.buckets}).first()["b"]
            parts = [(f"{path}/bucket={bucket}", n) for path, n in parts if exists(self.spark, f"{path}/bucket={bucket}")]
        every = self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField("batch", T.LongType())]))
        for path, n in parts:
            every = every.unionByName(self.spark.read.schema(self.schema).parquet(path).select(*self.schema.names, F.lit(n).cast("long").alias("batch")))
        return every if job is None else every.filter(F.col("id") == job)

    def _folded(self, events: DataFrame) -> DataFrame:
        # A snapshot's rows are as of its last batch.
        known = events.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("status", "current_stage")})
        return latest_state(known, "id", ["batch", "at"], [*STICKY, "at"], ["error_message"]).select(*self.schema.names)

    def _append(self, rows: DataFrame) -> None:
        done = self._numbers("log", "batch") + self._numbers("snapshot", "upto")
        self._write(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]), f"{self.folder}/log/batch={max(done, default=-1) + 1}")

    def create(self, jobs: DataFrame) -> None:
        """New jobs (id, filename, upload_path, payload_json, at): queued at the first stage."""
        self._append(jobs.withColumns({"status": F.lit("queued"), "current_stage": F.lit("detect"), "created_at": F.col("at")}))

    def update(self, updates: DataFrame) -> None:
        """Updates by id; raises MissingJob, and writes nothing, where one names no job."""
        missing = updates.select("id").distinct().join(self._events().select("id").distinct(), "id", "left_anti").limit(5).collect()
        if missing:
            raise MissingJob(", ".join(str(r["id"]) for r in missing))
        self._append(updates)

    def get(self, job: str) -> DataFrame:
        """The state of one job, a row or none."""
        return self._folded(self._events(job))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The states of many jobs (id), in one scan."""
        return self._folded(self._events().join(ids.select("id").distinct(), "id", "left_semi"))

    def state(self) -> DataFrame:
        return self._folded(self._events())

    def compact(self) -> int:
        """Fold all batches into the next snapshot; readers see it once it is whole. Gives its number."""
        numbers = self._numbers("log", "batch") + self._numbers("snapshot", "upto")
        top = max(numbers, default=-1)
        if top >= 0 and top not in self._numbers("snapshot", "upto"):
            self._write(self.state(), f"{self.folder}/snapshot/upto={top}")
        return top

    def files_read(self, job: str) -> int:
        """Files that the look-up of a job opens."""
        return len(self._events(job).inputFiles())
