"""Indexing jobs as a table of events: uploads are queued, one consumer works them off in order, and leases outlive a lost one.

An event is a row: a job's state from then on. The last event of a job counts. Who takes a job writes `running` with the
time until which nobody else may take it; a later consumer takes over where that has passed. A job that fails ends as
`error` and blocks nothing. Events are appended as small Parquet files, so that any session sees the same table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.sources.scratch import names

EVENT = "job_id string, service string, payload string, state string, submitted double, at double, lease double, error string"
OPEN = ("queued", "running")
LEASE_SECONDS = 3600.0


@dataclass(frozen=True)
class Job:
    job_id: str
    service: str
    payload: dict


class JobQueue:
    """Jobs under a folder. One consumer at a time takes jobs; any number of sessions may submit."""

    def __init__(self, spark: SparkSession, root: str, lease: float = LEASE_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.lease, self.clock = spark, root, lease, clock

    def events(self) -> DataFrame:
        done = [n for n in names(self.spark, f"{self.root}/events") if "_SUCCESS" in names(self.spark, f"{self.root}/events/{n}")]
        return self.spark.read.schema(EVENT).parquet(*[f"{self.root}/events/{n}" for n in done]) if done else self.spark.createDataFrame([], EVENT)

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], EVENT).coalesce(1).write.parquet(f"{self.root}/events/{self.clock():020.6f}-{uuid.uuid4().hex}")

    def jobs(self) -> DataFrame:
        """Each job with its last state; of events of one instant, an end counts more than a start."""
        order = F.struct("at", F.when(F.col("state") == "queued", 0).when(F.col("state") == "running", 1).otherwise(2), "lease")
        last = self.events().groupBy("job_id").agg(F.max_by(F.struct("service", "payload", "state", "submitted", "at", "lease", "error"), order).alias("e"))
        return last.select("job_id", "e.*")

    def submit(self, service: str, payload: dict, job_id: str | None = None) -> str:
        """Queue a job; one under an id that is there already stays as it is."""
        job_id = job_id or uuid.uuid4().hex
        if self.events().where(F.col("job_id") == job_id).isEmpty():
            now = self.clock()
            self._append((job_id, service, json.dumps(payload), "queued", now, now, 0.0, None))
        return job_id

    def status(self, service: str) -> str:
        """running or queued where a job is, else how the last job ended; finished where there was none."""
        found = self.jobs().where(F.col("service") == service)
        first = found.orderBy(F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).otherwise(2), F.desc("at"), "job_id").first()
        return first["state"] if first else "finished"

    def take(self) -> Job | None:
        """The first open job in order of submission whose service has no job under a lease; it gets one."""
        now = self.clock()
        jobs = self.jobs().where(F.col("state").isin(*OPEN))
        held = jobs.where((F.col("state") == "running") & (F.col("lease") > now))
        free = jobs.join(held.select("service"), "service", "left_anti").orderBy("submitted", "job_id").first()
        if free is None:
            return None
        self._append((free["job_id"], free["service"], free["payload"], "running", free["submitted"], now, now + self.lease, None))
        return Job(free["job_id"], free["service"], json.loads(free["payload"]))

    def end(self, job: Job, error: BaseException | None = None) -> None:
        now = self.clock()
        self._append((job.job_id, job.service, json.dumps(job.payload), "error" if error else "finished", now, now, 0.0, repr(error) if error else None))

    def drain(self, work: Callable[[str, dict], None]) -> int:
        """Take jobs until there is none; how many were worked on. A job that raises ends as an error."""
        n = 0
        while job := self.take():
            try:
                work(job.service, job.payload)
                self.end(job)
            except Exception as e:  # any failure is the job's, not the queue's
                self.end(job, e)
            n += 1
        return n

    # --- uploads

    def folder(self, service: str) -> str:
        return f"{self.root}/uploads/{service}"

    def upload(self, service: str, paths: list[str]) -> None:
        """Copy files into the service's folder, which the stream of uploads watches; an equal name is replaced."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        system = hadoop.Path(self.folder(service)).getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(hadoop.Path(self.folder(service)))
        for p in paths:
            system.copyFromLocalFile(False, True, hadoop.Path(p), hadoop.Path(f"{self.folder(service)}/{p.rsplit('/', 1)[-1]}"))

    def watch(self) -> StreamingQuery:
        """Queue a job for each service that got files since the last time, with their paths, and stop.

        A batch that is tried again submits under the same ids. At most 1000 files are a batch.
        """
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(f"{self.root}/uploads").select("path")

        def queued(batch: DataFrame, number: int) -> None:
            service = F.element_at(F.split("path", "/"), -2)
            for r in batch.groupBy(service.alias("service")).agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("service").collect():
                self.submit(r["service"], {"paths": r["paths"]}, f"upload-{number:08d}-{r['service']}")

        return files.writeStream.foreachBatch(queued).option("checkpointLocation", f"{self.root}/watch").trigger(availableNow=True).start()
