"""Publication of files from executors: a data source writer whose commit renames, and writes the manifest last.

A task writes each of its files under a temporary name on the target's own
file system, hashes it, and looks at the recording's source once more.  What it
wrote is its commit message.  The commit, which gets the messages of the
attempts that won, first keeps copies of the files that it replaces, then moves
the new ones into place, and only then the manifest's parts: a job is published
if the manifest says so.  If any of that fails, the earlier contents come
back.  Files of failed tasks, of attempts that lost and of aborted runs never
had a name that anyone reads, and go with the run's folder.

The target is any file system that pyarrow opens by URI and that executors
share.  The driver handles names, sizes and hashes, never contents.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, MANIFEST = "spanloom_publish", "_manifest"
MANIFEST_SCHEMA = "run string, job string, fields map<string,string>, files array<struct<name:string,size:bigint,sha256:string>>, fault string"
#: Renames that a thread of the commit takes at once.
BLOCK = 64
CHANGED = "source changed while it was processed"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path on it."""
    return fs.FileSystem.from_uri(uri)


def snapshot(uri: str) -> str | None:
    """Size and time of a source, by which a change is told; null if it isn't there."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    return f"{info.size}:{info.mtime_ns}" if info.type == fs.FileType.File else None


@dataclass
class Written(WriterCommitMessage):
    """A task's files as (temporary path, name), and its part of the manifest."""

    files: list[tuple[str, str]] = field(default_factory=list)
    manifest: str | None = None


class PublishWriter(DataSourceWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def _paths(self) -> tuple[fs.FileSystem, str, str]:
        system, root = opened(self.root)
        return system, root, f"{root}/.publish-{self.run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """One attempt of a task; the rows of a job come one after the other."""
        system, _, folder = self._paths()
        out, lines = Written(), []
        folder = f"{folder}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        job: dict[str, Any] | None = None

        def close() -> None:
            if job is None:
                return
            # the last look at the source is after the job's files are there
            if job["source"] is not None and snapshot(job["source"]) != job["snapshot"]:
                job["fault"], kept = CHANGED, []
            else:
                kept = job["temps"]
            out.files.extend((temp, f["name"]) for temp, f in zip(kept, job["files"], strict=False))
            files = job["files"] if kept else []
            lines.append(json.dumps({"run": self.run, "job": job["job"], "fields": job["fields"], "files": files, "fault": job["fault"]}, ensure_ascii=False))

        for row in iterator:
            if job is None or row.job != job["job"]:
                close()
                job = {"job": row.job, "source": row.source, "snapshot": row.snapshot, "fields": row.fields, "files": [], "temps": [], "fault": None}
            if row.name is None:
                continue
            if row.name.startswith(("/", ".", MANIFEST)) or ".." in row.name.split("/"):
                raise ValueError(f"{row.name!r} is no name below the target")
            content, temp = bytes(row.content or b""), f"{folder}/{len(out.files)}-{len(lines)}-{len(job['temps'])}"
            with system.open_output_stream(temp) as f:
                f.write(content)
            job["temps"].append(temp)
            job["files"].append({"name": row.name, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()})
        close()
        if lines:
            out.manifest = f"{folder}/manifest"
            with system.open_output_stream(out.manifest) as f:
                f.write(("\n".join(lines) + "\n").encode())
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, root, folder = self._paths()
        messages = [m for m in messages if m is not None]
        moves = [(temp, f"{root}/{name}") for m in messages for temp, name in m.files]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two jobs have files of one name")
        parents = sorted({to.rpartition("/")[0] for _, to in moves} | {f"{root}/{MANIFEST}"})
        # a folder that wasn't there has no files to be replaced
        fresh = {p for p in parents if system.get_file_info(p).type == fs.FileType.NotFound}
        for parent in parents:
            system.create_dir(parent)
        old: dict[str, str] = {}
        done: list[str] = []

        def keep(k: int) -> None:
            to = moves[k][1]
            if system.get_file_info(to).type != fs.FileType.NotFound:
                old[to] = f"{folder}/old-{k}"
                system.copy_file(to, old[to])

        def move(pair: tuple[str, str]) -> None:
            system.move(*pair)
            done.append(pair[1])

        # a thread takes some at once, as handing out costs more than a rename
        blocks = lambda x: [x[k : k + BLOCK] for k in range(0, len(x), BLOCK)]
        each = lambda f: lambda block: [f(x) for x in block]

        try:
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(each(keep), blocks([k for k, (_, to) in enumerate(moves) if to.rpartition("/")[0] not in fresh])))
                list(pool.map(each(move), blocks(moves)))
            # what names the files as published comes last
            for k, m in enumerate(messages):
                if m.manifest:
                    move((m.manifest, f"{root}/{MANIFEST}/{self.run}-{k}.json"))
        except BaseException:
            for to in reversed(done):
                system.move(old[to], to) if to in old else system.delete_file(to)
            self.abort(messages)
            raise
        system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self._paths()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class PublishSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PublishWriter:
        return PublishWriter(self.options["path"], self.options["run"])


def publish(files: DataFrame, root: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Publish ``files(job, name, content[, source, snapshot])`` below ``root``; returns this run's manifest rows.

    ``name`` is a path below the root, ``content`` text or bytes (null: empty),
    ``source`` a URI and ``snapshot`` what :func:`snapshot` gave when it was
    read: a job whose source is another one now publishes nothing and has a
    fault.  ``fields`` are columns that the manifest keeps, such as keys.  A job
    of one row with a null name has no files.  Jobs of any number are one
    exchange on the job.
    """
    spark = files.sparkSession
    spark.dataSource.register(PublishSource)
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    optional = lambda c: F.col(c).cast("string") if c in files.columns else F.lit(None).cast("string")
    kept = F.create_map(*(x for c in fields for x in (F.lit(c), F.col(c).cast("string")))) if fields else F.expr("cast(map() as map<string,string>)")
    rows = files.select(F.col("job").cast("string").alias("job"), "name", F.col("content").cast("binary").alias("content"), optional("source").alias("source"), optional("snapshot").alias("snapshot"), kept.alias("fields"))
    rows = rows.repartition("job").sortWithinPartitions("job", "name")
    rows.write.format(FORMAT).option("run", run).mode("append").save(root)
    return manifest(spark, root, latest=False).filter(F.col("run") == run)


def manifest(spark: SparkSession, root: str, latest: bool = True) -> DataFrame:
    """``(run, job, fields, files, fault)`` of all published jobs: of each job's last run, unless all are asked for."""
    system, path = opened(root)
    if system.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.Directory:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}")
    if not latest:
        return rows
    # a run that left the job's earlier files as they were doesn't count
    last = Window.partitionBy("job").orderBy(F.desc("run"))
    return rows.filter("fault is null").withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")
