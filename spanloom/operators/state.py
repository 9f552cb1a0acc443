"""Contract keys, envelopes, checkpoints and published outputs."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class StateError(ValueError):
    """A state that can't be used."""


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and no escapes of letters; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def contract_key(settings: dict[str, Any]) -> str:
    """The SHA-256 of settings that results depend on."""
    return hashlib.sha256(canonical(settings).encode()).hexdigest()


def envelope(payload: Any) -> str:
    return canonical({"schema_version": SCHEMA_VERSION, "payload_sha256": contract_key(payload), "payload": payload})


def open_envelope(text: str) -> Any:
    """The payload of an envelope whose version and hash hold."""
    try:
        outer = json.loads(text)
        version, digest, payload = outer["schema_version"], outer["payload_sha256"], outer["payload"]
    except (ValueError, KeyError, TypeError) as e:
        raise StateError("state is unreadable") from e
    if version != SCHEMA_VERSION:
        raise StateError("state schema is unsupported")
    if digest != contract_key(payload):
        raise StateError("state integrity check failed")
    return payload


def opened_envelopes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``payload`` (canonical JSON) and ``fault`` in place of the envelopes in a column."""
    keep = [c for c in df.columns if c != column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            payload, fault = [], []
            for text in pdf[column]:
                try:
                    payload.append(canonical(open_envelope(text or "")))
                    fault.append(None)
                except StateError as e:
                    payload.append(None)
                    fault.append(str(e))
            yield pdf[keep].assign(payload=payload, fault=fault)

    return df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes if c != column) + ", payload string, fault string")


SEGMENTS = "array<struct<segment_index:bigint,start:double,end:double,speech:array<struct<start:double,end:double>>,text:string>>"
CHECKPOINT = f"struct<path:string,digest:string,asr_key:string,segments:{SEGMENTS}>"


def stored_checkpoints(rows: DataFrame) -> DataFrame:
    """``(path, state)``: an envelope for each row ``(path, digest, asr_key, segments)``, as text to be stored."""

    @F.pandas_udf("string")
    def sealed(payload: pd.Series) -> pd.Series:
        return payload.map(lambda t: envelope(json.loads(t)))

    return rows.select("path", sealed(F.to_json(F.struct("path", "digest", "asr_key", "segments"), {"ignoreNullFields": "false"})).alias("state"))


def read_checkpoints(stored: DataFrame, column: str = "state") -> tuple[DataFrame, DataFrame]:
    """``(path, digest, asr_key, segments)`` of the envelopes that hold, and the other rows with their ``fault``.

    A payload of another shape, or whose segments are out of order, outside
    their own bounds or overlapping, has a fault too: nothing of it is used.
    """
    opened = opened_envelopes(stored, column)
    opened = opened.withColumn("c", F.from_json("payload", CHECKPOINT))
    segments = F.col("c.segments")
    sound = F.forall(segments, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & x["text"].isNotNull() & (F.abs(x["end"]) < float("inf")))
    ordered = F.forall(F.zip_with(segments, F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), lambda a, b: F.coalesce((a["end"] <= b["start"] + 1e-6) & (a["segment_index"] < b["segment_index"]), F.lit(True))), lambda x: x)
    whole = F.col("c.path").isNotNull() & F.col("c.digest").isNotNull() & F.col("c.asr_key").isNotNull() & segments.isNotNull()
    fault = F.coalesce("fault", F.when(~F.coalesce(whole & sound & ordered, F.lit(False)), "checkpoint is not valid"))
    judged = opened.withColumn("fault", fault)
    return judged.filter("fault is null").select("c.*"), judged.filter("fault is not null").drop("c", "payload")


def _written(path: str, content: bytes) -> str:
    """A synced temporary file beside a path."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".publish-")
    with os.fdopen(fd, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    return temp


def publish(files: dict[str, str], manifest: str, manifest_text: str, check: Callable[[], None] | None = None) -> None:
    """Write files and then their manifest, each by an atomic rename; on a failure the earlier contents come back, last first.

    All contents are on disk before the first rename, and ``check`` runs between:
    it raises if the source is no longer what was read.
    """
    order = [*files, manifest]
    temps: dict[str, str] = {}
    done: list[tuple[str, bytes | None]] = []
    try:
        for path, text in zip(order, [*files.values(), manifest_text], strict=True):
            temps[path] = _written(path, text.encode())
        if check:
            check()
        for path in order:
            old = Path(path).read_bytes() if os.path.exists(path) else None
            os.replace(temps.pop(path), path)
            done.append((path, old))
        for folder in {os.path.dirname(p) or "." for p in order}:
            at = os.open(folder, os.O_RDONLY)
            try:
                os.fsync(at)
            finally:
                os.close(at)
    except BaseException:
        for path, old in reversed(done):
            if old is None:
                os.unlink(path)
            else:
                os.replace(_written(path, old), path)
        raise
    finally:
        for temp in temps.values():
            os.unlink(temp)


def verified(jobs: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The jobs whose published row agrees in all of ``keys``, nulls included: to be skipped."""
    return jobs.join(manifest.select(keys).distinct(), _same(jobs, manifest, keys), "left_semi")


def to_run(jobs: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The other jobs."""
    return jobs.join(manifest.select(keys).distinct(), _same(jobs, manifest, keys), "left_anti")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def resumed(jobs: DataFrame, checkpoints: DataFrame, key: str, valid: Column) -> DataFrame:
    """``jobs`` with the checkpoint's columns where it has a valid one, and ``loaded``."""
    got = checkpoints.filter(valid).withColumn("_l", F.lit(True))
    return jobs.join(got, key, "left").withColumn("loaded", F.coalesce("_l", F.lit(False))).drop("_l")


def existing_policy(policy: str, expected: Column, existing: Column, complete: Column) -> Column:
    """abort, skip or build, from how many of a job's outputs exist and whether they are complete and verified."""
    if policy not in ("error", "skip", "overwrite"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "error":
        return F.when(existing > 0, "abort").otherwise("build")
    if policy == "overwrite":
        return F.lit("build")
    return F.when((existing == expected) & complete, "skip").otherwise("build")
