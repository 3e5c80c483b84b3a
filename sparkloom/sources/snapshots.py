"""Versioned tables: a rebuild writes a new version and then a manifest; readers keep the version they resolved.

    <path>/v-<id>/...              the rows of a version
    <path>/_manifest/<n>.json      {"version": "v-<id>"}: version n, published when it is whole

A manifest is created once and never changed, so of two rebuilds at a time each gets a number of its own, and a failed one
leaves no manifest. ``prune`` removes old versions when no reader needs them.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, rising."""
    at, store = _store(spark, f"{path}/_manifest")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in store.listStatus(at) if f.getPath().getName().endswith(".json")) if store.exists(at) else []


def publish(spark: SparkSession, path: str, version: str) -> int:
    """Makes a whole version the current one; its number."""
    while True:
        n = max(versions(spark, path), default=0) + 1
        at, store = _store(spark, f"{path}/_manifest/{n}.json")
        try:
            out = store.create(at, False)  # fails if another rebuild took the number
        except Exception:
            if store.exists(at):
                continue
            raise
        out.write(json.dumps({"version": version}).encode())
        out.close()
        return n


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Writes a new version of the table and publishes it; the version's number. Versions that readers hold stay as they are."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}") if partition_by else df.write.parquet(f"{path}/{version}")
    return publish(df.sparkSession, path, version)


def version_path(spark: SparkSession, path: str, n: int | None = None) -> str:
    """The folder of version n (None: the current one)."""
    known = versions(spark, path)
    if not known or (n is not None and n not in known):
        raise FileNotFoundError(f"{path} has no version {'' if n is None else n}")
    name = spark.read.text(f"{path}/_manifest/{known[-1] if n is None else n}.json", wholetext=True).first()[0]
    return f"{path}/{json.loads(name)['version']}"


def read_snapshot(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Version n (None: the current one) of the table; later rebuilds don't touch its rows."""
    return spark.read.parquet(version_path(spark, path, n))


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the last ``keep`` versions, their manifests first."""
    for n in versions(spark, path)[:-keep]:
        gone = version_path(spark, path, n)
        for p in (f"{path}/_manifest/{n}.json", gone):
            at, store = _store(spark, p)
            store.delete(at, True)
