"""Shared helpers of the training-data operators: the shared folder, staged tables and ordered buckets."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, local runs) is a temporary folder set up.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses (it isn't created)."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that Spark knows for its path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Kept(dict):
    """Keeps the bytes that ``make`` returns for short texts, in two generations bounded in bytes.

    A text that is asked for again moves to the newer generation; when that holds half of ``limit`` bytes, it becomes the
    older one, whose texts go. Texts over LONGEST characters are made anew each time.
    """

    LONGEST = 64

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.size, self.older = make, limit // 2, 0, {}

    def __missing__(self, text: str):
        if (out := self.older.get(text)) is None:
            out = self.make(text)
            if len(text) > self.LONGEST:
                return out
        if self.size >= self.limit:
            self.older, self.size = dict(self), 0
            self.clear()
        self[text] = out
        # about what Python takes for a key, a value and their place in the table
        self.size += 230 + len(text) + len(out)
        return out


class Stage:
    """Tables written as Parquet in the shared folder: they cut lineage and outlive a lost executor.

    ``keep`` writes a frame and returns it read again; ``drop`` deletes such a table once no later
    plan reads it.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, new_folder(spark, tag), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_stage_path", None):
                drop_folder(self.spark, path)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, each only where it is higher or unbounded.

    Spark reads these settings when a plan runs, so they stay lowered for the session's later plans.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < bytes_of(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def bytes_of(setting: str) -> int:
    """The number that a setting such as 8388608, 8m or 67108864b stands for."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", setting.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def map_frames(df: DataFrame, f, schema) -> DataFrame:
    """``mapInPandas`` with bounded batches, so that a worker, and the JVM's side of the exchange, hold a few megabytes of texts at a time."""
    bound_batches(df.sparkSession)
    return df.mapInPandas(f, schema)


def map_batches(df: DataFrame, f, schema) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def docs_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with those an operator adds."""
    return df.select(*[df[n] for n in names])


def held_out(doc_id: Column | str, fold: int = 5) -> Column:
    """True where crc32 of the id's text leaves no remainder: such rows are never learnt from.

    A null id counts as the text "" (crc32 0), so it is held out.
    """
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % fold == 0


def bounds_of(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that cut ``key`` into runs of about equal row counts.

    One map-side combined quantile sketch; only the bounds reach the driver.
    """
    if parts <= 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, shares, 20 * parts).alias("b")).first()["b"]
    return sorted(set(got or []))


def bucket_of(key: Column | str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= key (null keys: 0); two levels, so about 2 sqrt(n) comparisons."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = F.size(F.filter(long([b[0] for b in blocks]), lambda x: x <= key))
    inner = F.size(F.filter(F.get(F.array(*[long(b) for b in blocks]), block - 1), lambda x: x <= key))
    return F.when(key.isNull() | (block == 0), 0).otherwise((block - 1) * step + inner).cast("int")
