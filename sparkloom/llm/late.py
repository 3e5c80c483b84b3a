"""Late rows overwrite the days they touch in a table of Parquet files, a folder a day; all other files stay as they are.

    <folder>/day=<d>/g<generation>-<file_no>.parquet     rows of day d in the order of (at, key), ``rows_per_file`` a file

A table keeps of each key the row that arrived last. ``LateTable.overwrite`` takes further rows:

1. Spark finds the latest incoming row of each key (combined on the map side, so a hot key is one row a task) and meets it
   with the key and arrival columns of the standing files in one sort-merge join. A row that wins goes into its own day and
   takes the standing row of its key out of the day where that lies; those days are dirty.
2. Each dirty day is one unit of work of an executor's DuckDB under a memory limit: it reads the day's old files as a stream,
   anti-joins the outgoing keys, adds the incoming rows, sorts with an external ORDER BY, numbers the rows, and exports each
   slice of ``rows_per_file`` rows as a file under a name of its own attempt. The list of files is written as a table.
3. When every day is written, the days' new files get their names and all others in those folders go.

Nothing is removed before step 3, and step 3 may be repeated, so a lost executor costs its own days only. Rows reach DuckDB
and the files in Arrow batches; no day is held in memory, and neither the driver nor a broadcast holds rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import Stage, drop_folder, map_batches, new_folder
from sparkloom.llm.bitplanes import open_store

#: What one executor's DuckDB may hold before it spills; rows of an Arrow batch.
MEMORY, BATCH = "400MB", 1 << 14
WRITTEN = "day long, part string, file string, n_rows long"


def day_of(at: Column) -> Column:
    """Whole days since 1970 (null: -1)."""
    return F.coalesce(F.unix_date(at.cast("date")), F.lit(-1)).cast("long")


def names(folder: str, store, day: int, generation: int | None = None) -> list[str]:
    """The paths of a day's files, in order; of one generation if given."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(f"{folder}/day={day}", allow_not_found=True))
    start = "g" if generation is None else f"g{generation}-"
    return sorted(f.path for f in found if f.is_file and f.base_name.startswith(start) and f.base_name.endswith(".parquet"))


class LateTable:
    """A table of days in ``folder``; ``key``, ``at`` and ``arrived`` name the columns of identity, order and arrival.

    Rows with a null ``at`` make the day -1; a null key is a key like any other; a null arrival is earlier than any other.
    Of rows of one key with the same arrival in one call the greatest by the other columns in their order stays; a row that
    stands stays against a row with the same arrival. Repeated rows count once. An empty set of rows changes no file.
    Columns whose names clash with those used here are kept as they are.
    """

    def __init__(self, spark: SparkSession, folder: str, rows_per_file: int, key: str = "sale_id", at: str = "sold_at", arrived: str = "arrived_at"):
        if rows_per_file < 1:
            raise ValueError("rows_per_file must be at least 1")
        self.spark, self.folder, self.rows_per_file = spark, folder.rstrip("/"), rows_per_file
        self.key, self.at, self.arrived, self.generation = key, at, arrived, 0

    def latest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row that arrived last: (k, row)."""
        rest = [c for c in rows.columns if c not in (self.key, self.arrived)]
        order = F.struct(rows[self.arrived].alias("_1"), *[rows[c].alias(f"_{i}") for i, c in enumerate(rest, 2)])
        best = rows.groupBy(rows[self.key].alias("k")).agg(F.max(order).alias("r"))
        at = {self.key: F.col("k"), self.arrived: F.col("r._1")} | {c: F.col(f"r._{i}") for i, c in enumerate(rest, 2)}
        return best.select("k", F.struct(*[at[c].alias(c) for c in rows.columns]).alias("row"))

    def standing(self, schema) -> DataFrame:
        """Key, arrival and day of every row that stands: (k, a, d)."""
        files = self.spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "g*.parquet").parquet(self.folder)
        day = F.regexp_extract(F.col("_metadata.file_path"), r"day=(-?\d+)", 1).cast("long")
        return files.select(files[self.key].alias("k"), files[self.arrived].alias("a"), day.alias("d"))

    def changes(self, rows: DataFrame) -> DataFrame:
        """What a call changes: (day, out, row): a row that comes in, or one whose key goes out."""
        won = self.latest(rows)
        into = F.struct(day_of(F.col("row")[self.at]).alias("day"), F.lit(False).alias("out"), F.col("row"))
        if not self.generation:
            return won.select(into.alias("c")).select("c.*")
        here = self.standing(rows.schema)
        met = won.join(here.hint("merge"), won["k"].eqNullSafe(here["k"]), "left").drop(here["k"])
        gone = F.struct(F.col("d").alias("day"), F.lit(True).alias("out"), F.col("row"))
        wins = F.col("d").isNull() | (F.col("row")[self.arrived] > F.col("a")) | (F.col("a").isNull() & F.col("row")[self.arrived].isNotNull())
        both = F.when(F.col("d").isNull(), F.array(into)).otherwise(F.array(into, gone))
        return met.filter(wins).select(F.explode(both).alias("c")).select("c.*")

    def overwrite(self, rows: DataFrame) -> None:
        """Makes the table that of all rows it has been given and these."""
        stage, generation = Stage(self.spark, "late"), self.generation + 1
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.changes(rows).repartition(parts, "day").sortWithinPartitions("day").select("day", "out", "row.*")
        clean = dealt.toDF("day", "out", *[f"c{i}" for i in range(len(rows.columns))])
        work = DayWriter(self.folder, self.rows_per_file, generation, rows.columns, self.key, self.at)
        written = stage.keep(map_batches(clean, work.run, WRITTEN))
        published = written.groupBy("day").applyInPandas(lambda files: work.publish(files), "day long")
        published.write.format("noop").mode("overwrite").save()
        stage.drop(written)
        drop_folder(self.spark, f"{self.folder}/_scratch")
        self.generation = generation

    def files(self) -> DataFrame:
        """Every file: day, file_no, generation, path."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "g*.parquet").load(self.folder)
        part = lambda p: F.regexp_extract("path", p, 1).cast("long")
        return found.select(part(r"/day=(-?\d+)/").alias("day"), part(r"/g\d+-(\d+)\.parquet$").alias("file_no"), part(r"/g(\d+)-\d+\.parquet$").alias("generation"), "path")


class DayWriter:
    """The work on one dirty day in an executor's DuckDB, and the change of its names."""

    def __init__(self, folder: str, rows_per_file: int, generation: int, columns: list[str], key: str, at: str):
        self.folder, self.rows_per_file, self.generation, self.columns = folder, rows_per_file, generation, columns
        self.key, self.at = f"c{columns.index(key)}", f"c{columns.index(at)}"

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for b in batches:
                days = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(days)) + 1).tolist(), len(days)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi > lo:
                        yield int(days[lo]), b.slice(lo, hi - lo)

        for day, parts in groupby(slices(), lambda x: x[0]):
            rows = self.rewrite(day, (b for _, b in parts)) or [(day, None, None, 0)]
            yield pa.RecordBatch.from_pylist([dict(zip(("day", "part", "file", "n_rows"), r)) for r in rows], pa.schema([("day", pa.int64()), ("part", pa.string()), ("file", pa.string()), ("n_rows", pa.int64())]))

    def old_rows(self, store, paths: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for path in paths:
            with store.open_input_file(path) as f:
                for b in pq.ParquetFile(f, pre_buffer=False).iter_batches(BATCH):
                    yield pa.RecordBatch.from_arrays([a.cast(t.type) for a, t in zip(b.columns, schema)], schema=schema)

    def rewrite(self, day: int, changes: Iterator[pa.RecordBatch]) -> list[tuple[int, str, str, int]]:
        """Writes the day's new files under names of this attempt: (day, attempt's name, name, rows)."""
        import duckdb
        import pyarrow.parquet as pq

        store, root = open_store(self.folder)
        attempt, first = uuid.uuid4().hex, next(changes)
        inner = pa.schema([pa.field(f"c{i}", f.type) for i, f in enumerate(list(first.schema)[2:])])
        outer = pa.schema([pa.field(n, f.type) for n, f in zip(self.columns, inner)])

        def all_changes():
            yield first
            yield from changes

        scratch = f"{root}/_scratch/{attempt}"  # where DuckDB spills; a store that isn't a file system allows no spilling
        store.create_dir(f"{root}/_scratch", recursive=True)
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY} | ({"temp_directory": scratch} if self.folder.startswith(("file:", "/")) else {}))
        out = []
        try:
            con.register("changes", pa.RecordBatchReader.from_batches(first.schema, all_changes()))
            con.execute("CREATE TEMP TABLE delta AS SELECT * FROM changes").fetchall()
            con.register("old", pa.RecordBatchReader.from_batches(inner, self.old_rows(store, names(root, store, day), inner)))
            cols = ", ".join(inner.names)
            con.execute(f"""CREATE TEMP TABLE sorted AS SELECT {cols}, row_number() OVER () - 1 AS place FROM (
                SELECT {cols} FROM old WHERE NOT EXISTS (SELECT 1 FROM delta d WHERE d.out AND d.{self.key} IS NOT DISTINCT FROM old.{self.key})
                UNION ALL SELECT {cols} FROM delta WHERE NOT out ORDER BY {self.at} NULLS FIRST, {self.key} NULLS FIRST)""").fetchall()  # fmt: skip
            ((n,),) = con.execute("SELECT count(*) FROM sorted").fetchall()
            for file_no, lo in enumerate(range(0, n, self.rows_per_file)):
                hi = min(n, lo + self.rows_per_file)
                part, file = f"{root}/day={day}/_{attempt}-{file_no:07d}.part", f"{root}/day={day}/g{self.generation}-{file_no:07d}.parquet"
                store.create_dir(f"{root}/day={day}", recursive=True)
                with store.open_output_stream(part) as sink, pq.ParquetWriter(sink, outer) as to:
                    for b in con.sql(f"SELECT {cols} FROM sorted WHERE place >= {lo} AND place < {hi} ORDER BY place").to_arrow_reader(BATCH):
                        to.write_batch(pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(b.columns, outer)], schema=outer))
                out.append((day, part, file, hi - lo))
        finally:
            con.close()
        return out

    def publish(self, files: pd.DataFrame) -> pd.DataFrame:
        """Gives a day's new files their names and removes all others in its folder; doing it again changes nothing."""
        from pyarrow import fs

        store, root = open_store(self.folder)
        day, kept = int(files["day"].iloc[0]), set()
        for part, file in zip(files["part"], files["file"], strict=True):
            if file is not None:
                kept.add(file)
                if store.get_file_info(part).type != fs.FileType.NotFound:
                    store.move(part, file)
        found = store.get_file_info(fs.FileSelector(f"{root}/day={day}", allow_not_found=True))
        for f in found:
            if f.path not in kept:
                store.delete_file(f.path)
        if found and not kept:
            store.delete_dir(f"{root}/day={day}")
        return pd.DataFrame({"day": [day]})


REPORT = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean"


def file_report(table: LateTable, total: str = "total") -> DataFrame:
    """One row a file, read from the file in batches: see REPORT. A total that is null or no number counts 0 cents."""
    key, at, arrived = table.key, table.at, table.arrived

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        text = lambda a: ["" if x is None else str(x) for x in a.to_pylist()]
        micros = lambda a: text(a.cast(pa.timestamp("us")).cast(pa.int64()))
        for batch in batches:
            rows = []
            for day, file_no, generation, path in batch[["day", "file_no", "generation", "path"]].itertuples(index=False):
                store, at_ = open_store(path)
                with store.open_input_file(at_) as f:
                    file = pq.ParquetFile(f, pre_buffer=False)
                    n = cents = crc = 0
                    ids = hashlib.sha256()
                    for b in file.iter_batches(BATCH):
                        keys = text(b.column(key))
                        ids.update(("," if n else "").encode() + ",".join(keys).encode())
                        n += len(keys)
                        crc += sum(zlib.crc32(":".join(x).encode()) for x in zip(keys, micros(b.column(at)), micros(b.column(arrived)), strict=True))
                        sums = np.floor(100 * b.column(total).to_numpy(zero_copy_only=False).astype(float) + 0.5)
                        cents += int(sums[np.isfinite(sums)].astype(np.int64).sum())
                    rows.append((day, file_no, n, cents, crc, path, ",".join(file.schema_arrow.names), ids.hexdigest(), generation > 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    parts = int(table.spark.conf.get("spark.sql.shuffle.partitions"))
    return table.files().repartition(parts, "path").mapInPandas(read, REPORT)


EARLY = "2024-03-20 00:00:00"


def with_copies(sales: DataFrame) -> DataFrame:
    """The rows and the contract's copies: rows of every third hash and fourth day once more, changed and later."""
    h = F.crc32(F.coalesce(sales["sale_id"].cast("string"), F.lit("")))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    copied = sales.filter((h % 3 == 0) & (F.pmod(day_of(sales["sold_at"]), F.lit(4)) == 0))
    new = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    return sales.unionByName(copied.select(*[(new[c] if c in new else F.col(c)).cast(sales.schema[c].dataType).alias(c) for c in sales.columns]))


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the table of early sales, overwritten by the late ones; a row a final file."""
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    table = LateTable(spark, new_folder(spark, "sales"), 1 + sales.count() // 1100)
    rows, early = with_copies(sales), F.coalesce(F.col("arrived_at") < F.lit(EARLY).cast("timestamp_ntz"), F.lit(False))
    table.overwrite(rows.filter(early))
    table.overwrite(rows.filter(~early))
    return file_report(table)
