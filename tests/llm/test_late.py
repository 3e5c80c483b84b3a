"""Late rows against a plain rebuild, untouched files byte for byte, and odd rows."""

import datetime as dt
import glob
import hashlib
import math
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA

START, CUT = dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 20)
COLUMNS = "sale_id client_id status total sold_at arrived_at priority".split()
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def day(at):
    return -1 if at is None else (at - START) // dt.timedelta(days=1)


def layout(rows, size):
    """(day, file_no) to rows: the latest of each sale, a day in order, cut into files."""
    last = {}
    for r in rows:
        order = (r[5] is not None, r[5] or START)
        if r[0] not in last or order > last[r[0]][0]:
            last[r[0]] = (order, r)
    days = {}
    for _, r in last.values():
        days.setdefault(day(r[4]), []).append(r)
    out = {}
    for d, rs in days.items():
        rs.sort(key=lambda r: (r[4] is not None, r[4] or START, r[0] is not None, r[0] or 0))
        out |= {(d, i // size): rs[i : i + size] for i in range(0, len(rs), size)}
    return out, {k: r for k, (_, r) in last.items()}


def copies(rows):
    out = list(rows)
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        if h % 3 == 0 and day(r[4]) % 4 == 0:
            later = r[5] and r[5] + dt.timedelta(days=1 + h % 97)
            out.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + dt.timedelta(days=h % 2), later, r[6]))
    return out


def dirty(before, after, late):
    """Days in which a kept late row stands, or its sale stood at the start."""
    kept = [r for r in after.values() if r in late]
    return {day(r[4]) for r in kept} | {day(before[r[0]][4]) for r in kept if r[0] in before}


def as_row(d, no, rs, path, rewritten):
    micros = lambda x: "" if x is None else str((x - START) // dt.timedelta(microseconds=1))
    ids = ["" if r[0] is None else str(r[0]) for r in rs]
    return (d, no, len(rs), sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in rs), sum(zlib.crc32(f"{i}:{micros(r[4])}:{micros(r[5])}".encode()) for i, r in zip(ids, rs)), path, ",".join(COLUMNS), hashlib.sha256(",".join(ids).encode()).hexdigest(), rewritten)


def test_query_equals_a_plain_rebuild(spark):
    from sparkloom.llm.late import op12_late_overwrite

    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{DATA}/sales.parquet").collect()]
    size, every = 1 + len(rows) // 1100, copies(rows)
    late = {r for r in every if r[5] is None or r[5] >= CUT}
    _, before = layout([r for r in every if r not in late], size)
    files, after = layout(every, size)
    touched = dirty(before, after, late)
    got = {(r["day"], r["file_no"]): tuple(r) for r in op12_late_overwrite(spark, DATA).collect()}
    assert got == {(d, no): as_row(d, no, rs, got[d, no][5], d in touched) for (d, no), rs in files.items()}
    assert {r[8] for r in got.values()} == {True, False}
    folder = next(iter(got.values()))[5].removeprefix("file:").rsplit("/", 2)[0]
    assert {p for p in glob.glob(f"{folder}/**/*", recursive=True) if "." in p.rsplit("/", 1)[1]} == {r[5].removeprefix("file://").removeprefix("file:") for r in got.values()}


A, B = dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 6)
WHEN = lambda n: dt.datetime(2024, 2, 1) + dt.timedelta(hours=n)
FIRST = [(1, 1, "a", 1.0, A, WHEN(1), 1), (2, 1, "a", 2.0, A, WHEN(1), 1), (3, 1, None, None, None, WHEN(1), None), (4, 1, "d", 4.0, B, WHEN(1), 1), (4, 1, "d", 4.0, B, WHEN(1), 1), (None, 1, "n", 5.0, B, WHEN(1), 1), (5, 1, "z", 1.5, dt.datetime(1969, 12, 30, 23), WHEN(1), 1), (6, 1, "t", 1.0, A, None, 1)]
LATER = [(1, 9, "moved", 7.0, B, WHEN(2), 2), (2, 9, "older", 7.0, B, WHEN(0), 2), (None, 9, "again", 8.0, dt.datetime(2024, 1, 3), WHEN(2), 2), (7, 9, "new", 9.0, None, WHEN(3), 2), (7, 9, "hot", 9.0, None, WHEN(2), 2), (6, 9, "dated", 1.0, A, WHEN(2), 1), (8, 9, "no date", 1.0, A, None, 1)]


def files_of(folder):
    return {p: (open(p, "rb").read(), pq.ParquetFile(p).read()) for p in glob.glob(f"{folder}/day=*/*.parquet")}


@pytest.mark.parametrize("size", [1, 2, 100])
def test_overwrites_dirty_days_alone(spark, tmp_path, size):
    from sparkloom.llm.late import LateTable

    table = LateTable(spark, f"file://{tmp_path}/t", size)
    table.overwrite(spark.createDataFrame(FIRST, SCHEMA))
    start = files_of(f"{tmp_path}/t")
    table.overwrite(spark.createDataFrame(LATER, SCHEMA))
    end = files_of(f"{tmp_path}/t")
    before, after = layout(FIRST, size)[1], layout([*FIRST, *LATER], size)
    touched = dirty(before, after[1], set(LATER))
    got = {}
    for p, (_, rows) in end.items():
        assert rows.column_names == COLUMNS
        d = int(p.split("day=")[1].split("/")[0])
        got[d, int(p.rsplit("-", 1)[1].removesuffix(".parquet"))] = [tuple(r.values()) for r in rows.to_pylist()]
        assert (p in start and start[p][0] == end[p][0]) == (d not in touched)
    assert got == after[0]
    table.overwrite(spark.createDataFrame([], SCHEMA))
    assert {p: x[0] for p, x in files_of(f"{tmp_path}/t").items()} == {p: x[0] for p, x in end.items()}
    table.overwrite(spark.createDataFrame([*LATER, *FIRST], SCHEMA))
    assert {p: x[0] for p, x in files_of(f"{tmp_path}/t").items()} == {p: x[0] for p, x in end.items()}


def test_a_day_that_empties_and_clashing_names(spark, tmp_path):
    from sparkloom.llm.late import LateTable

    names = ["day", "out", "c0", "place", "k"]
    schema = "day long, out timestamp_ntz, c0 timestamp_ntz, place string, k int"
    table = LateTable(spark, f"file://{tmp_path}/t", 2, key="day", at="out", arrived="c0")
    table.overwrite(spark.createDataFrame([(1, A, WHEN(0), "x", 1)], schema))
    table.overwrite(spark.createDataFrame([(1, B, WHEN(1), "y", 2)], schema))
    (path, (_, rows)), = files_of(f"{tmp_path}/t").items()
    assert f"day={day(B)}/" in path and rows.column_names == names and rows.to_pylist() == [dict(zip(names, (1, B, WHEN(1), "y", 2)))]
    assert not glob.glob(f"{tmp_path}/t/day={day(A)}*")
    nothing = LateTable(spark, f"file://{tmp_path}/e", 2)
    nothing.overwrite(spark.createDataFrame([], SCHEMA))
    assert not files_of(f"{tmp_path}/e")


def test_a_day_larger_than_memory_spills(spark, tmp_path, monkeypatch):
    from sparkloom.llm import late

    monkeypatch.setattr(late, "MEMORY", "40MB")
    n = 400_000
    rows = spark.range(n).select(F.col("id").alias("sale_id"), F.lit(1).cast("long").alias("client_id"), F.sha2(F.col("id").cast("string"), 256).alias("status"), F.rand(1).alias("total"), F.lit(A).cast("timestamp_ntz").alias("sold_at"), F.lit(B).cast("timestamp_ntz").alias("arrived_at"), F.lit(1).alias("priority"))
    work = late.DayWriter(f"file://{tmp_path}/t", 150_000, 1, COLUMNS, "sale_id", "sold_at")
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pandas(rows.filter(f"sale_id % 20 = {i}").select(F.lit(19723).cast("long").alias("day"), F.lit(False).alias("out"), *rows.columns).toPandas(), preserve_index=False).rename_columns(["day", "out", *[f"c{j}" for j in range(7)]]) for i in range(20)]
    out = [r for b in work.run(iter(batches)) for r in b.to_pylist()]
    assert [r["n_rows"] for r in out] == [150_000, 150_000, 100_000]
    assert [i for r in out for i in pq.ParquetFile(r["part"]).read().column("sale_id").to_pylist()] == list(range(n))
