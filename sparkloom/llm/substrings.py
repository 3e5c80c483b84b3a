"""Passages of WINDOW words or more that stand anywhere else are cut out of documents, by FM-indexes over shards.

How the windows that must meet come into one shard, without moving whole texts:

1. Texts are written once as files. Beside each text lie its segments: the least hash of the GRAM-word runs in a window is the
   window's mark, and neighbouring windows with one mark are a segment. Equal windows have equal marks.
2. Of the segments only (mark, hash, place) is dealt, by mark; equal ones are combined in the task that reads them and again
   after the exchange. The one segment of a mark can't hold a repeated window unless its own words hold the mark twice; else it goes.
3. Of each different segment left one copy is cut from the files and dealt by mark to shards. A mark with more than HOT
   different segments (a common line in many contexts) is dealt once more, by the next mark of its windows.
4. A shard is a compressed FM-index (``fmindex``) of its segments, weighted by their copies. All its segments are streamed
   against it by backward search; intervals of windows that stand twice or more come back as (mark, hash, from, to).
5. They meet the segments' places in one join, are dealt to the files they belong to, and the files are read a last time.

Texts move through no exchange; what is exchanged are segments' hashes, and one copy of each segment that may be repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import docs_only, map_batches, map_frames, new_folder
from sparkloom.llm.bitplanes import open_store
from sparkloom.llm.fmindex import FmIndex

#: Words of a window and of the runs that mark it; windows of a segment at most (with WINDOW 35 it has up to 128 words).
WINDOW, GRAM, MOST = 35, 8, 94
#: Different segments of one mark from which its windows are dealt by two marks; words of a shard's index, about.
HOT, SHARD_WORDS = 512, 1 << 19
#: Bytes whose words are hashed at once; windows that are marked at once; segments that are combined at once.
PIECE, AT_ONCE, COMBINED = 4 << 20, 1 << 19, 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SEGMENT = np.dtype([("m", "<i8"), ("s", "<i8"), ("at", "<u4"), ("w", "u1"), ("own", "?")])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * K2
    h = (h ^ (h >> np.uint64(27))) * K3
    return h ^ (h >> np.uint64(31))


def word_places(raw: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of UTF-8 bytes: runs without blank and \\t to \\r."""
    space = SPACES[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time."""
    at, left = word_places(raw)
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    h, live = left.astype(np.uint64) * K1, np.arange(len(at))
    while len(live):
        n = np.minimum(left[live], 8)
        h[live] = mix(h[live] ^ (eights[at[live]] & LOW[n])) * K1
        at[live] += n
        left[live] -= n
        live = live[left[live] > 0]
    return mix(h)


def pieces(raw: bytes) -> Iterator[bytes]:
    """Bytes cut after a white space, PIECE bytes or a longer word at a time."""
    lo, size = 0, PIECE
    while lo < len(raw):
        part = raw[lo : lo + size]
        if lo + len(part) < len(raw):
            space = np.flatnonzero(SPACES[np.frombuffer(part, np.uint8)])
            if not len(space):
                size *= 2
                continue
            part = part[: space[-1] + 1]
        yield part
        lo, size = lo + len(part), PIECE


def runs(h: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... up to n words."""
    out, k, base = {1: h}, 1, K1
    while 2 * k <= n and len(h) > k:
        h = mix(h[:-k] * base + h[k:])
        k *= 2
        out[k] = h
    return out


def window_marks(g: np.ndarray, window: int, gram: int, but: np.ndarray | None = None) -> np.ndarray:
    """The least of the hashes of runs in every window; ``but``: a hash a window that doesn't count there."""
    n = window - gram + 1
    if but is not None:
        views = np.lib.stride_tricks.sliding_window_view(g, n)
        return np.where(views == but[:, None], np.uint64(2**64 - 1), views).min(axis=1)
    low, k = g, 1
    while 2 * k <= n:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    return low if n == k else np.minimum(low[: len(low) - (n - k)], low[n - k :])


def cut_segments(h: np.ndarray, counts: np.ndarray, window: int, gram: int, most: int) -> list[np.ndarray]:
    """The segments of texts whose words' hashes lie side by side, ``counts`` words each; an array a text."""
    ends = np.cumsum(counts)
    first = ends - counts
    total, out = len(h), [[] for _ in counts]
    for lo in range(0, total - window + 1, AT_ONCE):
        hi = min(total, lo + AT_ONCE + window - 1)
        r = runs(h[lo:hi], most + window)
        marks = window_marks(r[gram], window, gram)
        places = np.arange(lo, lo + len(marks))
        text = np.searchsorted(ends, places, side="right")
        inside = places + window <= ends[text]
        new = np.concatenate([[True], (marks[1:] != marks[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])])
        new |= (np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))) % most == 0
        at = np.flatnonzero(new)
        w = np.diff(np.append(at, len(new)))
        at, w = at[inside[at]], w[inside[at]]
        if not len(at):
            continue
        seg = np.empty(len(at), SEGMENT)
        size = w + window - 1
        top = np.left_shift(1, np.floor(np.log2(size)).astype(np.int64))
        s = np.empty(len(at), np.uint64)
        for k in np.unique(top):
            x = top == k
            s[x] = mix(r[int(k)][at[x]] * K2 + mix(r[int(k)][at[x] + size[x] - k] + size[x].astype(np.uint64)))
        owner = text[at]
        seg["m"], seg["s"], seg["w"] = marks[at].view(np.int64), s.view(np.int64), w
        seg["at"] = lo + at - first[owner]
        # whether the mark stands more than once in the segment's own words, without which no window can repeat in it
        size = w + window - gram
        before = np.cumsum(size) - size
        own = r[gram][np.repeat(at - before, size) + np.arange(before[-1] + size[-1])] == np.repeat(marks[at], size)
        seg["own"] = np.add.reduceat(own, before, dtype=np.int64) > 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part, o in zip(np.split(seg, cuts), owner[np.concatenate([[0], cuts])], strict=True):
            out[o].append(part)
    return [np.concatenate(x) if x else np.zeros(0, SEGMENT) for x in out]


def text_segments(texts: list[str], window: int, gram: int, most: int) -> Iterator[tuple[int, bytes]]:
    """Words and packed segments of every text; short texts are worked on together."""

    def done(group: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        counts = np.array([len(h) for h in group], np.int64)
        with np.errstate(over="ignore"):
            cut = cut_segments(np.concatenate(group), counts, window, gram, most)
        yield from ((int(n), x.tobytes()) for n, x in zip(counts, cut, strict=True))

    small: list[bytes] = []

    def together() -> list[np.ndarray]:
        """Hashes of the small texts, made from their bytes in one go."""
        raw = b" ".join(small)
        h, at = word_hashes(raw), word_places(raw)[0]
        ends = np.cumsum([len(x) + 1 for x in small])
        return np.split(h, np.searchsorted(at, ends[:-1]))

    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > PIECE // 4:
            if small:
                yield from done(together())
                small, size = [], 0
            yield from done([np.concatenate([np.zeros(0, np.uint64), *map(word_hashes, pieces(raw))])])
            continue
        small.append(raw)
        size += len(raw)
        if size > PIECE:
            yield from done(together())
            small, size = [], 0
    if small:
        yield from done(together())


class Texts:
    """The written texts: one Parquet file a task, named by its number; a row's place is (file, row)."""

    def __init__(self, docs: DataFrame, key: str, text: str, folder: str, window: int, gram: int, most: int):
        kind = docs.schema[key].dataType.simpleString()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = list(text_segments(b.column(1).to_pylist(), window, gram, most))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["k", "t", "n", "segs"])

        self.spark, self.folder = docs.sparkSession, folder
        map_batches(docs_only(docs, key, text).toDF("k", "t"), cut, f"k {kind}, t string, n long, segs binary").write.option("maxRecordsPerFile", 0).parquet(folder)
        self.table = self.spark.read.schema(f"k {kind}, t string, n long, segs binary").parquet(folder)
        name = F.col("_metadata.file_name")
        self.place = (F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long"), F.col("_metadata.row_index"))
        some = self.table.select(name.alias("f")).first()
        self.name = re.fullmatch(r"(part-)\d+(-.*-c000.*)", some["f"]).groups() if some else ("", "")

    def path(self, number: int) -> str:
        return f"{self.folder}/{self.name[0]}{number:05d}{self.name[1]}"

    def rows(self, number: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """A file's rows, a batch at a time, in their order."""
        import pyarrow.parquet as pq

        store, path = open_store(self.path(number))
        with store.open_input_file(path) as f:
            yield from pq.ParquetFile(f, pre_buffer=False).iter_batches(256, columns=columns)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows (file, row, ...) brought to one task a few files, in the order of the files' rows."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return rows.repartitionById(parts, F.pmod("file", F.lit(parts)).cast("int")).sortWithinPartitions("file", "row", "at")

    def reader(self):
        """What a task needs to read the files, without the session."""
        out = object.__new__(Texts)
        out.folder, out.name = self.folder, self.name
        return out


def occurrences(texts: Texts, combined: bool) -> DataFrame:
    """Every segment: (m, s, n, file, row, at, w, own); ``combined``: equal ones that a task reads together are one row with their number n."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            seg = np.concatenate([np.frombuffer(x, SEGMENT) for _, _, x in held])
            times = [len(x) // SEGMENT.itemsize for _, _, x in held]
            x = pd.DataFrame({"m": seg["m"], "s": seg["s"], "n": np.ones(len(seg), np.int64), "file": np.repeat([f for f, _, _ in held], times), "row": np.repeat([r for _, r, _ in held], times), "at": seg["at"].astype(np.int64), "w": seg["w"].astype(np.int32), "own": seg["own"]})
            if combined:
                order = np.lexsort((x["s"], x["m"]))
                x = x.iloc[order]
                new = np.concatenate([[True], (np.diff(x["m"]) != 0) | (np.diff(x["s"]) != 0)])
                at = np.flatnonzero(new)
                x = x.iloc[at].assign(n=np.diff(np.append(at, len(new))))
            return x

        for b in batches:
            for row in zip(b["file"], b["row"], b["segs"], strict=True):
                held.append(row)
                size += len(row[2]) // SEGMENT.itemsize
                if size >= (COMBINED if combined else COMBINED // 16):
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    file, row = texts.place
    rows = texts.table.filter(F.octet_length("segs") > 0).select(file.alias("file"), row.alias("row"), "segs")
    return map_frames(rows, unpack, "m long, s long, n long, file long, row long, at long, w int, own boolean")


def candidates(texts: Texts) -> DataFrame:
    """One copy of each different segment whose mark has more than one segment, or stands twice in it: (m, s, n, hot, file, row, at, w, own)."""
    rows = occurrences(texts, True).repartition("m")
    each = rows.groupBy("m", "s").agg(F.sum("n").alias("n"), F.min(F.struct("file", "row", "at", "w", "own")).alias("o"))
    of_mark = Window.partitionBy("m")
    each = each.select("m", "s", "n", "o", F.sum("n").over(of_mark).alias("all"), F.count("*").over(of_mark).alias("kinds"))
    return each.filter("all > 1 OR o.own").select("m", "s", "n", (F.col("kinds") > HOT).alias("hot"), "o.*")


def copies(texts: Texts, chosen: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of the chosen segments, from the files: (route, m, s, off, n, words); a hot one in parts with two marks."""
    read = texts.reader()

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = (r for b in batches for r in b[["file", "row", "m", "s", "n", "hot", "at", "w"]].itertuples(index=False, name=None))
        out, size = [], 0
        for number, of_file in groupby(wanted, lambda r: r[0]):
            texts_of = ((i, t) for i, t in enumerate(t for b in read.rows(number, ["t"]) for t in b.column(0).to_pylist()))
            for row, of_row in groupby(of_file, lambda r: r[1]):
                text = next(t for i, t in texts_of if i == row).encode("utf-8", "surrogatepass")
                starts, lengths = word_places(text)
                for _, _, m, s, n, hot, at, w in of_row:
                    last = at + w + window - 2
                    words = text[starts[at] : starts[last] + lengths[last]].split()
                    for route, off, part in parts_of(words, m, window, gram) if hot else ((m, 0, words),):
                        out.append((route, m, s, off, n, b" ".join(part)))
                        size += len(out[-1][5])
                    if size > PIECE:
                        yield pd.DataFrame(out, columns=COPY)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=COPY)

    return map_frames(texts.dealt(chosen), fetch, "route long, m long, s long, off long, n long, words binary")


COPY = ["route", "m", "s", "off", "n", "words"]


def parts_of(words: list[bytes], mark: int, window: int, gram: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """A segment in runs of windows whose next mark beside ``mark`` is one: (route, first window, words)."""
    with np.errstate(over="ignore"):
        g = runs(word_hashes(b" ".join(words)), gram)[gram]
        own = np.full(len(words) - window + 1, mark, np.int64).view(np.uint64)
        nxt = mix(window_marks(g, window, gram, own) ^ (own * K3))
    cuts = [0, *(np.flatnonzero(np.diff(nxt)) + 1).tolist(), len(nxt)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield int(nxt[lo : lo + 1].view(np.int64)[0]), lo, words[lo : hi + window - 1]


def repeated_parts(rows: DataFrame, window: int) -> DataFrame:
    """Word intervals of segments whose windows stand twice or more in their shard: (m, s, lo, hi)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, route = [], 0, None
        for b in batches:
            for r in b[COPY].itertuples(index=False, name=None):
                if size >= SHARD_WORDS and r[0] != route:
                    yield of_shard(held, window)
                    held, size = [], 0
                held.append(r)
                size += r[5].count(b" ") + 1
                route = r[0]
        if held:
            yield of_shard(held, window)

    return map_frames(rows.repartition("route").sortWithinPartitions("route"), search, "m long, s long, lo long, hi long")


def of_shard(rows: list[tuple], window: int) -> pd.DataFrame:
    index = FmIndex([r[5].split(b" ") for r in rows], np.array([r[4] for r in rows]))
    marks = index.repeated(window)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    owner = np.searchsorted(index.starts, lo, side="right") - 1
    off = np.array([r[3] for r in rows], np.int64)[owner] - index.starts[owner]
    return pd.DataFrame({"m": np.array([r[1] for r in rows], np.int64)[owner], "s": np.array([r[2] for r in rows], np.int64)[owner], "lo": lo + off, "hi": hi + off + window - 1})


def remove_repeated(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Every document without the words that a repeated window covers.

    Returns ``key``, n_words, n_removed long, kept string (the kept words joined by a blank), removed array of structs
    (start, end): the removed word places. Words are runs without blank and \\t to \\r, unchanged. A window's sequence may
    repeat in the same document; windows are judged on the input. Null and empty texts have no words; texts of fewer words
    than a window keep all; rows that are repeated count as often as they stand; null keys are kept; other columns are left
    behind; an empty table gives no row.
    """
    gram = min(GRAM, 1 << (window.bit_length() - 1))
    if gram > 1 and window < 2 * gram:
        gram = max(1, gram // 2)
    most = min(MOST, 255)
    folder = folder or new_folder(docs.sparkSession, "passages")
    texts = Texts(docs, key, text, f"{folder}/texts", window, gram, most)
    spark = texts.spark
    chosen = f"{folder}/chosen"
    candidates(texts).write.parquet(chosen)
    found = f"{folder}/found"
    repeated_parts(copies(texts, spark.read.parquet(chosen), window, gram), window).write.parquet(found)
    hits = spark.read.schema("m long, s long, lo long, hi long").parquet(found)
    places = occurrences(texts, False).select("m", "s", "file", "row", "at")
    hits = hits.join(places, ["m", "s"]).select("file", "row", (F.col("at") + F.col("lo")).alias("at"), (F.col("at") + F.col("hi")).alias("to"))
    files = texts.table.groupBy(texts.place[0].alias("file")).agg(F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    kind = docs.schema[key].dataType.simpleString()
    return map_batches(texts.dealt(files.unionByName(hits)), _cut_out(texts.reader()), f"k {kind}, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>").withColumnRenamed("k", key)


def _cut_out(read: Texts):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("file", "row", "at", "to")], strict=True))
        for number, of_file in groupby(hits, lambda r: r[0]):
            rows = groupby(of_file, lambda r: r[1])
            next(rows)  # the file's own mark
            nxt, at = next(rows, None), 0
            for b in read.rows(number, ["k", "t", "n"]):
                removed, kept, spans = [], [], []
                for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    cuts: list[list[int]] = []
                    if nxt is not None and nxt[0] == at:
                        for _, _, lo, hi in nxt[1]:
                            if cuts and lo <= cuts[-1][1]:
                                cuts[-1][1] = max(hi, cuts[-1][1])
                            else:
                                cuts.append([lo, hi])
                        nxt = next(rows, None)
                    words, left, last = (t or "").encode("utf-8", "surrogatepass").split(), [], 0
                    for lo, hi in [*cuts, [n, n]]:
                        left += words[last:lo]
                        last = hi
                    removed.append(n - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                    spans.append([{"start": lo, "end": hi} for lo, hi in cuts])
                    at += 1
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, spans_type)], ["k", "n_words", "n_removed", "kept", "removed"])

    return cut


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole document without its repeated passages of 35 words; the kept words as a digest."""
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
