"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a batch of documents, as sequences of word numbers. Words that no benchmark item holds can't be
part of a match, nor can word pairs that no item holds, so a shard's suffix array covers just the runs of known pairs that
are long enough (exact pruning, not sampling). Every suffix of every item is searched in the shard's array by
bisection; the span of suffixes that begin with its window gives all
locations, and at each the match is followed on to its longest verbatim length.

Documents aren't shuffled. The benchmark is taken in blocks of bounded text; each block is broadcast and is one
pass over the stream of documents, so any number of items is handled and a worker holds one block at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import docs_only, map_frames

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in a block, which bounds what is broadcast.
BLOCK_BYTES = 16 << 20
#: Documents of a shard at most.
SHARD_ROWS = 4096

#: Word bytes stay (A-Z in lower case); all others become blanks. Bytes over 127 are parts of word characters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Block:
    """Benchmark texts (with the ids of the items that have them) as word numbers under one suffix array, and each distinct window.

    About 40 bytes a word of the items, and the vocabulary. Windows lie in the order of their words; those of items shorter
    than a window are whole items.
    """

    def __init__(self, items: list[tuple[list[int | None], str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        held = [(i, np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws), np.int64, len(ws))) for i, t in items if (ws := words_of(t))]
        self.ids = [i for i, _ in held]
        sizes = np.array([len(s) for _, s in held], np.int64)
        words = np.concatenate([x for _, s in held for x in (s, [0])]) if held else np.zeros(0, np.int64)
        del held
        ends = np.cumsum(sizes + 1) - 1
        self.base = np.uint64(len(self.vocab) + 1)
        self.order = suffix_array(words).astype(np.int32)
        left = np.repeat(ends, sizes + 1) - np.arange(len(words))  # words from a place to its item's end
        self.left, self.item = left.astype(np.int32), np.repeat(np.arange(len(sizes)), sizes + 1).astype(np.int32)
        short = np.flatnonzero((sizes > 0) & (sizes < window))
        self.shortest = int(min([window, *sizes[short].tolist()]))
        # windows of full length: neighbours in the suffix array that agree in as many words
        rows = np.flatnonzero(left[self.order] >= window).astype(np.int32)
        same = np.ones(max(0, len(rows) - 1), bool)
        for j in range(window):
            column = words[self.order[rows] + j]
            same &= column[1:] == column[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(rows) else np.zeros(0, np.int64)
        #: First and last row of each window in the suffix array; the rows between all begin with it.
        self.lo, self.hi = rows[first], rows[np.append(first[1:], len(rows)) - 1] + 1 if len(rows) else rows
        self.window = window
        at = self.order[self.lo]
        self.codes = self.start(words[at], words[np.minimum(at + 1, max(0, len(words) - 1))] if window > 1 else None)
        pairs = words[:-1].astype(np.uint64) * self.base + words[1:].astype(np.uint64)
        self.pairs = np.unique(pairs[(words[:-1] > 0) & (words[1:] > 0)])
        self.raw = words.astype(">u4").tobytes()
        #: Whole short items by their first words' number: (bytes, item numbers).
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for n in short.tolist():
            lo = int(ends[n] - sizes[n])
            code = int(self.start(words[lo : lo + 1], words[lo + 1 : lo + 2] if sizes[n] > 1 else None)[0])
            self.short.setdefault(code, {}).setdefault(self.raw[4 * lo : 4 * int(ends[n])], []).append(n)

    def start(self, first: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        """The numbers of pairs of words; of words alone, less than any pair's."""
        first = first.astype(np.uint64)
        return first if second is None else first * self.base + second.astype(np.uint64)

    def present(self, s: np.ndarray) -> Iterator[tuple[bytes, set[int], tuple[int, int] | None]]:
        """The windows whose beginning occurs in a shard's runs: their words, their items, their rows in the suffix array."""
        starts = [np.unique(s[s > 0]).astype(np.uint64)] if self.shortest == 1 else []
        if len(s) > 1:
            starts.append(np.unique(self.start(s[:-1], s[1:])))
        for some in starts:
            lo, hi = np.searchsorted(self.codes, some), np.searchsorted(self.codes, some, side="right")
            for k in np.flatnonzero(lo < hi).tolist():
                for n in range(lo[k], hi[k]):
                    rows = int(self.lo[n]), int(self.hi[n])
                    at = int(self.order[rows[0]])
                    yield self.raw[4 * at : 4 * (at + self.window)], set(self.item[self.order[rows[0] : rows[1]]].tolist()), rows
            if self.short:
                for code in some.tolist():
                    for key, found in self.short.get(code, {}).items():
                        yield key, set(found), None

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Which words of a shard can belong to a match: they lie in a run of known pairs (or words) long enough."""
        if self.shortest == 1:
            return ids > 0
        codes = ids[:-1].astype(np.uint64) * self.base + ids[1:].astype(np.uint64)
        at = np.searchsorted(self.pairs, codes)
        known = (ids[:-1] > 0) & (ids[1:] > 0) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == codes) if len(self.pairs) else np.zeros(len(codes), bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        long = hi - lo >= self.shortest - 1
        mark = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mark, lo[long], 1)
        np.add.at(mark, hi[long] + 1, -1)
        return np.cumsum(mark[:-1]) > 0


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling until all ranks differ; about 40 bytes a word at the peak."""
    n, step = len(s), 1
    if not n:
        return np.zeros(0, np.int64)
    rank = s.astype(np.int64) + 1
    while True:
        key = rank * (int(rank.max()) + 1)
        key[: max(0, n - step)] += rank[step:]
        order = np.argsort(key)
        key = key[order]
        fresh = np.ones(n, np.int32)
        np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), out=fresh)
        del key
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n or step > n:
            return order


class Shard:
    """The suffix array of a shard's matchable runs."""

    def __init__(self, ids: np.ndarray, block: Block):
        keep = block.runs(ids) if len(ids) else np.zeros(0, bool)
        spots = np.flatnonzero(keep)
        # a 0 after each run, so that no match crosses a gap
        gaps = np.flatnonzero(np.diff(spots) > 1) + 1
        self.spots = np.insert(spots, gaps, -1)
        s = np.where(self.spots >= 0, ids[self.spots], 0) if len(spots) else np.zeros(0, np.int64)
        self.order = suffix_array(np.append(s, 0)).tolist() if len(spots) else []
        self.raw = np.append(s, 0).astype(">u4").tobytes()
        self.words = s

    def span(self, prefix: bytes) -> tuple[int, int]:
        n, raw = len(prefix), self.raw
        key = lambda p: raw[4 * p : 4 * p + n]
        lo = bisect_left(self.order, prefix, key=key)
        return lo, bisect_right(self.order, prefix, lo, key=key) if lo < len(self.order) and key(self.order[lo]) == prefix else lo

    def longest(self, p: int, block: Block, rows: tuple[int, int]) -> int:
        """Words that the shard's suffix at p has in common with an item's: with a neighbour of its place in the rows of the suffix array."""
        lo, hi, best = *rows, 0
        while lo < hi:
            mid = (lo + hi) // 2
            at = int(block.order[mid])
            n = self.match(p, block, at)
            best = max(best, n)
            here, there = self.raw[4 * (p + n) : 4 * (p + n + 1)], block.raw[4 * (at + n) : 4 * (at + n + 1)] if n < block.left[at] else b""
            lo, hi = (lo, mid) if here <= there else (mid + 1, hi)
        return best

    def match(self, p: int, block: Block, at: int) -> int:
        """Words that the shard's suffix at p and an item's at a place have in common."""
        most, n, step = int(block.left[at]), 0, 64
        while n < most:
            k = min(step, most - n)
            here, there = self.raw[4 * (p + n) : 4 * (p + n + k)], block.raw[4 * (at + n) : 4 * (at + n + k)]
            if here != there:
                k = min(len(here), len(there)) // 4
                a, b = np.frombuffer(here, ">u4", k), np.frombuffer(there, ">u4", k)
                differ = np.flatnonzero(a != b)
                return n + (int(differ[0]) if len(differ) else k)
            n, step = n + k, 2 * step
        return n


def search_shard(texts: list[str | None], block: Block, window: int = WINDOW) -> list[tuple[int, list[list[int]], set, int]]:
    """For each text: its words, the merged word spans [start, end) that are hit, the items found, the longest match."""
    words = [words_of(t) for t in texts]
    flat: list[int] = []
    starts = []
    for ws in words:
        starts.append(len(flat))
        flat += map(block.vocab.get, ws, repeat(0))
        flat.append(0)
    shard = Shard(np.array(flat, np.int64), block)
    spans: dict[int, list[list[int]]] = {}
    items: dict[int, set] = {}
    longest: dict[int, int] = {}
    if shard.order:
        for key, found_items, rows in block.present(shard.words):
            lo, hi = shard.span(key)
            if lo == hi:
                continue
            found, size = shard.order[lo:hi], len(key) // 4
            places = shard.spots[np.array(found)]
            for q, p, d in zip(found, places.tolist(), (np.searchsorted(starts, places, "right") - 1).tolist(), strict=True):
                spans.setdefault(d, []).append([p - starts[d], p - starts[d] + size])
                items.setdefault(d, set()).update(found_items)
                longest[d] = max(longest.get(d, 0), shard.longest(q, block, rows) if rows else size)
    return [(len(ws), merged(spans.get(d, [])), {i for n in items.get(d, ()) for i in block.ids[n]}, longest.get(d, 0)) for d, ws in enumerate(words)]


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def blocks_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct texts (ids, text, block) and the number of blocks of about BLOCK_BYTES; repeated items are one text with several ids."""
    texts = benchmark.filter("text is not null").groupBy("text").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nulls"))
    texts = texts.select(F.when(F.col("nulls"), F.array_append(F.col("ids"), F.lit(None))).otherwise(F.col("ids")).alias("ids"), "text")
    total = texts.agg(F.sum(F.octet_length("text") + 8 * F.size("ids"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    return texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks))), blocks


def block_items(texts: DataFrame, block: int) -> list[tuple[list[int | None], str | None]]:
    return [(r["ids"], r["text"]) for r in texts.filter(F.col("block") == block).select("ids", "text").collect()]


_built: dict[tuple, Block] = {}


def built(token: str, shared, window: int) -> Block:
    """The block of a broadcast, built once a worker; the worker keeps the one it used last."""
    if (token, window) not in _built:
        _built.clear()
        _built[token, window] = Block(shared.value, window)
    return _built[token, window]


FOUND = "n_words long, hits array<array<long>>, items array<string>, longest long"


def find_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Adds to each document: n_words, hits (merged word spans), items (ids as strings, sorted), longest.

    ``longest`` is the longest verbatim match found, in words. Null and empty texts have no words and no hits; items
    without words, and an empty benchmark, match nothing; items with a null id mark hits but are not
    listed; repeated rows and repeated items are each searched, item ids are listed once. Other columns are
    left behind (the text too, unless ``keep_text``).
    """
    kind = docs.schema[key].dataType.simpleString()
    out = docs_only(docs, key, text).toDF("k", "t").withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast("array<array<long>>"), "items": F.lit(None).cast("array<string>"), "longest": F.lit(0).cast("long")})
    items, blocks = blocks_of(benchmark)
    for b in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block_items(items, b))

        def find(batches: Iterator[pd.DataFrame], shared=shared, token=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            block = built(token, shared, window)
            for batch in batches:
                for lo in range(0, len(batch), SHARD_ROWS):
                    part = batch.iloc[lo : lo + SHARD_ROWS].copy()
                    got = search_shard(part["t"].tolist(), block, window)
                    was = [[list(map(int, s)) for s in x] if x is not None else [] for x in part["hits"]]
                    part["n_words"] = [g[0] for g in got]
                    part["hits"] = [merged(w + g[1]) for w, g in zip(was, got, strict=True)]
                    part["items"] = [sorted({*(o if o is not None else ()), *(str(i) for i in g[2] if i is not None)}) for o, g in zip(part["items"], got, strict=True)]
                    part["longest"] = np.maximum(part["longest"].to_numpy(), [g[3] for g in got])
                    yield part if keep_text or b + 1 < blocks else part.drop(columns="t")

        text_kind = "t string, " if keep_text or b + 1 < blocks else ""
        out = map_frames(out, find, f"k {kind}, {text_kind}{FOUND}")
    return out.withColumnsRenamed({"k": key, "t": text})


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return find_matches(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (all columns) in which no window of the benchmark occurs; decided row by row, without a join."""
    items, blocks = blocks_of(benchmark)
    for b in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block_items(items, b))

        def clean(batches: Iterator[pd.DataFrame], shared=shared, token=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            block = built(token, shared, window)
            for batch in batches:
                for lo in range(0, len(batch), SHARD_ROWS):
                    part = batch.iloc[lo : lo + SHARD_ROWS]
                    yield part[[not g[1] for g in search_shard(part["text"].tolist(), block, window)]]

        docs = map_frames(docs, clean, docs.schema)
    return docs


def brute_force(texts: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The query's rows by comparing every window with every place; for tests."""
    windows = [(i, tuple(ws[j : j + w])) for i, t in items if (ws := words_of(t)) for w in [min(window, len(ws))] for j in range(len(ws) - w + 1)]
    out = []
    for doc_id, text in texts:
        ws = words_of(text)
        hit, found = set(), set()
        for item, win in windows:
            for p in range(len(ws) - len(win) + 1):
                if tuple(ws[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(item))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def op6_suffix_arrays(spark, sf_dir: str) -> DataFrame:
    """The query: every whole document against every whole benchmark item."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
