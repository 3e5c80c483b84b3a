"""Scores of blocks of queries against groups of rows: Spark deals and shuffles both, a task meets one block and one group.

Matrix products say which pairs can be among the best; their scores are then summed in the order of the places, as ``retrieval.dot`` sums,
and rounded as ``round`` rounds, so results are the same as those of every pair scored by expressions. A task gives its few best rows a query.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a block and rows of a group, about; pairs that are held at a time.
BLOCK_QUERIES, GROUP_ROWS, PAIRS = 8_192, 16_384, 1 << 21
#: Decimal places of scores; products that differ by more than MARGIN keep their order when they are summed otherwise and rounded.
PLACES, MARGIN = 6, 2e-6


def parts_of(n: int, most: int) -> int:
    return max(1, -(-n // most))


def deal(df: DataFrame, n: int, salt: int) -> Column:
    """A number below n for each row, by its content."""
    return F.pmod(F.xxhash64(F.lit(salt), *df.columns, F.monotonically_increasing_id()), F.lit(n)).cast("int")


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def meet(queries: DataFrame, rows: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, dealt: tuple[int, int] | None = None) -> DataFrame:
    """best(block of queries, group of rows) for every block and group. dealt: numbers of blocks and groups, when queries and rows have a ``_group`` and meet only there.

    Sizes of blocks and groups are fixed, so that a task's memory doesn't grow with the tables.
    """
    blocks, groups = dealt or (parts_of(queries.count(), BLOCK_QUERIES), parts_of(rows.count(), GROUP_ROWS))
    if dealt is None:
        queries, rows = queries.withColumn("_block", deal(queries, blocks, 1)).withColumn("_group", every(groups)), rows.withColumn("_group", deal(rows, groups, 2))
    else:
        queries = queries.withColumn("_block", deal(queries, blocks, 1))
    sides = [df.repartition(blocks * groups, "_block", "_group").groupBy("_block", "_group") for df in (queries, rows.withColumn("_block", every(blocks)))]
    drop = ["_block", "_group"]

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        kinds = pa.schema([pa.field(f.name, _arrow(asked, found, f.name)) for f in schema])
        if not len(asked) or not len(found):
            return kinds.empty_table()
        return best(asked.drop_columns(drop), found.drop_columns(drop)).select(kinds.names).cast(kinds)

    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _arrow(asked: pa.Table, found: pa.Table, name: str) -> pa.DataType:
    return next((t.schema.field(name).type for t in (found, asked) if name in t.column_names), pa.float64())


class Vectors:
    """Vectors of a column as a matrix, shorter ones filled with zeros; ``whole``: neither null nor with a null entry."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), self.size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.values = np.zeros((len(lists), int(self.size.max(initial=0))))
        self.values[row, at] = np.asarray(pc.fill_null(flat, 0), np.float64)
        self.whole = np.asarray(lists.is_valid())
        self.whole[row[np.asarray(flat.is_null())]] = False
        with np.errstate(all="ignore"):
            total = np.zeros(len(lists))
            for x in self.values.T:
                total += x * x
            self.norm = np.sqrt(total)
            #: Vectors whose products are exact to MARGIN.
            self.plain = self.whole & ((self.norm == 0) | ((self.norm > 1e-100) & (self.norm < 1e100)))
            self.unit = np.where(self.plain[:, None], self.values, 0) / np.where(self.plain & (self.norm > 0), self.norm, 1)[:, None]


def rounded(x: np.ndarray) -> np.ndarray:
    """x to PLACES places, halves away from zero by the shortest decimal form, as Spark's ``round``."""
    with np.errstate(all="ignore"):
        y = np.abs(x) * 10.0**PLACES
        whole = np.floor(y + 0.5)
        doubt = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)
        if len(doubt):
            kinds, at = np.unique(np.abs(x[doubt]), return_inverse=True)
            whole[doubt] = np.array([float(Decimal(repr(float(v))).scaleb(PLACES).to_integral_value(ROUND_HALF_UP)) for v in kinds])[at]
        return np.copysign(whole / 10.0**PLACES, x) + 0.0


def cosines(q: Vectors, v: Vectors, qi: np.ndarray, vi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded cosines of pairs, summed in the order of the places, and which are null: those of vectors that aren't whole or differ in length."""
    with np.errstate(all="ignore"):
        total = np.zeros(len(qi))
        for a, b in zip(q.values.T, v.values.T):
            total += a[qi] * b[vi]
        size = q.norm[qi] * v.norm[vi]
        score = rounded(np.where(size == 0, 0.0, total / size))
    null = ~q.whole[qi] | ~v.whole[vi] | ((q.size[qi] != v.size[vi]) & (size != 0))
    return score, null


def places(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Place of every entry, from 0, among those of the same keys, in an order that sorts by the keys first."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return out


def foremost(qi: np.ndarray, vi: np.ndarray, key: np.ndarray, k: int, kind: np.ndarray | None, cap: int | None) -> np.ndarray:
    """Indices of the first k of each query by falling key, then place, at most ``cap`` of a kind; sorted so."""
    at = np.arange(len(qi))
    if cap is not None:
        of = kind[vi]
        at = at[places(np.lexsort((vi, -key, of, qi)), qi, of) < cap]
    order = np.lexsort((vi[at], -key[at], qi[at]))
    at = at[order]
    return at[places(np.arange(len(at)), qi[at]) < k]


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values, nulls too, as equal numbers."""
    return np.asarray(pc.dictionary_encode(column, null_encoding="encode").combine_chunks().indices)


def classes(v: Vectors) -> np.ndarray:
    """A number for each row: equal vectors have one, and so have all that aren't whole."""
    with np.errstate(all="ignore"):
        sums = (v.values * np.random.default_rng(11).standard_normal(v.values.shape[1])).sum(axis=1)
    _, first, of = np.unique(sums, return_index=True, return_inverse=True)
    like = first[of]
    alike = (v.values == v.values[like]).all(axis=1) & (v.size == v.size[like]) & v.whole[like]
    return np.where(v.whole, np.where(alike, of, len(of) + np.arange(len(of))), -1)


def best_rows(asked: pa.Table, found: pa.Table, k: int, pairs=None, cap: int | None = None, cap_key: str = "") -> pa.Table:
    """The k rows of highest cosine for each query, ties by vec_id, at most ``cap`` of a value of cap_key; all columns but the vectors, and embed_score.

    pairs(asked, found) gives what may meet: (queries, rows, None or a function from a slice of those queries to a matrix of pairs).
    """
    found = found.take(pc.sort_indices(found, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))
    kind = numbers(found.column(cap_key)) if cap is not None else None
    q, v = Vectors(asked.column("qvec")), Vectors(found.column("embedding"))
    if pairs is None:  # rows of a class have one score with every query: the first ones are enough
        of = classes(v)
        keep = np.sort(foremost(of, np.arange(len(of)), np.zeros(len(of)), k, kind, cap))
        if len(keep) < len(of):
            found, kind = found.take(pa.array(keep)), kind[keep] if cap is not None else None
            v = Vectors(found.column("embedding"))
    length = np.bincount(q.size).argmax()
    q.plain &= q.size == length
    v.plain &= v.size == length
    out = [_none()]
    for qs, vs, allow in pairs(asked, found) if pairs is not None else [(np.arange(len(asked)), np.arange(len(found)), None)]:
        out += _best_pairs(q, v, qs, vs, allow, k, kind, cap)
    qi, vi, score, null = (np.concatenate(x) for x in zip(*out))
    at = foremost(qi, vi, _key(score, null), k, kind, cap)
    qi, vi, score, null = qi[at], vi[at], score[at], null[at]
    rows = found.drop_columns(["embedding"]).take(pa.array(vi))
    return rows.append_column("qid", asked.column("qid").take(pa.array(qi))).append_column("embed_score", pa.array(score, mask=null))


def _best_pairs(q: Vectors, v: Vectors, qs: np.ndarray, vs: np.ndarray, allow, k: int, kind: np.ndarray | None, cap: int | None):
    """The k best of rows vs for each of queries qs, PAIRS pairs at a time: (query, row, score, null)."""
    width = min(q.unit.shape[1], v.unit.shape[1])
    uv, odd_v = np.ascontiguousarray(v.unit[vs, :width].T), ~v.plain[vs]
    want = k if cap is None else 16 * k
    step = max(1, PAIRS // max(1, len(vs)))
    for lo in range(0, len(qs), step):
        here = qs[lo : lo + step]
        allowed = allow(slice(lo, lo + step)) if allow is not None else None
        like = q.unit[here, :width] @ uv
        like[:, odd_v] = -np.inf
        if allowed is not None:
            like[~allowed] = -np.inf
        least = np.partition(like, -want, axis=1)[:, -want] if want < len(vs) else np.full(len(like), -np.inf)
        hit = like >= (least - MARGIN)[:, None]
        hit[~q.plain[here]] = True
        hit[:, odd_v] = True
        got = _chosen(q, v, here, vs, hit, allowed, k, kind, cap)
        if cap is not None:  # a query whose best rows are too few after the cap meets all of them
            of = np.full(len(q.size), -1)
            of[here] = np.arange(len(here))
            n, last = np.bincount(of[got[0]], minlength=len(here)), np.full(len(here), np.inf)
            np.minimum.at(last, of[got[0]], _key(got[2], got[3]))
            short = (least > -np.inf) & ((n < k) | ~(last > least - MARGIN / 2))
            if short.any():
                kept = ~short[of[got[0]]]
                yield tuple(a[kept] for a in got)
                got = _chosen(q, v, here, vs, np.repeat(short[:, None], len(vs), axis=1), allowed, k, kind, cap)
        yield got


def _none() -> tuple[np.ndarray, ...]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)


def _key(score: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Numbers in the order of scores, NaN highest and nulls lowest."""
    return np.where(null, -np.inf, np.where(np.isnan(score), np.inf, np.clip(score, -1e300, 1e300)))


def _chosen(q: Vectors, v: Vectors, qs: np.ndarray, vs: np.ndarray, hit: np.ndarray, allowed: np.ndarray | None, k: int, kind: np.ndarray | None, cap: int | None) -> tuple[np.ndarray, ...]:
    """The k best of the pairs that were hit and are allowed, with their scores as they are given out."""
    at = np.nonzero(hit if allowed is None else hit & allowed)
    qi, vi = qs[at[0]], vs[at[1]]
    score, null = cosines(q, v, qi, vi)
    at = foremost(qi, vi, _key(score, null), k, kind, cap)
    return qi[at], vi[at], score[at], null[at]


def search(queries: DataFrame, vectors: DataFrame, k: int, cap: int | None = None, cap_key: str = "", pairs=None, dealt: tuple[int, int] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows of every group for every query (qid, qvec): the vectors' columns but ``embedding`` and ``extra``, qid and embed_score."""
    kept = [f for f in vectors.schema if f.name not in ("embedding", "_group", *extra)]
    schema = T.StructType([queries.schema["qid"], *kept, T.StructField("embed_score", T.DoubleType())])

    def best(asked: pa.Table, found: pa.Table) -> pa.Table:
        return best_rows(asked, found, k, pairs, cap, cap_key)

    return meet(queries, vectors, best, schema, dealt)
