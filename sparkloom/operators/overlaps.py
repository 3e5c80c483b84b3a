"""Token overlap of many documents with blocks of questions: a document's shared tokens are one sum of rows of a table of the questions' tokens.

The n-th occurrence of a token is a feature of its own, so that multisets compare as sets. A task reads its documents a batch at a time and keeps
the few best documents of each question, so neither tokens nor pairs are shuffled and memory is that of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from sparkloom.operators.products import MARGIN, foremost, numbers, places, rounded

#: Questions side by side in a table; features whose rows are held at a time; documents and bytes of an Arrow batch.
SIDE, FEATURES, BATCH_ROWS, BATCH_BYTES = 256, 1 << 15, 2_048, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are higher or unbounded."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).strip().lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


class Side:
    """Up to SIDE questions: (feature, question) as a table of zeros and ones, features of a token in the order of occurrence."""

    def __init__(self, owner: np.ndarray, token: np.ndarray, n: int, vocabulary: int):
        nth = places(np.lexsort((token, owner)), owner, token)
        self.most = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.most, token, nth + 1)
        self.first = np.cumsum(self.most) - self.most
        self.kind = np.uint16 if len(token) < 1 << 16 else np.int32
        self.table = np.zeros((int(self.most.sum()), n), self.kind)
        self.table[self.first[token] + nth, owner] = 1

    def shared(self, row: np.ndarray, token: np.ndarray, nth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and how many tokens they share with each question, a part of the documents at a time. Rows rise."""
        known = nth < self.most[token]
        row, feature = row[known], (self.first[token] + nth)[known]
        docs, starts = np.unique(row, return_index=True)
        part = np.append(starts, len(row))
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(part, part[lo] + FEATURES, "right")) - 1)
            if part[hi] - part[lo] <= FEATURES:
                yield docs[lo:hi], np.add.reduceat(self.table[feature[part[lo] : part[hi]]], part[lo:hi] - part[lo], axis=0, dtype=self.kind)
            else:  # one long document
                yield docs[lo:hi], sum(self.table[feature[i : min(i + FEATURES, part[hi])]].sum(axis=0, dtype=self.kind) for i in range(part[lo], part[hi], FEATURES))[None, :].astype(self.kind)
            lo = hi


class Questions:
    """Questions (qid, _q: tokens), ready to meet batches of documents (..., _d: tokens)."""

    def __init__(self, asked: pa.Table):
        self.qid = asked.column("qid").combine_chunks()
        encoded = pc.dictionary_encode(pc.list_flatten(asked.column("_q"))).combine_chunks()
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        self.words = encoded.dictionary
        owner, token = np.asarray(pc.list_parent_indices(asked.column("_q"))), np.asarray(encoded.indices)
        self.size = np.bincount(owner, minlength=len(asked)).astype(np.float64)
        self.sides = []
        for lo in range(0, len(asked), SIDE):
            here = slice(*np.searchsorted(owner, [lo, lo + SIDE]))
            self.sides.append((lo, Side(owner[here] - lo, token[here], min(SIDE, len(asked) - lo), len(self.words))))

    def best(self, batches: Iterable[pa.Table], k: int, cap: int | None, cap_key: str) -> pa.Table | None:
        """The first k documents of each question by rounded score, then doc_id, at most ``cap`` of a value of cap_key."""
        held, least = None, np.full(len(self.qid), -np.inf)
        for docs in batches:
            if not len(docs) or not len(self.words):
                continue
            docs = docs.take(pc.sort_indices(docs.select(["doc_id"]), sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
            qi, vi, score = self._scored(docs.column("_d"), least)
            kind = numbers(docs.column(cap_key)) if cap is not None else None
            at = foremost(qi, vi, score, k, kind, cap)
            some = docs.drop_columns(["_d"]).take(pa.array(vi[at])).append_column("_i", pa.array(qi[at])).append_column("score", pa.array(score[at]))
            held = some if held is None else pa.concat_tables([held, some])
            held = held.take(pc.sort_indices(held.select(["doc_id"]), sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
            qi, score = np.asarray(held.column("_i")), np.asarray(held.column("score"))
            at = foremost(qi, np.arange(len(qi)), score, k, numbers(held.column(cap_key)) if cap is not None else None, cap)
            held, qi, score = held.take(pa.array(at)).combine_chunks(), qi[at], score[at]
            full = np.flatnonzero(np.bincount(qi, minlength=len(least)) >= k)
            ends = np.searchsorted(qi, full, "right") - 1
            least[full] = score[ends]
        return None if held is None else held.append_column("qid", self.qid.take(held.column("_i").combine_chunks())).drop_columns(["_i"])

    def _scored(self, tokens: pa.ChunkedArray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that share a token and aren't behind a question's ``least`` score: question, document, rounded score."""
        size = np.asarray(pc.list_value_length(tokens), np.float64)
        at = pc.index_in(pc.list_flatten(tokens), value_set=self.words)
        known = np.asarray(at.is_valid())
        # A document's tokens side by side, equal ones in a run.
        both = np.sort(np.asarray(pc.list_parent_indices(tokens), np.int64)[known] * len(self.words) + np.asarray(pc.fill_null(at, 0), np.int64)[known])
        nth = places(np.arange(len(both)), both)
        row, token = np.divmod(both, len(self.words))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo, side in self.sides:
            here = slice(lo, lo + SIDE)
            with np.errstate(all="ignore"):
                for docs, same in side.shared(row, token, nth):
                    raw = same / np.sqrt(self.size[here][None, :] * size[docs][:, None])
                    d, q = np.nonzero((same > 0) & (raw >= least[here][None, :] - MARGIN))
                    out.append((q + lo, docs[d], rounded(raw[d, q])))
        return tuple(np.concatenate(x) for x in zip(*out))
