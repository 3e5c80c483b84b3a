"""An inverted file over vectors: k-means cells, rows stored by cell, searches that look into the nearest cells only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import products as P
from sparkloom.operators.retrieval import BROADCAST_BYTES, size_of, top_k
from sparkloom.sources.snapshots import read_snapshot, write_snapshot

#: Rows that centroids and probes are fitted on at most; cells at most; rounds of k-means.
FIT_ROWS, MOST_CELLS, ROUNDS = 50_000, 4096, 8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of every row, nearest first, a block of rows at a time."""
    out = []
    for lo in range(0, len(x), 4096):
        like = x[lo : lo + 4096] @ centroids.T
        some = np.argpartition(-like, n - 1, axis=1)[:, :n] if n < like.shape[1] else np.tile(np.arange(like.shape[1]), (len(like), 1))
        out.append(np.take_along_axis(some, np.argsort(-np.take_along_axis(like, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def k_means(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centroids of unit rows by cosine; a cell that empties starts again at a row of its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        cell = nearest(x, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        empty = np.bincount(cell, minlength=cells) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centroids = unit(sums)
    return centroids


class InvertedFile:
    """Fitted cells for vectors (vec_id, embedding, ...).

    Centroids and the number of probes are fitted on at most FIT_ROWS rows, those with the least hashes of their ids: probes are the fewest for which
    the search over the sample finds ``recall`` of the exact ``k`` nearest of a twentieth of it. Every row is indexed, whatever the fit;
    null vectors and ids can't be found and are left out. A table without vectors gives no cell and finds nothing.
    """

    def __init__(self, vectors: DataFrame, k: int = 10, recall: float = 0.97, cells: int | None = None, seed: int = 7):
        n = vectors.filter("embedding is not null").count()
        sample = vectors.filter("embedding is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
        x = unit(np.array(sample["embedding"].tolist(), np.float64)) if len(sample) else np.zeros((0, 1))
        self.cells = min(len(x), MOST_CELLS, cells or max(1, round(4 * n**0.5)))
        self.centroids = k_means(x, self.cells, seed) if len(x) else x
        self.probes = self._fewest(x, k, recall) if len(x) else 0

    def _fewest(self, x: np.ndarray, k: int, recall: float) -> int:
        asked = x[::20]
        cell = nearest(x, self.centroids, 1)[:, 0]
        order = nearest(asked, self.centroids, self.cells)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.tile(np.arange(self.cells), (len(order), 1)), 1)
        best = np.concatenate([np.argpartition(-(asked[i : i + 256] @ x.T), min(k, len(x)) - 1, axis=1)[:, :k] for i in range(0, len(asked), 256)])
        need = np.sort(np.take_along_axis(place, cell[best], 1).ravel()) + 1
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])

    def _cells_of(self, df: DataFrame, vector: str, n: int) -> DataFrame:
        """df with ``_cells``: the n nearest cells of each row's vector."""
        shared = df.sparkSession.sparkContext.broadcast(self.centroids)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(_cells=list(nearest(unit(np.array(b[vector].tolist(), np.float64)), shared.value, n)))

        return df.filter(F.col(vector).isNotNull()).mapInPandas(run, f"{kinds}, _cells array<long>")

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """Every row with its cell."""
        if not self.cells:
            return vectors.limit(0).withColumn("cell", F.lit(0).cast("long"))
        return self._cells_of(vectors.filter("vec_id is not null"), "embedding", 1).withColumn("cell", F.get("_cells", F.lit(0))).drop("_cells")

    def index(self, vectors: DataFrame, path: str) -> DataFrame:
        """Writes a version of the rows by cell, a large cell in several files, and returns them: a search reads the row groups of its cells."""
        write_snapshot(self.assigned(vectors).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), path)
        return read_snapshot(vectors.sparkSession, path)

    def candidates(self, queries: DataFrame, index: DataFrame, probes: int | None = None) -> DataFrame:
        """Queries (qid, qvec) beside the rows of their nearest cells."""
        asked = self._cells_of(queries.select("qid", "qvec"), "qvec", min(self.cells, probes or self.probes)).withColumn("cell", F.explode("_cells")).drop("_cells") if self.cells else queries.select("qid", "qvec").limit(0).withColumn("cell", F.lit(0).cast("long"))
        return index.join(F.broadcast(asked) if size_of(queries) * max(1, self.probes) <= BROADCAST_BYTES else asked, "cell")

    def search(self, queries: DataFrame, index: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """Top-k by exact cosine among the rows of the nearest cells; ties by vec_id.

        Cells are packed to groups of about ``products.GROUP_ROWS`` rows, a larger cell is dealt to several. A query goes to the groups that hold
        one of its cells, once each with the cells it looks into there, and a task scores a cell's rows for the queries that look into it.
        """
        first, many, groups = self._packed(index)
        kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, qvec {queries.schema['qvec'].dataType.simpleString()}"
        n = min(self.cells, probes or self.probes)
        shared = queries.sparkSession.sparkContext.broadcast((self.centroids, first, many))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centroids, first, many = shared.value
            for b in batches:
                for lo in range(0, len(b), 64):
                    some, out = b[lo : lo + 64], []
                    for i, cells in enumerate(nearest(unit(np.array(some["qvec"].tolist(), np.float64)), centroids, n)):
                        cells = np.sort(cells[many[cells] > 0])
                        at = np.repeat(np.arange(len(cells)), many[cells])
                        group = np.repeat(first[cells], many[cells]) + P.places(np.arange(len(at)), at)
                        order = np.argsort(group, kind="stable")
                        which, starts = np.unique(group[order], return_index=True)
                        out += [(i, g, c) for g, c in zip(which, np.split(cells[at[order]], starts[1:]))]
                    if out:
                        rows, which, cells = zip(*out)
                        yield some[["qid", "qvec"]].iloc[list(rows)].assign(_group=which, _cells=cells)

        asked = queries.select("qid", "qvec")
        asked = asked.filter("qvec is not null") if self.cells else asked.limit(0)
        asked = asked.mapInPandas(run, f"{kinds}, _group int, _cells array<int>")
        where = index.sparkSession.createDataFrame([(c, int(first[c]), int(many[c])) for c in range(len(first)) if many[c]], "cell long, _first int, _many int")
        dealt = F.col("_first") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("_many")).cast("int")
        rows = index.join(F.broadcast(where), "cell").withColumn("_group", dealt).drop("_first", "_many")
        found = P.search(asked, rows, k, pairs=in_cells, dealt=(P.parts_of(queries.count(), P.BLOCK_QUERIES), groups), extra=("cell",))
        return top_k(found, k, "qid", [F.desc("embed_score"), F.asc("vec_id")])

    def _packed(self, index: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        """Each cell's first group and how many it has (0: no rows), by the rows of at most MOST_CELLS cells; and the number of groups."""
        first, many, at, held = np.zeros(self.cells, np.int64), np.zeros(self.cells, np.int64), 0, 0
        for c, n in sorted(map(tuple, index.groupBy("cell").agg(F.count("*")).collect())):
            if held and held + n > P.GROUP_ROWS:
                at, held = at + 1, 0
            first[c], many[c] = at, P.parts_of(n, P.GROUP_ROWS)
            at, held = (at + many[c], 0) if n > P.GROUP_ROWS else (at, held + n)
        return first, many, int(at) + 1


def in_cells(asked: pa.Table, found: pa.Table):
    """For each cell of a group: the queries that look into it and its rows."""
    cell = np.asarray(found.column("cell"))
    rows = np.argsort(cell, kind="stable")
    known, starts = np.unique(cell[rows], return_index=True)
    who, looked = np.asarray(pc.list_parent_indices(asked.column("_cells"))), np.asarray(pc.list_flatten(asked.column("_cells")))
    order = np.argsort(looked, kind="stable")
    who, looked = who[order], looked[order]
    for c, of in zip(known, np.split(rows, starts[1:])):
        yield who[slice(*np.searchsorted(looked, [c, c + 1]))], of, None
