"""Embedding hooks: any batch encoder through Arrow, and a hashed term-frequency vector without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X


def embed(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 256) -> DataFrame:
    """Adds ``embedding``; ``make`` builds the encoder once a task, which then gets lists of texts (null: "")."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch].copy()
                part["embedding"] = [list(map(float, v)) for v in encode([t or "" for t in part[text]])]
                yield part

    return rows.mapInPandas(run, ", ".join([*kinds, "embedding array<float>"]))


def hashed_vector(text: Column, dim: int = 384) -> Column:
    """Token counts hashed into ``dim`` places with a hashed sign, as array<double>; a text without tokens is all zeros."""
    marks = F.transform(X.tokenize(text), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("i"), F.when(F.xxhash64(w, F.lit(1)) < 0, -1.0).otherwise(1.0).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(marks, lambda m: m["i"] == i), F.lit(0.0), lambda n, m: n + m["s"]))
