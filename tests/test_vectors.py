"""Vector searches by matrix products against the scores of every pair by expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import products as P
from sparkloom.operators import retrieval as V


def by_score():
    return [F.desc("embed_score"), F.asc("vec_id")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def rows_of(df):
    return sorted((r["qid"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], r["label"], "null" if r["embed_score"] is None else f"{r['embed_score']:.17g}") for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Random vectors, copies, near copies, halves at the seventh place, and vectors that are null, short, empty, zero, huge or not numbers."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 4)).round(2)
    x[100:180], x[180:200] = x[0], x[1] * 3
    rows = [(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [math.nan, 1.0, 1.0, 1.0], [math.inf, 1.0, 0.0, 0.0], [1e-200] * 4, [1e200] * 4, [-0.0] * 4, [2e-60, 0.0, 1e-60, 0.0], [1.0, 2e-7 * 5, 0.0, 0.0]]
    rows += [(1000 + 10 * i, v, 7) for i, v in enumerate(odd)] + [(None, [1.0, 0.0, 0.0, 0.0], 2)]
    path = f"file://{tmp_path_factory.mktemp('vectors')}/v"
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def asked_of(vectors):
    return vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@pytest.mark.parametrize("sizes", [(8192, 16384, 1 << 21), (10, 40, 100)])
@pytest.mark.parametrize("k", [3, 10, 400])
def test_top_k_is_that_of_all_pairs(spark, vectors, monkeypatch, sizes, k):
    for name, n in zip(("BLOCK_QUERIES", "GROUP_ROWS", "PAIRS"), sizes):
        monkeypatch.setattr(P, name, n)
    q = asked_of(vectors)
    want = V.top_k(V.vector_scores(q, vectors), k, "qid", by_score())
    assert rows_of(V.vector_top_k(q, vectors, k)) == rows_of(want)
    assert rows_of(V.vector_top_k(q, vectors, k, F.col("label") == 7)) == rows_of(V.top_k(V.vector_scores(q, vectors, F.col("label") == 7), k, "qid", by_score()))
    assert V.vector_top_k(q, vectors.limit(0), k).count() == V.vector_top_k(q.limit(0), vectors, k).count() == 0


def test_spark_sorts_a_few_rows_a_group_instead_of_all_pairs(spark, vectors):
    plan = plan_of(V.vector_top_k(asked_of(vectors), vectors, 10))
    assert "NestedLoopJoin" not in plan and "CoGroup" in plan
    found = P.search(asked_of(vectors), vectors, 10)
    assert found.count() <= 10 * asked_of(vectors).count()


def test_rounded_as_spark_rounds(spark):
    x = np.array([0.1234565, -0.1234565, 0.0000005, -0.0000005, 1e-9, -1e-9, 0.9999995, 0.12345649999999999, 2.5e-6, 1.0, math.nan, *np.random.default_rng(1).uniform(-1, 1, 2000), *(np.arange(-999, 1000) / 1e6 + 5e-7)])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", F.round("x", 6).alias("y")).collect()
    assert [repr(r["y"]) for r in got] == [repr(float(v)) for v in P.rounded(np.array([r["x"] for r in got]))]


@pytest.mark.parametrize("sizes", [(8192, 16384, 1 << 21), (10, 40, 100)])
@pytest.mark.parametrize("k, cap", [(3, 1), (6, 2), (9, 2)])
def test_capped_top_k_is_that_of_all_pairs(spark, vectors, monkeypatch, sizes, k, cap):
    for name, n in zip(("BLOCK_QUERIES", "GROUP_ROWS", "PAIRS"), sizes):
        monkeypatch.setattr(P, name, n)
    q, one_label = asked_of(vectors), vectors.withColumn("label", F.when(F.col("vec_id") % 97 == 0, 3).when(F.col("vec_id") % 41 == 0, F.lit(None)).otherwise(1))
    for v in (vectors, one_label):
        capped = V.vector_scores(q, v).withColumn("n", F.row_number().over(Window.partitionBy("qid", "label").orderBy(*by_score()))).filter(F.col("n") <= cap)
        found = V.diverse_top_k(q, v, k, cap, "label").withColumnRenamed("place", "rank")
        assert "NestedLoopJoin" not in plan_of(found) and rows_of(found.fillna(-1, ["label"])) == rows_of(V.top_k(capped, k, "qid", by_score()).fillna(-1, ["label"]))


def test_hashed_search_moves_no_pairs(spark, vectors):
    v = vectors.filter("vec_id < 1000 or vec_id in (1040, 1020)").filter("size(embedding) = 4")
    q, h = asked_of(v), V.HashedVectors(4)
    index = h.index(v)
    found = h.search(q, index, v, 10)
    assert "CoGroup" in plan_of(found)
    code, bit = {(r["vec_id"], r["table"]): r["code"] for r in index.collect()}, {0, *(1 << b for b in range(5))}
    near = {(a["qid"], b["vec_id"]) for a in q.collect() for b in v.collect() if any(code[a["qid"], t] ^ code[b["vec_id"], t] in bit for t in range(8))}
    pairs = spark.createDataFrame(list(near), "qid long, vec_id long")
    want = V.top_k(V.vector_scores(q, v).join(pairs, ["qid", "vec_id"]), 10, "qid", by_score())
    assert rows_of(found) == rows_of(want)
    assert h.search(q, index.filter("vec_id % 2 = 0"), v, 10).filter("vec_id % 2 = 1").count() == 0
    assert h.search(q, index, v.limit(0), 10).count() == 0


@pytest.mark.parametrize("most", [16384, 40])
def test_cells_meet_only_the_queries_that_look_into_them(spark, vectors, monkeypatch, most):
    from sparkloom.operators.ivf import InvertedFile

    monkeypatch.setattr(P, "GROUP_ROWS", most)  # 40: the cell of the copies is dealt to several groups
    v = vectors.filter("vec_id < 1000 or vec_id = 1020")
    q, file = asked_of(v), InvertedFile(v, cells=6)
    index = file.assigned(v).cache()
    both = file.candidates(q, index, 2).select("qid", "vec_id").distinct()
    found = file.search(q, index, 10, 2)
    assert "CoGroup" in plan_of(found) and both.count() < q.count() * v.count()
    assert rows_of(found) == rows_of(V.top_k(V.vector_scores(q, v).join(both, ["qid", "vec_id"]), 10, "qid", by_score()))


def test_recall_compares_two_searches_by_products(spark):
    from sparkloom.plans.queries import QUERIES
    from tests.conftest import DATA

    found = QUERIES["vector_cells_recall"](spark, DATA)
    assert plan_of(found).count("CoGroup") >= 2 and "cells-" in str(found.inputFiles()) and found.first()["enough"]


def scored_by_products(spark, name):
    from sparkloom.plans.queries import QUERIES
    from tests.conftest import DATA

    plan = plan_of(QUERIES[name](spark, DATA))
    return "CoGroup" in plan and "NestedLoopJoin" not in plan


def test_few_copies_of_a_vector_are_scored(spark, vectors, monkeypatch):
    scored, cosines = [], P.cosines
    monkeypatch.setattr(P, "cosines", lambda q, v, qi, vi: scored.append(len(qi)) or cosines(q, v, qi, vi))
    q, v = (df.toArrow() for df in (asked_of(vectors).filter("qid < 1000"), vectors.filter("vec_id < 180")))
    for cap in (None, 2):  # of 81 equal vectors
        scored.clear()
        found = P.best_rows(q, v, 3, None, cap, "label")
        assert len(found) == 3 * len(q) and sum(scored) <= (10 if cap is None else 60) * len(q)
    x = P.Vectors(v.column("embedding"))
    assert len(set(P.classes(x))) == len({tuple(r) for r in x.values.tolist()}) == 100


def test_merged_queries_score_by_products(spark):
    assert scored_by_products(spark, "multi_query_merge")


def test_filtered_search_scores_by_products(spark):
    assert scored_by_products(spark, "vector_topk_filtered")
