"""Lexical top-k by tables of tokens against the overlap of every pair by expressions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import overlaps as O
from sparkloom.operators import retrieval as V


def by_pairs(q, docs, k, cap, chars):
    s = docs.crossJoin(q).withColumn("score", F.round(X.overlap_score(F.col("query"), F.col("text"), chars), 6))
    order = [F.desc("score"), F.asc("doc_id")]
    if cap:
        s = s.withColumn("n", F.row_number().over(Window.partitionBy("qid", "source").orderBy(*order))).filter(F.col("n") <= cap)
    return V.top_k(s, k, "qid", order)


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["doc_id"], str(r["source"]), f"{r['score']:.17g}") for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, words = np.random.default_rng(3), ["the", "a1", "Fox", "né", "x", "fall", "2025", "rare", "b-c", "İd"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, ["s", "t", "u", None][i % 4 if i % 3 else 0], text(int(rng.integers(1, 60)))) for i in range(150)]
    docs += [(200 + i, "copies", "the fox the fox 2025") for i in range(40)] + [(300, "t", None), (301, "t", ""), (302, "u", "!? é"), (303, "v", "the " * 3000 + "rare"), (-1, "s", "the fox the fox 2025")]
    asked = [(i, text(int(rng.integers(1, 12)))) for i in range(30)] + [(50, None), (51, ""), (52, "unknown words"), (53, "the the the the rare"), (54, "fox " * 300)]
    at = f"file://{tmp_path_factory.mktemp('lexical')}"
    spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3).write.parquet(f"{at}/d")
    return spark.createDataFrame(asked, "qid long, query string"), spark.read.parquet(f"{at}/d")


@pytest.mark.parametrize("most, side, features, rows", [(4 << 20, 256, 1 << 15, 2048), (4 << 20, 7, 50, 10), (300, 5, 50, 10)])
@pytest.mark.parametrize("k, cap, chars", [(5, 2, 2000), (4, None, None)])
def test_lexical_top_k_is_that_of_all_pairs(spark, tables, monkeypatch, most, side, features, rows, k, cap, chars):
    for at, name, n in ((V, "QUESTION_BYTES", most), (V, "GROUP_BYTES", 4000), (O, "SIDE", side), (O, "FEATURES", features), (O, "BATCH_ROWS", rows)):
        monkeypatch.setattr(at, name, n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    q, docs = tables
    found = V.lexical_top_k(q, docs, k, cap=cap, chars=chars)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroup" in plan if most == 300 else "MapInArrow" in plan
    assert rows_of(found) == rows_of(by_pairs(q, docs, k, cap, chars))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_tokens_and_pairs_are_not_shuffled(spark, tables):
    q, docs = tables
    for chars in (2000, None):
        plan = V.lexical_top_k(q, docs, 5, cap=2, chars=chars)._jdf.queryExecution().executedPlan().toString()
        assert "explode(_d" not in plan and "_same" not in plan
    some = O.Questions(q.select("qid", X.tokenize(F.col("query")).alias("_q")).toArrow())
    t = docs.select("doc_id", "source", X.tokenize(F.col("text")).alias("_d")).toArrow()
    assert len(some.best([t, t, t], 5, 2, "source")) <= 5 * q.count()


def test_registered_whole_search_shuffles_no_tokens(spark):
    from sparkloom.plans.queries import QUERIES
    from tests.conftest import DATA

    plan = QUERIES["lexical_topk_whole"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode(_d" not in plan and "_same" not in plan
