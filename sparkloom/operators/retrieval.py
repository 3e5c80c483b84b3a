"""Candidates for question sets: exact vector top-k, filtered and merged searches, lexical top-k, and a hashing scale path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.functions.arrays import numbered
from sparkloom.operators import overlaps as O
from sparkloom.operators import products as P
from sparkloom.operators.selection import keep_first, rank_within

POOL = 200
#: A question set up to this many bytes is broadcast; a larger one is dealt to the scan in blocks.
BROADCAST_BYTES = 32 << 20
#: Questions that every task of a lexical search holds, and documents of a group that more of them meet.
QUESTION_BYTES, GROUP_BYTES = 4 << 20, 32 << 20


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in the order of the places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def size_of(rows: DataFrame) -> int:
    """Bytes of all rows, as JSON."""
    return rows.select(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))).alias("b")).first()["b"] or 0


def pair_up(queries: DataFrame, rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Every query beside every row of the scan: the stated query set is broadcast while its measured size allows it.

    A larger one is dealt to blocks of at most about that size, the rows to as many groups as there are shuffle partitions, and one
    join on (block, group) sets every block beside every group. The plan is of one size, however many blocks there are.
    """
    blocks = max(1, -(-size_of(queries) // most))
    if blocks == 1:
        return rows.join(F.broadcast(queries), F.lit(True))
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda df, n: F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(n)).cast("int")
    dealt = queries.withColumn("_block", spread(queries, blocks)).withColumn("_group", every(groups))
    grouped = rows.withColumn("_group", spread(rows, groups)).withColumn("_block", every(blocks))
    return grouped.join(dealt.hint("merge"), ["_block", "_group"]).drop("_block", "_group")


def top_k(scored: DataFrame, k: int, key: str, order: list[Column]) -> DataFrame:
    """The first k of each key in the order, with their rank. Spark cuts each task's rows to k before the exchange."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def vector_scores(queries: DataFrame, vectors: DataFrame, where: Column | None = None) -> DataFrame:
    """Exact cosines of queries (qid, qvec) and the vectors (vec_id, embedding, ...) that pass the metadata filter."""
    rows = vectors.filter(where) if where is not None else vectors
    rows = rows.withColumn("_norm", norm(F.col("embedding")))
    both = pair_up(queries.withColumn("_qnorm", norm(F.col("qvec"))), rows)
    size = F.col("_norm") * F.col("_qnorm")
    score = F.when(size == 0, 0.0).otherwise(dot(F.col("qvec"), F.col("embedding")) / size)
    return both.withColumn("embed_score", F.round(score, 6)).drop("_norm", "_qnorm", "qvec", "embedding")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = POOL, where: Column | None = None) -> DataFrame:
    """Exact cosine top-k: queries (qid, qvec) against vectors (vec_id, embedding, ...), after the metadata filter."""
    found = P.search(queries, vectors.filter(where) if where is not None else vectors, k)
    return top_k(found, k, "qid", [F.desc("embed_score"), F.asc("vec_id")])


def diverse_top_k(queries: DataFrame, vectors: DataFrame, k: int, cap: int, cap_key: str) -> DataFrame:
    """Exact cosine top-k with at most ``cap`` rows of a value of cap_key for each query; their place.

    A row among the first k has no more rows before it in its own group of vectors than in all, so the groups' first k are enough.
    """
    order = [F.desc("embed_score"), F.asc("vec_id")]
    few = rank_within(P.search(queries, vectors, k, cap, cap_key), ["qid", cap_key], order, "_n").filter(F.col("_n") <= cap).drop("_n")
    return rank_within(few, ["qid"], order, "place").filter(F.col("place") <= k)


def merge_queries(found: DataFrame, k: int) -> DataFrame:
    """Results of sub-queries (qid, sub, vec_id, embed_score) as one list a question: a candidate once, at its first place."""
    first = keep_first(found, ["qid", "vec_id"], ["sub", "rank"])
    return top_k(first.drop("rank"), k, "qid", [F.desc("embed_score"), F.asc("sub"), F.asc("vec_id")])


def sub_queries(questions: DataFrame) -> DataFrame:
    """Questions (qid, query) with two or more terms as one sub-query a term, "query (term)"; others as they are."""
    terms = X.all_terms(F.col("query"))
    texts = F.when(F.size(terms) >= 2, F.transform(terms, lambda t: F.concat(F.col("query"), F.lit(" ("), t, F.lit(")")))).otherwise(F.array("query"))
    return questions.select("qid", "query", F.posexplode(texts).alias("sub", "sub_query"))


def capped(scored: DataFrame, k: int, cap: int | None, cap_key: str) -> DataFrame:
    """The first k documents of each question by score, then doc_id, at most ``cap`` of a source each; with their rank."""
    order = [F.desc("score"), F.asc("doc_id")]
    if cap:
        scored = scored.withColumn("_n", F.row_number().over(Window.partitionBy("qid", cap_key).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")
    return top_k(scored, k, "qid", order)


def filled(best: DataFrame, queries: DataFrame, docs: DataFrame, k: int, cap: int | None, cap_key: str) -> DataFrame:
    """``capped`` results with documents of score 0 behind them where fewer than k share a token.

    Fewer than k sources are then in the results, and a source that isn't full has fewer than ``cap`` hits, all of them among the
    results; so the first few documents of each source, and of those the first few, are enough.
    """
    rest = docs.drop("text")
    if cap:
        rest = top_k(rest, 2 * cap, cap_key, [F.asc("doc_id")]).drop("rank")
    few = rest.orderBy("doc_id").limit(2 * k * (cap or 1) + 2 * k).agg(F.collect_list(F.struct(*rest.columns)).alias("p"))
    none = queries.select("qid").withColumn("_p", few.scalar()).select("qid", F.explode("_p").alias("_d")).select("qid", "_d.*", F.lit(0.0).alias("score"))
    both = best.drop("rank").withColumn("_hit", F.lit(True)).unionByName(none.withColumn("_hit", F.lit(False)))
    known = F.max("_hit").over(Window.partitionBy("qid", "doc_id"))
    return capped(both.withColumn("_known", known).filter(F.col("_hit") | ~F.col("_known")).drop("_hit", "_known"), k, cap, cap_key)


def lexical_top_k(queries: DataFrame, docs: DataFrame, k: int, cap: int | None = None, cap_key: str = "source", chars: int | None = X.OVERLAP_CHARS) -> DataFrame:
    """Top-k documents by token overlap of queries (qid, query) with their first ``chars`` characters (None: whole), at most ``cap`` of a source each.

    Documents' tokens meet a table of the questions' tokens inside tasks, which give their few best documents a question. The questions
    go to every task while their measured size is at most QUESTION_BYTES; more of them are dealt to blocks, which meet groups of documents.
    """
    columns = [c for c in docs.columns if c != "text"]
    asked = queries.select("qid", X.tokenize(F.col("query")).alias("_q"))
    tokens = docs.select(*columns, X.tokenize(F.col("text") if chars is None else F.substring("text", 1, chars)).alias("_d"))
    schema = T.StructType([queries.schema["qid"], *[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType())])
    O.bound_batches(docs.sparkSession)
    size = size_of(asked)
    if size <= QUESTION_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(asked.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = O.Questions(shared.value).best((pa.Table.from_batches([b]) for b in batches), k, cap, cap_key)
            if best is not None:
                yield from best.select(schema.names).to_batches()

        scored = tokens.mapInArrow(run, schema)
    else:
        blocks = P.parts_of(size, QUESTION_BYTES)
        groups = P.parts_of(docs.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0, GROUP_BYTES)

        def meet(some: pa.Table, found: pa.Table) -> pa.Table:
            best = O.Questions(some).best((found.slice(i, O.BATCH_ROWS) for i in range(0, len(found), O.BATCH_ROWS)), k, cap, cap_key)
            return found.slice(0, 0).drop_columns(["_d"]).append_column("qid", some.column("qid").slice(0, 0)).append_column("score", pa.array([], pa.float64())) if best is None else best

        asked, tokens = asked.withColumn("_group", P.every(groups)), tokens.withColumn("_group", P.deal(tokens.select(*columns), groups, 2))
        scored = P.meet(asked, tokens, meet, schema, (blocks, groups))
    return filled(capped(scored, k, cap, cap_key), queries, docs, k, cap, cap_key)


def dedupe_candidates(rows: DataFrame) -> DataFrame:
    """Candidates once for each (question, url, heading, first 200 characters), at their best place."""
    return keep_first(rows.withColumn("_head", F.substring("text", 1, 200)), ["qid", "url", "section_heading", "_head"], [-F.col("embed_score"), "chunk_id"]).drop("_head")


class HashedVectors:
    """Approximate search for vector tables too large for an exact scan: random hyperplane codes in several tables.

    Every row is indexed. A query looks into the cells of its own code and those one bit away, in each table, and the
    candidates are scored exactly. Recall is measured against the exact search in the tests.
    """

    def __init__(self, dim: int, bits: int = 5, tables: int = 8, seed: int = 7):
        import numpy as np

        self.bits, self.tables = bits, tables
        self.planes = np.random.default_rng(seed).standard_normal((tables, bits, dim)).round(4).tolist()

    def codes(self, v: Column) -> Column:
        """array<int>: the code in each table."""
        out = []
        for planes in self.planes:
            code = F.lit(0)
            for b, plane in enumerate(planes):
                code = code + F.when(dot(v, F.array(*[F.lit(x) for x in plane])) > 0, 1 << b).otherwise(0)
            out.append(code)
        return F.array(*out)

    def index(self, vectors: DataFrame) -> DataFrame:
        """A row a vector and table: (table, code, vec_id), without the vectors; write it partitioned by table."""
        return vectors.select("vec_id", F.posexplode(self.codes(F.col("embedding"))).alias("table", "code"))

    def search(self, queries: DataFrame, index: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """A vector's codes join it by id; blocks of queries meet groups of vectors, and a task scores the pairs that share a cell."""
        codes = index.groupBy("vec_id").agg(F.collect_list(F.struct("table", "code")).alias("_codes"))
        asked = queries.select("qid", "qvec", self.codes(F.col("qvec")).alias("_asked"))
        found = P.search(asked, vectors.join(codes, "vec_id"), k, pairs=NearCodes(self.tables), extra=("_codes",))
        return top_k(found, k, "qid", [F.desc("embed_score"), F.asc("vec_id")])


class NearCodes:
    """Pairs of queries (``_asked``: a code a table) and vectors (``_codes``: table, code) whose codes differ by one bit at most in some table."""

    def __init__(self, tables: int):
        self.tables = tables

    def __call__(self, asked, found):
        import numpy as np
        import pyarrow.compute as pc

        own = np.asarray(pc.list_flatten(asked.column("_asked")), np.int32).reshape(len(asked), self.tables)
        row = np.asarray(pc.list_parent_indices(found.column("_codes")))
        table, code = (np.asarray(pc.struct_field(pc.list_flatten(found.column("_codes")), f), np.int32) for f in ("table", "code"))
        nth = P.places(np.lexsort((table, row)), row, table)  # an id that stands twice may have two codes
        theirs = np.full((int(nth.max(initial=0)) + 1, self.tables, len(found)), -1, np.int32)  # -1 is near no code
        theirs[nth, table, row] = code

        def near(here: slice):
            out = np.zeros((len(own[here]), len(found)), bool)
            for codes in theirs:
                for t in range(self.tables):
                    x = own[here, t][:, None] ^ codes[t][None, :]
                    out |= (x & (x - 1)) == 0
            return out

        yield np.arange(len(asked)), np.arange(len(found)), near
