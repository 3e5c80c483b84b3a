"""Registered queries whose pages, markdown and files Spark derives from the given tables, so that their work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import answers as A
from sparkloom.operators import chunking as C
from sparkloom.operators import html as H
from sparkloom.operators import selection as S
from sparkloom.operators import tables as T
from sparkloom.operators.ivf import InvertedFile
from sparkloom.plans.queries import ORACLES, _classified, _queries_of, query, table
from sparkloom.sources import readers, snapshots


def _conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a conversation: each turn under an h2 with its role, so headings repeat."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.regexp_replace("text", "[^A-Za-z0-9]+", " ").alias("said")).alias("t"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<h2>"), t["role"], F.lit("</h2><p>turn "), t["turn"].cast("string"), F.lit(": "), t["said"], F.lit("</p>"))), "\n")
    return turns.select(F.concat(F.lit("https://talk.example.com/"), F.col("conv_id").cast("string")).alias("url"), F.concat(F.lit("<html><body><h1>Talk</h1><p>all turns</p>"), body, F.lit("</body></html>")).alias("html"))


@query("""WITH t AS (SELECT conv_id, turn, role, 'turn ' || turn || ': ' || trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT 'https://talk.example.com/' || conv_id || '#' || lower(role) AS url, role AS title, role || chr(10) || rtrim(said) AS text, CAST(n AS INTEGER) AS ordinal FROM t
UNION ALL SELECT DISTINCT 'https://talk.example.com/' || conv_id, 'Talk', 'Talk' || chr(10) || 'all turns', 0 FROM conversations""")
def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages whose headings repeat: one a heading, and the overview before the first."""
    return H.sections(H.parse_pages(_conversation_pages(spark, sf_dir))).select("url", "title", "text", "ordinal")


def _nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a region with one table: the region's name spans its nations' rows, two header rows span columns."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan='"), F.size("l").cast("string"), F.lit("'>"), F.col("r_name"), F.lit("</td>"))).otherwise(""), F.lit("<td>"), x["n_nationkey"].cast("string"), F.lit("</td><td>"), x["n_name"], F.lit("</td></tr>"))
    head = "<h2>Fall 2025 nations</h2><table><thead><tr><th rowspan=2>Region</th><th colspan=2>Nation</th></tr><tr><th>Key</th><th>Name</th></tr></thead>"
    return n.select(F.concat(F.lit("https://atlas.example.com/"), F.col("r_regionkey").cast("string")).alias("url"), F.concat(F.lit(head), F.array_join(F.transform("l", row), ""), F.lit("</table>")).alias("html"))


@query("""SELECT 'https://atlas.example.com/' || r_regionkey AS url, 'Fall 2025 nations' AS heading, '(''Region'', ''Region'')|(''Nation'', ''Key'')|(''Nation'', ''Name'')' AS headers,
CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_no, r_name || '|' || n_nationkey || '|' || n_name AS cells FROM nation JOIN region ON n_regionkey = r_regionkey""")
def spanning_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows of tables whose cells span rows and columns, under two header rows."""
    t = H.tables(H.parse_pages(_nation_pages(spark, sf_dir)))
    return t.select("url", "heading", F.array_join("headers", "|").alias("headers"), F.posexplode("rows").alias("row_no", "row")).select("url", "heading", "headers", "row_no", F.array_join("row", "|").alias("cells"))


@query("""SELECT p_partkey, 'Courses' || chr(10) || CASE p_partkey % 4
WHEN 0 THEN 'CSIT ' || (100 + p_partkey % 900) || ' ' || p_name || ' (' || (1 + p_size % 9) || ' credits)'
WHEN 1 THEN 'MATH ' || (100 + p_partkey % 900) || ' with lab ' || p_name
WHEN 2 THEN 'STAT ' || (100 + p_partkey % 900) || chr(10) || 'AMAT 101 ' || p_name || ' (3 credits)'
ELSE 'CSIT' || (100 + p_partkey % 900) || ' ' || p_name || chr(10) || 'a line' END || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE chr(10) END || chr(10) || 'end' AS md FROM part""")
def catalog_course_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course codes, titles and credits on lines of their own, made from parts, as one line each."""
    n, name = (100 + F.col("p_partkey") % 900).cast("string"), F.col("p_name")
    k, nl = F.col("p_partkey") % 4, F.lit("\n")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    md = (
        F.when(k == 0, say("CSIT ", n, "\n\n  ", name, " \n \n", (1 + F.col("p_size") % 9).cast("string"), nl))
        .when(k == 1, say("MATH ", n, " with lab\n", name, "\n\n"))
        .when(k == 2, say("STAT ", n, "\n\nAMAT 101\n", name, "\n3\n"))
        .otherwise(say("CSIT", n, nl, name, "\na line\n"))
    )
    md = F.concat(F.lit("Courses\n"), md, F.when(k == 1, "end").otherwise("\nend"))
    return table(spark, sf_dir, "part").select("p_partkey", C.normalize_courses(md).alias("md"))


@query("""SELECT url, CAST(page_id AS VARCHAR) AS lastmod, 'https://maps.example.com/' || (page_id % 7) || '.xml' AS sitemap FROM pages WHERE url IS NOT NULL AND trim(url) <> ''""")
def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps made from pages, with prefixes, comments, sections and entities, read as XML."""
    p = table(spark, sf_dir, "pages").filter("url is not null and trim(url) <> ''")
    escaped = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))
    entry = F.concat(F.lit("<s:url><!-- a page --><s:loc> "), F.when(F.col("page_id") % 2 == 0, escaped).otherwise(F.concat(F.lit("<![CDATA["), F.col("url"), F.lit("]]>"))), F.lit("\n</s:loc><s:lastmod>"), F.col("page_id").cast("string"), F.lit("</s:lastmod></s:url>"))
    maps = p.groupBy((F.col("page_id") % 7).alias("m")).agg(F.concat_ws("", F.collect_list(entry)).alias("x"))
    head = "<?xml version='1.0' encoding='UTF-8'?><s:urlset xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'>"
    files = maps.select(F.concat(F.lit("https://maps.example.com/"), F.col("m").cast("string"), F.lit(".xml")).alias("sitemap"), F.concat(F.lit(head), F.col("x"), F.lit("</s:urlset>")).alias("xml"))
    return readers.sitemap_urls(files).select("url", "lastmod", "sitemap")


@query()
def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 of the query set in the nearest cells of an inverted file."""
    v = table(spark, sf_dir, "embeddings")
    found = InvertedFile(v)
    index = found.index(v, snapshots.new_folder(spark, "cells"))
    return found.search(_queries_of(spark, sf_dir), index, 10).select("qid", "vec_id", "label", "embed_score", "rank")


@query("SELECT count(*) AS indexed, count(*) FILTER (vec_id % 20 = 0) AS queries, true AS enough FROM embeddings")
def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the inverted file, queries asked, and whether nine tenths of the exact top-10 are found."""
    from sparkloom.operators.retrieval import vector_top_k

    v = table(spark, sf_dir, "embeddings")
    found = InvertedFile(v)
    index = found.index(v, snapshots.new_folder(spark, "cells"))
    q = _queries_of(spark, sf_dir)
    exact = vector_top_k(q, v, 10).select("qid", "vec_id")
    hits = exact.join(found.search(q, index, 10).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    share = hits.agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"), F.countDistinct("qid").alias("queries"))
    return index.agg(F.count("*").alias("indexed")).join(share, F.lit(True)).select("indexed", "queries", "enough")


@query("SELECT r AS reason, coalesce(n, 0) AS n FROM (SELECT unnest(['kept', 'excluded', 'no_bucket', 'policy_not_listed']) AS r) LEFT JOIN (SELECT reason, n FROM (" + ORACLES["drop_reasons"] + ")) ON reason = r")
def drop_reasons_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons counted while the classified rows are written (here to nowhere), in one job."""
    from pyspark.sql import Observation

    seen = Observation("reasons")
    S.observed_reasons(_classified(spark, sf_dir), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(r, seen.get[r]) for r in S.REASONS], "reason string, n long")


def _sale_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a nation with its suppliers as rows; the columns' names differ from table to table."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("l"))
    key = F.col("s_nationkey").cast("string")
    rows = F.transform("l", lambda x: F.array(x["s_suppkey"].cast("string"), x["s_name"], F.concat(F.lit("Session B of Spring 2026 "), x["s_suppkey"].cast("string"))))
    headers = F.array(F.concat(F.lit("Key "), key), F.lit("Part of Term"), F.lit("Final Day to Withdraw"))
    return s.select(F.concat(F.lit("https://x.example.com/"), key).alias("url"), F.lit(0).alias("table_no"), F.when(F.col("s_nationkey") % 2 == 0, "Fall 2025 list").otherwise("").alias("heading"), headers.alias("headers"), rows.alias("rows"))


@query("""SELECT 'table_row' AS type, 'https://x.example.com/' || s_nationkey AS url, CASE WHEN s_nationkey % 2 = 0 THEN 'Fall 2025 list' ELSE 'Calendar' END AS section_heading,
'**Key ' || s_nationkey || ':** ' || s_suppkey || chr(10) || '**Part of Term:** ' || s_name || chr(10) || '**Final Day to Withdraw:** Session B of Spring 2026 ' || s_suppkey AS text,
CASE WHEN s_nationkey % 2 = 0 THEN 'Fall 2025' ELSE 'Spring 2026' END AS term, 'Session b' AS session, s_name AS "desc", 'Session B of Spring 2026 ' || s_suppkey AS final_withdraw, CAST(NULL AS VARCHAR) AS waitlist_ends, true AS has_deadline_words,
'| Key ' || s_nationkey || ' | Part of Term | Final Day to Withdraw |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || s_suppkey || ' | ' || s_name || ' | Session B of Spring 2026 ' || s_suppkey || ' |' AS full_md,
CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS row_no FROM supplier""")
def table_row_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row records of tables made from suppliers, every column."""
    return T.row_records(_sale_tables(spark, sf_dir)).select("type", "url", "section_heading", "text", "term", "session", "desc", "final_withdraw", "waitlist_ends", "has_deadline_words", "full_md", "row_no")


@query("SELECT 'https://x.example.com/' || s_nationkey AS url, CAST(s_suppkey AS VARCHAR) AS own, s_name AS part FROM supplier")
def table_summary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as VARIANT: each table's own column is found by its name."""
    v = T.table_summary(_sale_tables(spark, sf_dir))
    n = F.regexp_extract("url", r"(\d+)$", 1)
    row = F.from_json(F.to_json(F.variant_get("summary", "$.rows", "variant")), "array<map<string,string>>")
    return v.select("url", n.alias("k"), F.explode(row).alias("r")).select("url", F.col("r")[F.concat(F.lit("Key "), F.col("k"))].alias("own"), F.col("r")["Part of Term"].alias("part"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS opener FROM conversations)
SELECT conv_id, 'H1: Talk > H3: ' || opener || CASE WHEN n > 0 THEN ' > H3: ' || role ELSE '' END AS headings, 'turn ' || turn || ': ' || trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS text, n FROM t""")
def conversation_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading sections of markdown made from conversations: a level is skipped, headings repeat, lines end in two ways."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")).alias("said")).alias("t"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.concat(F.lit("### "), t["role"], F.lit("\r\n\nturn "), t["turn"].cast("string"), F.lit(": "), t["said"], F.lit("\n"))), "\n")
    secs = C.heading_sections(F.concat(F.lit("# Talk\n\n"), body))
    return turns.select("conv_id", F.posexplode(secs).alias("n", "s")).select("conv_id", F.array_join("s.headings", " > ").alias("headings"), "s.text", F.col("n").cast("long").alias("n"))


@query("""SELECT p_brand AS url, code, title, credits FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, code ORDER BY p_partkey) AS n FROM
(SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'CSIT ' ELSE 'MATH ' END || (100 + p_partkey % 700) AS code, p_name AS title, CAST(1 + p_size % 9 AS INTEGER) AS credits FROM part)) WHERE n = 1""")
def required_course_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required courses of lists made from parts, a brand a page: on one line or on three, up to the electives."""
    p = table(spark, sf_dir, "part").select("p_brand", F.struct("p_partkey", "p_name", "p_size").alias("x")).groupBy("p_brand").agg(F.sort_array(F.collect_list("x")).alias("l"))
    n, credits = lambda x: (100 + x["p_partkey"] % 700).cast("string"), lambda x: (1 + x["p_size"] % 9).cast("string")
    one = lambda x: F.when(x["p_partkey"] % 2 == 0, F.concat(F.lit("CSIT "), n(x), F.lit(" - "), x["p_name"], F.lit(" ("), credits(x), F.lit(" credits)"))).otherwise(F.concat(F.lit("math "), n(x), F.lit("\n\n"), x["p_name"], F.lit("\n"), credits(x)))
    text = F.concat(F.lit("CSIT 999 Before\nRequired Core Courses of all\n"), F.array_join(F.transform("l", one), "\n"), F.lit("\nElectives\nCSIT 998 Behind (3 credits)"))
    return A.required_courses(p.select(F.col("p_brand").alias("url"), text.alias("text")))
