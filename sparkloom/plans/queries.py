"""The registered queries of the engine's operators, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import urls as U
from sparkloom.operators import answers as A
from sparkloom.operators import chunking as C
from sparkloom.operators import discovery as D
from sparkloom.operators import html as H
from sparkloom.operators import ranking as R
from sparkloom.operators import retrieval as V
from sparkloom.operators import selection as S
from sparkloom.operators import tables as T
from sparkloom.plans import fixtures as X_
from sparkloom.plans.fixtures import frame, values
from sparkloom.sources import readers, writers
from sparkloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_SHARED = "coalesce(list_sum(list_transform(list_distinct({q}), lambda w: least(len(list_filter({q}, lambda x: x = w)), len(list_filter({d}, lambda x: x = w))))), 0)"


def _overlap(q: str, d: str) -> str:
    return f"CASE WHEN len({q}) * len({d}) = 0 THEN 0.0 ELSE {_SHARED.format(q=q, d=d)} / sqrt(CAST(len({q}) * len({d}) AS DOUBLE)) END"


_PAIRS = f"""q AS (SELECT item_id, {_TOK.format('text')} AS qt FROM benchmark),
d AS (SELECT doc_id, source, {_TOK.format('substring(text, 1, 2000)')} AS dt FROM documents)"""


@query(f"""WITH {_PAIRS}, s AS (SELECT item_id AS qid, doc_id, source, round({_overlap('qt', 'dt')}, 6) AS score FROM q, d),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id) AS n FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM c WHERE n <= 2)
SELECT qid, doc_id, source, score, rank FROM r WHERE rank <= 5""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every benchmark text against all documents by token overlap, at most two of a source, top 5."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return V.lexical_top_k(q, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), 5, cap=2).select("qid", "doc_id", "source", "score", "rank")


@query(f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
t AS (SELECT conv_id, turn, {_TOK.format('prev')} AS q, {_TOK.format('substring(text, 1, 2000)')} AS d FROM c WHERE prev IS NOT NULL)
SELECT conv_id, turn, len(q) AS n_query, len(d) AS n_doc, round({_overlap('q', 'd')}, 6) AS score FROM t""")
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's overlap with the turn before it."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    return c.select("conv_id", "turn", F.size(X.tokenize(F.col("prev"))).cast("long").alias("n_query"), F.size(X.tokenize(F.substring("text", 1, 2000))).cast("long").alias("n_doc"), F.round(X.overlap_score(F.col("prev"), F.col("text")), 6).alias("score"))


_WHOLE = ("substring(text, 1, 2000)", "text")


@query(ORACLES["lexical_topk"].replace(*_WHOLE))
def lexical_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexical_topk over whole texts."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return V.lexical_top_k(q, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), 5, cap=2, chars=None).select("qid", "doc_id", "source", "score", "rank")


@query(ORACLES["overlap_score"].replace(*_WHOLE))
def overlap_score_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlap_score over whole texts."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    return c.select("conv_id", "turn", F.size(X.tokenize(F.col("prev"))).cast("long").alias("n_query"), F.size(X.tokenize(F.col("text"))).cast("long").alias("n_doc"), F.round(X.overlap_score(F.col("prev"), F.col("text"), None), 6).alias("score"))


_NORM = r"trim(regexp_replace(lower({}), '[\s\x{{00a0}}\x{{0085}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
t AS (SELECT conv_id, turn, list_filter(string_split({_NORM.format('prev')}, ' '), lambda x: x <> '') AS q, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '') AS d FROM c WHERE prev IS NOT NULL),
s AS (SELECT *, {_SHARED.format(q='q', d='d')} AS same FROM t)
SELECT conv_id, turn, round(CASE WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (len(q) + len(d)) END, 6) AS f1 FROM s""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    return c.select("conv_id", "turn", F.round(X.token_f1(F.col("prev"), F.col("text")), 6).alias("f1"))


#: Questions: the fixtures', and each conversation's first turn behind one of their phrases, so that the work grows with the table.
_ASKED = values("fq", "k, phrase", [(i, t) for i, (_, t) in enumerate(X_.INTENT_QUERIES)]) + """, ft AS (SELECT conv_id, coalesce(arg_min(text, turn), '') AS opening FROM conversations GROUP BY conv_id),
fa AS (SELECT conv_id, 1000 + conv_id AS qid, phrase || ' ' || opening AS query FROM ft JOIN fq ON k = conv_id % 12)"""
_INTENT_Q = _ASKED + ", " + values("q0", "qid, query", X_.INTENT_QUERIES) + ", q AS (SELECT * FROM q0 UNION ALL SELECT qid, query FROM fa)"
_TITLE = "list_transform({}, lambda t: upper(t[1]) || lower(regexp_replace(substring(t, 2), '\\s+', ' ', 'g')))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, qid, query of each conversation."""
    phrases = F.broadcast(frame(spark, "k int, phrase string", [(i, t) for i, (_, t) in enumerate(X_.INTENT_QUERIES)]))
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("opening"))
    return first.join(phrases, F.col("conv_id") % 12 == F.col("k")).select("conv_id", (F.col("conv_id") + 1000).alias("qid"), F.concat("phrase", F.lit(" "), "opening").alias("query"))


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "qid long, query string", X_.INTENT_QUERIES).unionByName(_asked(spark, sf_dir).select("qid", "query"))


def _terms_sql(c: str) -> str:
    found = _TITLE.format(f"regexp_extract_all({c}, '(?i)(fall|spring|summer|winter)\\s+20\\d{{2}}')")
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


@query(f"WITH {_INTENT_Q}, t AS (SELECT qid, {_terms_sql('query')} AS l FROM q) SELECT qid, len(l) AS n_terms, array_to_string(l, '|') AS terms, coalesce(nullif(regexp_extract(l[1], '(20\\d\\d)', 1), ''), '') AS first_year FROM t")
def term_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.all_terms(F.col("query"))
    return _intents(spark, sf_dir).select("qid", F.size(t).cast("long").alias("n_terms"), F.array_join(t, "|").alias("terms"), F.coalesce(X.term_year(F.get(t, F.lit(0))), F.lit("")).alias("first_year"))


@query(f"""WITH {values('t0', 'id, text', X_.TEXTS)}, t AS (SELECT * FROM t0 UNION ALL SELECT 1000 + doc_id, text FROM documents WHERE text IS NOT NULL),
a AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '\\r', '', 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x, text FROM t)
SELECT id, trim(array_to_string(list_transform(string_split(x, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(11) || chr(12))), chr(10)), ' ' || chr(10) || chr(9)) AS pdf_text,
coalesce(nullif(regexp_replace(regexp_replace(lower(trim(text, ' ' || chr(10) || chr(13))), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), ''), 'section') AS slug,
regexp_matches(text, '\\|.+\\|.+\\|') AS is_table, sha1(text) AS sha1, 'kb:' || substring(sha1(text), 1, 12) AS kb_id,
CASE WHEN length(text) > 10 THEN substring(text, 1, 10) || '…' ELSE text END AS snippet FROM a""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF text, slugs, table test, hashes and snippets of fixtures and of whole documents."""
    c = F.col("text")
    slug = X.slugify(F.regexp_replace(c, r"^\s+|\s+$", ""))
    texts = frame(spark, "id long, text string", X_.TEXTS).unionByName(table(spark, sf_dir, "documents").filter("text is not null").select((F.col("doc_id") + 1000).alias("id"), "text"))
    return texts.select("id", X.clean_pdf_text(c).alias("pdf_text"), slug.alias("slug"), X.is_table_block(c).alias("is_table"), F.sha1(c).alias("sha1"), X.answer_id(c).alias("kb_id"), X.snippet(c, 10).alias("snippet"))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, length(text) AS n, text FROM documents),
c AS (SELECT doc_id, n, text, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x))) + (i - 1)) AS ends FROM s),
k AS (SELECT doc_id, n, text, coalesce(list_max(list_filter(ends, lambda e: e <= 600)), 0) AS fit FROM c)
SELECT doc_id, sha1(CASE WHEN n <= 600 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN fit > 0 THEN regexp_replace(substring(text, 1, CAST(fit AS BIGINT)), '^\\s+|\\s+$', '', 'g') ELSE substring(text, 1, 600) END) AS kept_sha1 FROM k""")
def trim_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document fits 600 characters by whole lines (lines stand for paragraphs here)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.trim_answer(F.col("text"), 600, "\n")).alias("kept_sha1"))


# ---------------------------------------------------------------- URLs

_HOST = "lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]+)', 1))"
_PATH = "regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
_NORM_URL = """CASE WHEN host LIKE '%{plain}' THEN 'http' WHEN host LIKE '%{domain}' THEN 'https' END || '://' || host ||
CASE WHEN path <> '' AND path NOT LIKE '%/' AND NOT contains(string_split(path, '/')[-1], '.') THEN path || '/' ELSE path END"""
_PAGE_URLS = f"u AS (SELECT page_id, url, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM pages)"


@query(f"""WITH {_PAGE_URLS} SELECT page_id, {_NORM_URL.format(plain='tiontion.example.com', domain='example.com')} AS norm_url, host, path,
regexp_replace(url, '[?#].*$', '') AS bare_url, rtrim(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\\?.*$', ''), '/') AS audit_path,
'raw/' || CASE WHEN regexp_replace(path, '^/+', '') = '' OR path LIKE '%/' THEN regexp_replace(path, '^/+', '') || 'index' ELSE regexp_replace(path, '^/+', '') END AS file_path FROM u""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(u, "example.com", "tiontion.").alias("norm_url"), U.host_of(u).alias("host"), U.path_of(u).alias("path"), U.without_query(u).alias("bare_url"), U.audit_path(u).alias("audit_path"), U.file_path(u, "raw").alias("file_path"))


BUCKETS = (
    S.Bucket("english", (r"^/en/($|[^?]+)",), (r"^/en/[0-9]*[05]/?$", r"\.html$")),
    S.Bucket("romance", (r"^/(fr|es)/",)),
    S.Bucket("german", (r"^/de/", r"^/fr/1")),
)
EXCLUDED = (r"/9\d\d(/|\.html)?$", r"/feed/$")
ALLOWED_ENGLISH = (r"^/en/[1-6]",)
_BUCKET_SQL = r"""CASE WHEN regexp_matches(path, '^/en/($|[^?]+)') THEN CASE WHEN NOT (regexp_matches(path, '^/en/[0-9]*[05]/?$') OR regexp_matches(path, '\.html$')) THEN 'english' END
WHEN regexp_matches(path, '^/(fr|es)/') THEN 'romance' WHEN regexp_matches(path, '^/de/') OR regexp_matches(path, '^/fr/1') THEN 'german' END"""
_REASON = r"""CASE WHEN regexp_matches(path, '/9\d\d(/|\.html)?$') OR regexp_matches(path, '/feed/$') THEN 'excluded' WHEN bucket IS NULL THEN 'no_bucket'
WHEN bucket = 'english' AND NOT regexp_matches(path, '^/en/[1-6]') THEN 'policy_not_listed' ELSE 'kept' END"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.classify(table(spark, sf_dir, "pages").select("page_id", "url"), BUCKETS, EXCLUDED, "english", ALLOWED_ENGLISH)


@query(f"WITH {_PAGE_URLS}, b AS (SELECT page_id, path, {_BUCKET_SQL} AS bucket FROM u) SELECT page_id, path, bucket, {_REASON} AS reason FROM b")
def url_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("page_id", "path", "bucket", "reason")


@query(f"WITH {_PAGE_URLS}, b AS (SELECT page_id, path, {_BUCKET_SQL} AS bucket FROM u) SELECT {_REASON} AS reason, count(*) AS n FROM b GROUP BY 1")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reason_counts(_classified(spark, sf_dir))


@query(f"""WITH {values('r', 'url, lastmod, source, ordinal', X_.URL_ROWS)}, h AS (SELECT *, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM r),
n AS (SELECT {_NORM_URL.format(plain='catalog.example.com', domain='example.com')} AS url, lastmod, source, ordinal FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE source WHEN 'sitemap' THEN 1 WHEN 'discovered' THEN 2 ELSE 3 END, ordinal) AS rn FROM n WHERE url IS NOT NULL)
SELECT url, lastmod, source, ordinal FROM k WHERE rn = 1""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL rows of three sources, normalised, the first of each URL kept."""
    r = frame(spark, "url string, lastmod string, source string, ordinal int", X_.URL_ROWS)
    return S.merge_sources(r.withColumn("url", U.normalize_url(F.col("url"), "example.com")))


@query(f"""WITH {_PAGE_URLS}, k AS (SELECT page_id, url, host, regexp_replace(path, '(\\.html|/)$', '') AS key FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS rn FROM k) SELECT key, page_id, host FROM f WHERE rn = 1""")
def page_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages once a path, the smallest id kept."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(U.path_of(F.col("url")), r"(\.html|/)$", "").alias("key"), "page_id", U.host_of(F.col("url")).alias("host"))
    return S.keep_first(p, ["key"], ["page_id"])


_SKIPPED = " AND ".join(f"NOT contains(sitemap, '{x}')" for x in readers.SKIPPED_SITEMAPS)


@query(rf"""WITH {values('f', 'sitemap, xml', X_.SITEMAPS)}, i AS (SELECT unnest(regexp_extract_all(xml, '(?s)<sitemap>.*?</sitemap>')) AS e FROM f WHERE sitemap LIKE '%sitemap_index.xml'),
c AS (SELECT trim(regexp_extract(e, '(?s)<loc>(.*?)</loc>', 1)) AS sitemap FROM i), k AS (SELECT DISTINCT sitemap FROM c WHERE {_SKIPPED} UNION SELECT 'https://uni.example.com/broken.xml'),
e AS (SELECT sitemap, regexp_extract_all(xml, '(?s)<url>.*?</url>') AS es FROM k JOIN f USING (sitemap)), x AS (SELECT sitemap, es, unnest(range(len(es))) AS ordinal FROM e),
v AS (SELECT sitemap, ordinal, trim(regexp_extract(es[ordinal + 1], '(?s)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>', 1)) AS raw, trim(regexp_extract(es[ordinal + 1], '(?s)<lastmod>(.*?)</lastmod>', 1)) AS lastmod FROM x)
SELECT sitemap, replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS url, lastmod, CAST(ordinal AS INTEGER) AS ordinal FROM v WHERE raw <> ''""")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index expanded to its children, their URLs; users and taxonomies are left out, a broken file gives none."""
    files = frame(spark, "sitemap string, xml string", X_.SITEMAPS)
    start = frame(spark, "sitemap string", [("https://uni.example.com/sitemap_index.xml",), ("https://uni.example.com/broken.xml",)])
    return readers.sitemap_urls(readers.expand_sitemaps(start, files).join(files, "sitemap"))


# ---------------------------------------------------------------- chunks

_SQUEEZED = r"trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_WINDOWS = f"""t AS (SELECT doc_id, {_SQUEEZED} AS x FROM documents), l AS (SELECT doc_id, x, length(x) AS n FROM t),
w AS (SELECT doc_id, x, n, unnest(CASE WHEN n <= 2400 THEN [0] ELSE list_transform(range(0, CAST(ceil((n - 1200) / 1000.0) AS BIGINT) + 1), lambda i: i * 1000) END) AS s FROM l)"""
_NB = r"'^[^ \t\n\r\f\v.,;:!?)\]]*'"
_SLICED = f"""{_WINDOWS}, e AS (SELECT *, least(s + 1200, n) AS en FROM w),
p AS (SELECT *, length(regexp_extract(substring(x, s + 1, 40), {_NB})) AS lead, length(regexp_extract(reverse(substring(x, greatest(en - 40, 0) + 1, en - greatest(en - 40, 0))), {_NB})) AS trail FROM e),
b AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN lead < least(40, n - s) THEN s + lead + 1 ELSE s END AS lo, CASE WHEN en = n THEN n WHEN trail < en - greatest(en - 40, 0) THEN en - trail ELSE en END AS hi FROM p),
c AS (SELECT doc_id, s, n, CASE WHEN n <= 2400 THEN x WHEN lo < hi THEN substring(x, lo + 1, hi - lo) ELSE substring(x, greatest(s - 40, 0) + 1, least(en + 40, n) - greatest(s - 40, 0)) END AS raw FROM b),
f AS (SELECT doc_id, CAST(s / 1000 AS INTEGER) AS piece, CASE WHEN n <= 2400 THEN raw ELSE trim(raw, ' ' || chr(10) || chr(9) || chr(13)) END AS chunk FROM c)"""


@query(f"WITH {_SLICED} SELECT doc_id, piece, length(chunk) AS n_chars, sha1(chunk) AS chunk_sha1 FROM f")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's windows (1200/200), ends moved to word boundaries."""
    d = table(spark, sf_dir, "documents").select("doc_id", C.squeeze(F.col("text")).alias("x")).filter("x is not null")
    w = d.select("doc_id", F.posexplode(C.windows(F.col("x"))).alias("piece", "chunk"))
    return w.select("doc_id", "piece", F.length("chunk").cast("long").alias("n_chars"), F.sha1("chunk").alias("chunk_sha1"))


@query(f"WITH {_SLICED}, i AS (SELECT 'sha1:' || sha1('doc/' || doc_id || '::' || '::' || (piece + 1)) AS id, doc_id, piece, chunk FROM f) SELECT id, min(doc_id) AS doc_id, min(piece) AS piece FROM i GROUP BY id")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids, kept first."""
    d = table(spark, sf_dir, "documents").select("doc_id", C.squeeze(F.col("text")).alias("x")).filter("x is not null")
    # an id needs a window's number only, so no window's text is made
    starts = F.when(F.length("x") <= 2 * C.TARGET, F.array(F.lit(0))).otherwise(C.window_starts(F.col("x"), C.TARGET, C.OVERLAP))
    w = d.select("doc_id", F.posexplode(starts).alias("piece", "start"))
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return S.keep_first(w.select(X.chunk_id(url, F.array().cast("array<string>"), F.col("piece") + 1).alias("id"), "doc_id", "piece"), ["id"], ["doc_id", "piece"])


_FOLD = """list_reduce(list_prepend({{'p': CAST([] AS VARCHAR[]), 'o': '', 'n': 0}}, list_transform(lines, lambda x: {{'p': CAST([] AS VARCHAR[]), 'o': x, 'n': 0}})),
lambda a, x: CASE WHEN regexp_matches(x.o, '^#{{1,6}}\\s+\\S') THEN {{'p': a.p[1:length(regexp_extract(x.o, '^#+')) - 1] || ['H' || length(regexp_extract(x.o, '^#+')) || ': ' || trim(regexp_extract(x.o, '^#+\\s+(.*)$', 1))], 'o': '', 'n': a.n + 1}} ELSE {{'p': a.p, 'o': '', 'n': a.n}} END)"""
_SECTIONS = f"""{values('m', 'source_url, source_title, bucket, tags, md', X_.MD_DOCS)},
l AS (SELECT source_url, string_split(md, chr(10)) AS ls FROM m), u AS (SELECT source_url, unnest(range(1, len(ls) + 1)) AS i, ls FROM l),
g AS (SELECT source_url, i, ls[i] AS line, {_FOLD.format().replace('lines', 'ls[1:i]')} AS st FROM u),
s AS (SELECT source_url, st.n AS sec, any_value(array_to_string(st.p, ' > ')) AS headings, trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(line, '^#{{1,6}}\\s+\\S')), ' ' || chr(10)) AS text FROM g GROUP BY 1, 2)"""


@query(f"WITH {_SECTIONS} SELECT source_url, headings, text, row_number() OVER (PARTITION BY source_url ORDER BY sec) AS n FROM s WHERE text <> ''")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown to sections under their heading paths."""
    d = frame(spark, X_.MD_SCHEMA, X_.MD_DOCS).select("source_url", F.posexplode(C.heading_sections(F.col("md"))).alias("i", "s"))
    return d.select("source_url", F.array_join("s.headings", " > ").alias("headings"), F.col("s.text").alias("text"), (F.col("i") + 1).cast("long").alias("n"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents to chunks with ids and metadata."""
    return C.chunk_documents(frame(spark, X_.MD_SCHEMA, X_.MD_DOCS))


_COURSE = r"'^CSIT\s+(\d{3})\s+(.*?)\s*\((\d+)\s+credits?\)\s*$'"


@query(rf"""WITH {values('d', 'url, md', X_.COURSE_DOCS)}, l AS (SELECT url, string_split(md, chr(10)) AS ls FROM d), u AS (SELECT url, unnest(range(len(ls))) AS i, ls FROM l),
h AS (SELECT url, i, ls[i + 1] AS line, trim(regexp_replace(regexp_replace(replace(ls[i + 1], chr(160), ' '), '^\s*\*\*(.*?)\*\*\s*$', '\1'), '\s+', ' ', 'g')) AS head FROM u),
g AS (SELECT *, regexp_matches(head, {_COURSE}) AS starts, sum(CAST(regexp_matches(head, {_COURSE}) AS INTEGER)) OVER (PARTITION BY url ORDER BY i) AS n FROM h)
SELECT url, regexp_extract(any_value(head) FILTER (starts), {_COURSE}, 1) AS number, regexp_extract(any_value(head) FILTER (starts), {_COURSE}, 2) AS title, CAST(regexp_extract(any_value(head) FILTER (starts), {_COURSE}, 3) AS INTEGER) AS credits,
regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT starts), ''), '^\s+|\s+$', '', 'g') AS body, CAST(n - 1 AS INTEGER) AS ordinal FROM g WHERE n > 0 GROUP BY url, n""")
def course_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_courses(frame(spark, "url string, md string", X_.COURSE_DOCS))


# ---------------------------------------------------------------- vectors

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = f"round({_DOT.format(a='q.embedding', b='v.embedding')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='v.embedding', b='v.embedding')})), 6)"


def _queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: vectors whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _vector_sql(where: str = "", k: int = 5) -> str:
    return f"s AS (SELECT q.vec_id AS qid, v.vec_id, v.label, {_COS} AS embed_score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings v {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY embed_score DESC, vec_id) AS rank FROM s)"


@query(f"WITH {_vector_sql()} SELECT qid, vec_id, label, embed_score, rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-10 of the query set against all vectors."""
    return V.vector_top_k(_queries_of(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10).select("qid", "vec_id", "label", "embed_score", "rank")


@query(f"WITH {_vector_sql('WHERE v.label = 3')} SELECT qid, vec_id, label, embed_score, rank FROM r WHERE rank <= 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a metadata filter, which reaches the scan."""
    return V.vector_top_k(_queries_of(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, F.col("label") == 3).select("qid", "vec_id", "label", "embed_score", "rank")


@query(f"""WITH {_vector_sql()}, p AS (SELECT CAST(floor(qid / 100) AS BIGINT) AS qid, qid AS sub, vec_id, embed_score, rank FROM r WHERE rank <= 10),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY sub, rank) AS n FROM p),
o AS (SELECT qid, sub, vec_id, embed_score, row_number() OVER (PARTITION BY qid ORDER BY embed_score DESC, sub, vec_id) AS rank FROM f WHERE n = 1) SELECT * FROM o WHERE rank <= 20""")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring queries as sub-queries of one question, their results merged."""
    r = V.vector_top_k(_queries_of(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10)
    p = r.select(F.floor(F.col("qid") / 100).alias("qid"), F.col("qid").alias("sub"), "vec_id", "embed_score", "rank")
    return V.merge_queries(p, 20).select("qid", "sub", "vec_id", "embed_score", "rank")


@query()
def vector_topk_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate path: hyperplane codes in several tables, exact scores of what they find."""
    v = table(spark, sf_dir, "embeddings")
    h = V.HashedVectors(64)
    return h.search(_queries_of(spark, sf_dir), h.index(v), v, 10).select("qid", "vec_id", "embed_score", "rank")


@query(f"""WITH {_vector_sql()}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM r),
k AS (SELECT qid, vec_id, label, embed_score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM c WHERE n <= 2) SELECT * FROM k WHERE place <= 6""")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two of a label, top 6."""
    found = V.diverse_top_k(_queries_of(spark, sf_dir), table(spark, sf_dir, "embeddings"), 6, 2, "label")
    return found.select("qid", "vec_id", "label", "embed_score", "place")


# ---------------------------------------------------------------- ranking

_INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{'|'.join(p)}') THEN '{n}'" for n, p in R.INTENTS.items())
_ANY = lambda c, ws: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"
_TERM_SQL = r"regexp_matches(lower(query), '(fall|spring|summer|winter)\s+(20\d{2})')"
_INTENT_SQL += f" WHEN {_TERM_SQL} AND {_ANY('query', R.CALENDAR_UNITS)} AND {_ANY('query', R.CALENDAR_WORDS)} AND NOT {_ANY('query', R.WITHDRAWISH)} THEN 'calendar' WHEN {_TERM_SQL} AND {_ANY('query', R.DEADLINE_QUESTION)} THEN 'deadline' ELSE 'default' END"


@query(f"""WITH {_INTENT_Q} SELECT qid, query, {_INTENT_SQL} AS intent, regexp_matches(lower(query), '{R.DETECTORS['d_req'][1].replace("'", "''")}') AND (regexp_matches(lower(query), '{R.DETECTORS['d_ms'][1].replace("'", "''")}') OR regexp_matches(lower(query), '{R.DETECTORS['d_grad_cs'][1]}')) AS is_requirements,
regexp_matches(lower(query), '{R.DETECTORS['d_credits'][1]}') AS is_degree_credits FROM q""")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return _intents(spark, sf_dir).select("qid", "query", R.detect_intent(q).alias("intent"), R.is_requirements_question(q).alias("is_requirements"), R.is_degree_credits_question(q).alias("is_degree_credits"))


#: Candidates: the fixtures', and every turn of a conversation behind the text, under the address, of one of the fixtures' pages.
_PAGES_OF_FIXTURES = [(r[2], r[5], r[6], r[7], *r[8]) for r in X_.candidates()[:12]]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.broadcast(frame(spark, "k int, url string, said string, section_heading string, bucket string, term string, is_table boolean, has_deadline_words boolean", _PAGES_OF_FIXTURES))
    c = table(spark, sf_dir, "conversations").join(_asked(spark, sf_dir), "conv_id")
    c = c.join(near, (F.col("turn") * 5 + F.floor(F.col("conv_id") / 12)) % 12 == F.col("k"))
    turn, conv = F.col("turn"), F.col("conv_id")
    scores = ((turn * 7 + conv * 3) % 10 / 10).alias("embed_score"), ((turn * 5 + conv) % 4 / 4).alias("bm25")
    made = c.select("qid", "query", turn.alias("chunk_id"), *scores, "url", F.concat("said", F.lit(" "), "text").alias("text"), "section_heading", F.struct("bucket", "term", "is_table", "has_deadline_words").alias("meta"))
    return frame(spark, X_.CANDIDATE_SCHEMA, X_.candidates()).withColumns({"qid": F.col("qid").cast("long"), "chunk_id": F.col("chunk_id").cast("long")}).unionByName(made)


def _flat_candidates() -> str:
    rows = [(*r[:8], *r[8]) for r in X_.candidates()]
    columns = "qid, query, chunk_id, embed_score, bm25, url, text, section_heading, b, term, t, w"
    made = """raw AS (SELECT * FROM raw0 UNION ALL SELECT fa.qid, fa.query, c.turn, CAST((c.turn * 7 + c.conv_id * 3) % 10 AS DOUBLE) / 10, CAST((c.turn * 5 + c.conv_id) % 4 AS DOUBLE) / 4, p.url, p.said || ' ' || c.text, p.section_heading, p.b, p.term, p.t, p.w
FROM conversations c JOIN fa USING (conv_id) JOIN fp p ON p.k = (c.turn * 5 + c.conv_id // 12) % 12)"""
    return ", ".join([_ASKED, values("fp", "k, url, said, section_heading, b, term, t, w", _PAGES_OF_FIXTURES), values("raw0", columns, rows), made])


def _season(c: str) -> str:
    return f"regexp_extract(lower({c}), '(fall|spring|summer|winter)\\s+(20\\d\\d)', 1)"


def _year(c: str) -> str:
    return f"regexp_extract(lower({c}), '(fall|spring|summer|winter)\\s+(20\\d\\d)', 2)"


_POINTS = f"list_transform(terms, lambda t: CASE WHEN {_year('t')} = '' OR {_year('src')} = '' THEN 0.0 WHEN {_season('t')} = {_season('src')} AND {_year('t')} = {_year('src')} THEN 2.5 WHEN {_year('t')} = {_year('src')} THEN -1.0 ELSE -1.5 END)"
_BW = "CASE intent " + " ".join(f"WHEN '{i}' THEN CASE bucket " + " ".join(f"WHEN '{b}' THEN {w}" for b, w in t.items()) + " ELSE 1.0 END" for i, t in R.BUCKET_WEIGHTS.items() if i != "default") + " ELSE CASE bucket " + " ".join(f"WHEN '{b}' THEN {w}" for b, w in R.BUCKET_WEIGHTS["default"].items()) + " ELSE 1.0 END END"
_FLAGS = ", ".join(f"regexp_matches({c}, '" + p.replace("'", "''") + f"') AS {n}" for n, (c, p) in R.DETECTORS.items())
_RULES = " + ".join(f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0.0::DOUBLE END" for _, c, p in R.RULES)
_SCORED = f"""{_flat_candidates()},
a AS (SELECT *, lower(coalesce(query, '')) AS q, lower(coalesce(section_heading, '')) AS sec, lower(coalesce(text, '')) AS txt, coalesce(url, '') AS u2, lower(coalesce(url, '')) AS lurl, coalesce(b, '') AS bucket, '' AS tags, coalesce(t, false) AS is_table, coalesce(w, false) AS has_words, {_terms_sql('query')} AS terms, {_INTENT_SQL} AS intent, lower(coalesce(term, '')) AS chunk_term FROM raw),
f AS (SELECT * EXCLUDE (url, u2), u2 AS url, CASE WHEN chunk_term <> '' THEN chunk_term ELSE sec END AS src, {_FLAGS} FROM a),
g AS (SELECT *, len(list_filter(terms, lambda x: contains(src, lower(x)))) > 0 AS term_match, len(list_filter(terms, lambda x: contains(sec, lower(x)))) > 0 AS term_in_sec,
CASE WHEN intent NOT IN ('deadline', 'calendar') OR len(terms) = 0 THEN 0.0 WHEN len(terms) = 1 THEN ({_POINTS})[1] ELSE greatest(list_max({_POINTS}), 0.0) END AS tp FROM f),
h AS (SELECT *, tp::DOUBLE + {_RULES} AS ft FROM g),
s AS (SELECT *, round(ft, 6) AS feats, round(0.55::DOUBLE * coalesce(embed_score, 0) + 0.25::DOUBLE * coalesce(bm25, 0) + 0.1::DOUBLE * (({_BW})::DOUBLE - 1.0) + CASE WHEN {R.DEGREE_BONUS[0]} THEN {R.DEGREE_BONUS[1]}::DOUBLE ELSE 0.0 END + 0.1::DOUBLE * ft, 6) AS final_score FROM h),
k AS (SELECT *, {_ANY("coalesce(text, '')", R.GUARD_WORDS)} AS has_kw FROM s),
m AS (SELECT *, intent = 'deadline' AND 1.0 - avg(CAST(has_kw AS DOUBLE)) OVER (PARTITION BY qid) <= 0.15 AS kw_first FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kw_first AND has_kw DESC, final_score DESC, bm25 DESC, is_table DESC, term_match DESC, url, chunk_id) AS place FROM m),
z AS (SELECT *, intent IN ('deadline', 'calendar') AND len(terms) > 0 AS by_term FROM p),
y AS (SELECT *, CASE WHEN by_term THEN bucket || '##' || CASE WHEN trim(chunk_term) <> '' THEN trim(chunk_term) ELSE lower(terms[1]) END ELSE url END AS dk FROM z),
x AS (SELECT *, row_number() OVER (PARTITION BY qid, dk ORDER BY place) AS dn FROM y),
v AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM x WHERE dn <= CASE WHEN by_term THEN 1 ELSE 2 END)"""


@query(f"WITH {_SCORED} SELECT qid, chunk_id, intent, term_match, feats, final_score FROM s")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule points and blended scores of all candidates."""
    return R.score_candidates(_candidates(spark, sf_dir)).select("qid", "chunk_id", "intent", "term_match", "feats", "final_score")


@query(f"WITH {_SCORED} SELECT qid, chunk_id, has_kw, kw_first, place FROM p")
def guardrail_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(R.score_candidates(_candidates(spark, sf_dir))).select("qid", "chunk_id", "has_kw", "kw_first", F.col("place").cast("long").alias("place"))


@query(f"WITH {_SCORED} SELECT qid, chunk_id, url, final_score, rank FROM v WHERE rank <= 5")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, six-key order, guardrail, diversity, top 5."""
    return R.rerank(_candidates(spark, sf_dir), 5).select("qid", "chunk_id", "url", "final_score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- answers and evaluation

CASES = [(2, "withdraw winter", "deadline", "registrar/add-drop", "registrar", 3), (3, "semester end", "calendar", None, None, 1), (4, "required courses", None, "computer-science-ms", "catalog-programs", 5), (8, "nothing", "policy", None, None, 1)]


@query(f"""WITH {_SCORED}, {values('cs', 'qid, name, expect_intent, expect_url, expect_bucket, top_k', CASES)},
j AS (SELECT cs.*, o.intent = expect_intent AS i, o.rank <= top_k AND contains(o.url, expect_url) AS u, o.rank <= top_k AND o.bucket = expect_bucket AS b FROM cs LEFT JOIN (SELECT qid, intent, url, bucket, rank FROM v WHERE rank <= 5) o USING (qid)),
w AS (SELECT name, expect_intent IS NULL OR coalesce(bool_or(i), false) AS intent_ok, expect_url IS NULL OR coalesce(bool_or(u), false) AS url_ok, expect_bucket IS NULL OR coalesce(bool_or(b), false) AS bucket_ok FROM j GROUP BY name, expect_intent, expect_url, expect_bucket)
SELECT *, intent_ok AND url_ok AND bucket_ok AS passed FROM w""")
def regression_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations of intent, URL and bucket of the first ranks."""
    cases = frame(spark, "qid int, name string, expect_intent string, expect_url string, expect_bucket string, top_k int", CASES)
    return A.regression(R.rerank(_candidates(spark, sf_dir), 5), cases)


COURSES = [("u1", "Overview\nRequired Courses\nCSIT 515 Software Engineering (3 credits)\nCSIT 545 Architecture\nCSIT 515 Again (9 credits)\nElective Courses\nCSIT 600 Other (3 credits)"), ("u2", "CSIT 100 Not required (3 credits)")]


_CODE = r"'^[*-]?\s*([A-Z]{3,4}\s?\d{3})\s+(.*?)(?:\s*\((\d+) credits?\))?$'"


@query(f"""WITH {values('d', 'url, text', COURSES)}, l AS (SELECT url, string_split(text, chr(10)) AS ls FROM d), u AS (SELECT url, unnest(range(len(ls))) AS i, ls FROM l), t AS (SELECT url, i, trim(ls[i + 1]) AS line FROM u),
a AS (SELECT url, min(i) AS lo FROM t WHERE contains(lower(line), 'required c') GROUP BY url), z AS (SELECT t.url, min(i) AS hi FROM t JOIN a USING (url) WHERE i > lo AND contains(lower(line), 'elective') GROUP BY t.url),
r AS (SELECT t.url, i, regexp_extract(line, {_CODE}, 1) AS code, regexp_extract(line, {_CODE}, 2) AS title, CAST(nullif(regexp_extract(line, {_CODE}, 3), '') AS INTEGER) AS credits FROM t JOIN a USING (url) LEFT JOIN z USING (url) WHERE i >= lo AND (hi IS NULL OR i < hi) AND regexp_matches(line, {_CODE}))
SELECT url, code, title, credits FROM (SELECT *, row_number() OVER (PARTITION BY url, code ORDER BY i) AS n FROM r) WHERE n = 1""")
def required_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.required_courses(frame(spark, "url string, text string", COURSES))



_ENDS = "contains(lower({0}), 'final day to wd') OR contains(lower({0}), 'final day to withdraw')"
_FULL = "contains(lower(x), 'full term') OR regexp_matches(lower(x), '^\\| full[ \t]') OR contains(lower(x), '| full |')"


@query(f"""WITH {values('t', 'id, text', X_.DEADLINE_TEXTS)}, l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM t),
h AS (SELECT id, l, list_position(list_transform(l, lambda x: {_ENDS.format('x')}), true) AS hd FROM l),
c AS (SELECT id, list_position(list_transform(string_split(l[hd], '|'), lambda x: {_ENDS.format('x')}), true) AS col, l[hd + 1:len(l)] AS below FROM h WHERE hd > 0),
r AS (SELECT id, col, coalesce(list_filter(below, lambda x: {_FULL})[1], list_filter(below, lambda x: NOT starts_with(x, '| ---') AND contains(lower(x), '| full'))[1]) AS line FROM c)
SELECT t.id, nullif(regexp_extract(trim(string_split(line, '|')[col]), '\\d{{1,2}}/\\d{{1,2}}(?:/\\d{{2,4}})?'), '') AS deadline FROM t LEFT JOIN r USING (id)""")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "id int, text string", X_.DEADLINE_TEXTS).select("id", A.table_deadline(F.col("text")).alias("deadline"))


@query("""WITH u AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
b AS (SELECT conv_id, n, '[' || n || '] ' || role || chr(10) || CAST(turn AS VARCHAR) || chr(10) || CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || '…' ELSE text END AS x FROM u WHERE n <= 6)
SELECT conv_id AS qid, sha1(string_agg(x, chr(10) || chr(10) ORDER BY n)) AS context_sha1, count(*) AS n_snippets FROM b GROUP BY 1""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as numbered snippets."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    r = c.select(F.col("conv_id").alias("qid"), F.lit("").alias("query"), F.col("role").alias("section_heading"), F.col("turn").cast("string").alias("url"), "text", F.lit("").alias("bucket"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"))
    return A.contexts(r).select("qid", F.sha1("context").alias("context_sha1"), F.col("n_snippets").cast("long").alias("n_snippets"))


@query()
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole questions: ranked candidates, table look-up or a stand-in generator."""
    return A.answer_questions(R.rerank(_candidates(spark, sf_dir), 6), lambda system, user: user.split("\n")[0])


_SEEDS = values("s", "seed_no, topic, question, must_any, prefer_any, max_chars", X_.SEEDS)


@query(f"""WITH {_SEEDS}, p AS (SELECT seed_no, topic, doc_id, 2 * len(list_filter(prefer_any, lambda w: contains(lower(text), lower(w)))) + greatest(0, 3 - CAST(floor(length(text) / 800.0) AS INTEGER)) AS score
FROM s, documents WHERE len(list_filter(must_any, lambda w: contains(lower(text), lower(w)))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_no ORDER BY score DESC, doc_id) AS n FROM p) SELECT seed_no, topic, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE n = 1""")
def kb_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each seed question."""
    b = A.best_chunks(frame(spark, X_.SEED_SCHEMA, X_.SEEDS), table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return b.select("seed_no", "topic", "doc_id", F.col("score").cast("long").alias("score"))


_GOLD = values("g", X_.GOLD_COLUMNS, X_.GOLD)
_GOLD_TOK = "list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> '')"
_JUDGED = f"""{_GOLD}, t AS (SELECT *, {_NORM.format("coalesce(answer, '')")} AS a, {_NORM.format("coalesce(expected_substring, '')")} AS e, {_GOLD_TOK.format("coalesce(answer, '')")} AS p, {_GOLD_TOK.format("coalesce(expected_answer, expected_substring, '')")} AS d FROM g),
j AS (SELECT *, CAST(e <> '' AND contains(a, e) AS INTEGER) AS substring_match, CASE WHEN expected_answer IS NOT NULL THEN CAST(a = {_NORM.format('expected_answer')} AS INTEGER) ELSE 0 END AS em,
round(CASE WHEN {_SHARED.format(q='p', d='d')} = 0 THEN 0.0 ELSE 2.0 * {_SHARED.format(q='p', d='d')} / (len(p) + len(d)) END, 6) AS f1, CASE WHEN expected_source_url IS NOT NULL THEN CAST(coalesce(contains(primary_url, expected_source_url), false) AS INTEGER) END AS source_correct FROM t)"""


def _judged(spark: SparkSession) -> DataFrame:
    return A.judge(frame(spark, X_.GOLD_SCHEMA, X_.GOLD))


@query(f"WITH {_JUDGED} SELECT id, substring_match, em, f1, source_correct FROM j")
def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark).select("id", "substring_match", "em", "f1", "source_correct")


@query(f"WITH {_JUDGED} SELECT category, count(*) AS n, CAST(sum(substring_match) AS BIGINT) AS correct, round(avg(substring_match), 6) AS accuracy, round(avg(f1), 6) AS avg_f1 FROM j GROUP BY 1")
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_category(_judged(spark))


@query(f"WITH {_JUDGED} SELECT count(*) AS n, round(avg(substring_match), 6) AS accuracy, round(avg(f1), 6) AS mean_f1, round(avg(em) FILTER (expected_answer IS NOT NULL), 6) AS em, round(avg(source_correct), 6) AS source_accuracy FROM j")
def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overall(_judged(spark))


@query("SELECT d.lang AS category, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS correct, round(avg(l.quality), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as outcomes by language."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("correct"), F.round(F.avg("quality"), 6).alias("accuracy"))


TOPICS = {"english": (("the", "and", "with"), ()), "spanish": (("que", "las", "por"), ("una",)), "german": (("der", "und", "nicht"), ())}
_HIT = r"CAST(regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_]){t}($|[^a-zA-Z0-9_])') AS INTEGER)"


def _topic_sql() -> str:
    parts = []
    for any_of, must in TOPICS.values():
        parts.append("(" + " + ".join(_HIT.format(t=t) for t in any_of) + " >= 2" + "".join(f" OR {_HIT.format(t=t)} = 1" for t in must) + ")")
    return " OR ".join(parts)


@query(f"SELECT doc_id, {_topic_sql()} AS in_scope FROM documents")
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in scope by topic words (terms of ASCII letters); unknown for a null text, as in SQL."""
    d = S.topic_filter(table(spark, sf_dir, "documents"), TOPICS, ascii_words=True)
    return d.select("doc_id", F.when(F.col("text").isNotNull(), F.col("in_scope")).alias("in_scope"))


# ---------------------------------------------------------------- pages

_HREFS = r"""h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {_HREFS} SELECT DISTINCT page_id, href FROM h")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of each page."""
    p = table(spark, sf_dir, "pages").withColumn("url", F.col("page_id").cast("string"))
    return H.links(H.parse_pages(p)).select(F.col("url").cast("long").alias("page_id"), "href")


@query(f"""WITH h AS (SELECT url AS base, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS href FROM pages),
a AS (SELECT CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(base, '^[a-zA-Z]+://[^/?#]+') || href END AS url FROM h),
u AS (SELECT {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM a WHERE url IS NOT NULL), n AS (SELECT {_NORM_URL.format(plain='tiontion.example.com', domain='example.com')} AS url, host FROM u)
SELECT DISTINCT url FROM n WHERE url IS NOT NULL AND host = 'blog.tiontion.example.com' AND NOT regexp_matches(url, '/t')""")
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages that stay on a listed host and off blocked paths."""
    return D.harvest_links(H.parse_pages(table(spark, sf_dir, "pages")), "example.com", ["blog.tiontion.example.com"], block=["/t"], plain_prefix="tiontion.")


@query(f"""WITH {_HREFS}, l AS (SELECT DISTINCT rtrim(href, '/') AS target FROM h WHERE href LIKE '/%'), p AS (SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\\?.*$', ''), '/') AS target FROM pages)
SELECT target FROM l WHERE target NOT IN (SELECT target FROM p)""")
def link_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked paths that no page has."""
    pages = table(spark, sf_dir, "pages")
    linked = H.links(H.parse_pages(pages.withColumn("url", F.col("page_id").cast("string")))).filter("href like '/%'").select(F.rtrim(F.col("href"), F.lit("/")).alias("target")).distinct()
    return S.link_gap(linked, pages.select(F.col("url").alias("path")))


@query(f"""WITH {_PAGE_URLS}, p AS (SELECT '/' || string_split(regexp_replace(path, '^/+', ''), '/')[1] AS prefix FROM u), c AS (SELECT prefix, count(*) AS n FROM p GROUP BY 1)
SELECT prefix, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, prefix) AS r FROM c) WHERE r <= 15""")
def prefix_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_prefixes(table(spark, sf_dir, "pages").select(U.path_of(F.col("url")).alias("target")))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as markdown of their content root."""
    p = H.parse_pages(table(spark, sf_dir, "pages"), ("page_id", "url"))
    return H.to_markdown(p).select("page_id", H.page_title(p).alias("title"), "md")


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sections(H.parse_pages(table(spark, sf_dir, "pages")))


_JOINED = "lower(array_to_string(headers, ' | '))"


@query(rf"""WITH {values('t', 'url, table_no, heading, headers, rows', X_.TERM_TABLES)},
m AS (SELECT *, list_filter(list_transform(flatten(rows), lambda c: TRY_CAST(regexp_extract(c, '\b(\d{{1,2}})\s*/\s*\d{{1,2}}\b', 1) AS INT)), lambda x: x BETWEEN 1 AND 12) AS ms,
  regexp_extract(array_to_string(flatten(rows), ' '), '\b(20\d{{2}})\b', 1) AS y1, regexp_extract(heading, '\b(20\d{{2}})\b', 1) AS y2, regexp_extract(heading, '(?i)(fall|spring|summer|winter)\s+20\d{{2}}') AS h FROM t),
n AS (SELECT *, len(list_distinct(list_intersect(ms, [9, 10, 11]))) AS fa, len(list_distinct(list_intersect(ms, [2, 3, 4, 5]))) AS sp, len(list_distinct(list_intersect(ms, [6, 7, 8]))) AS su, len(list_distinct(list_intersect(ms, [12, 1]))) AS wi FROM m),
b AS (SELECT *, greatest(fa, sp, su, wi) AS best FROM n)
SELECT url, table_no, CASE WHEN best > 0 THEN trim(CASE best WHEN fa THEN 'Fall' WHEN sp THEN 'Spring' WHEN su THEN 'Summer' ELSE 'Winter' END || ' ' || CASE WHEN y1 <> '' THEN y1 ELSE y2 END)
  ELSE upper(left(h, 1)) || lower(substr(h, 2)) END AS term,
({_JOINED} LIKE '%last day%' AND {_JOINED} LIKE '%withdraw%') OR {' OR '.join(f"contains({_JOINED}, '{p}')" for p in ('add/drop', 'add or drop', *T.DEADLINE_HEADERS))} AS is_deadline FROM b""")
def season_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frame(spark, X_.TABLE_SCHEMA, X_.TERM_TABLES)
    return t.select("url", "table_no", T.table_term(F.col("headers"), F.col("rows"), F.col("heading")).alias("term"), T.is_deadline_table(F.col("headers")).alias("is_deadline"))


_CELL = lambda names: "coalesce(" + ", ".join(f"CASE WHEN list_contains(low, '{n}') THEN nullif(trim(cells[list_position(low, '{n}')]), '') END" for n in names) + ")"


@query(f"""WITH s AS ({ORACLES['season_inference']}), {values('tt', 'url, table_no, heading, headers, rows', X_.TERM_TABLES)},
r AS (SELECT url, table_no, list_transform(headers, lambda h: lower(trim(h))) AS low, unnest(range(1, len(rows) + 1)) AS i, rows FROM tt), c AS (SELECT url, table_no, low, i - 1 AS row_no, rows[i] AS cells FROM r),
o AS (SELECT url, table_no, row_no, coalesce(nullif(s.term, ''), {_CELL(T.TERM_NAMES)}) AS term, {_CELL(T.ADD_NAMES)} AS last_day_to_add_drop, {_CELL(T.WITHDRAW_NAMES)} AS final_day_to_withdraw FROM c JOIN s USING (url, table_no))
SELECT * FROM o WHERE term IS NOT NULL OR final_day_to_withdraw IS NOT NULL""")
def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.calendar(frame(spark, X_.TABLE_SCHEMA, X_.TERM_TABLES))


_TABLE_VALUES = values("t", "url, table_no, heading, headers, rows", X_.TABLES)


@query(f"""WITH {_TABLE_VALUES}, r AS (SELECT url, table_no, headers, unnest(range(1, len(rows) + 1)) AS i, rows FROM t WHERE NOT contains(array_to_string(headers, ' '), 'Seats')),
p AS (SELECT url, table_no, i - 1 AS row_no, list_filter(list_transform(list_zip(headers, rows[i]), lambda z: CASE WHEN z[2] <> '' THEN '**' || z[1] || ':** ' || z[2] END), lambda x: x IS NOT NULL) AS l FROM r)
SELECT url, table_no, row_no, array_to_string(l, chr(10)) AS text FROM p WHERE len(l) > 0""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body rows of deadline tables as "header: value" text."""
    return T.row_records(frame(spark, X_.TABLE_SCHEMA, X_.TABLES)).select("url", "table_no", F.col("row_no").cast("long").alias("row_no"), "text")


@query("""WITH h AS (SELECT page_id, url, sha1(html) AS content_sha1 FROM pages), old AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN content_sha1 ELSE sha1('old') END AS content_sha1 FROM h WHERE page_id % 4 <> 1)
SELECT url, content_sha1 FROM h WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.url = h.url AND old.content_sha1 = h.content_sha1)""")
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed pages against a state in which some are missing and some differ."""
    p = table(spark, sf_dir, "pages")
    state = p.filter("page_id % 4 <> 1").select("url", F.when(F.col("page_id") % 3 == 0, F.sha1("html")).otherwise(F.sha1(F.lit("old"))).alias("content_sha1"))
    return S.changed(p.select("url", "html"), state).select("url", "content_sha1")


@query("SELECT 'pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("pages", "documents", "conversations"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(vec_id AS VARCHAR) AS id, 'vector ' || vec_id AS document, CAST(label AS VARCHAR) AS bucket, '' AS headings, false AS is_table FROM embeddings")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index keeps of chunks: flat metadata, missing fields as ""."""
    v = table(spark, sf_dir, "embeddings")
    n = F.lit(None).cast("string")
    c = v.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), n.alias("source_url"), n.alias("title"), F.col("label").cast("string").alias("bucket"), F.lit(None).cast("array<string>").alias("headings"), n.alias("section_heading"), n.alias("section"), n.alias("term"), F.lit(None).cast("boolean").alias("is_table"), F.lit(None).cast("array<string>").alias("tags"))
    return writers.index_rows(c).select("id", "document", "bucket", "headings", "is_table")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts (an extension; the same function runs on a stream)."""
    return incremental.windowed_counts(table(spark, sf_dir, "events"))


# ---------------------------------------------------------------- parts of the operators above, by themselves


@query("""SELECT doc_id, 'sha1:' || sha1('doc/' || doc_id || '::row::' || text) AS row_id, 'sha1:' || sha1('doc/' || doc_id || '::H1: ' || lang || ';H2: ' || source || '::table::' || doc_id) AS table_id
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def row_and_table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of row chunks and of table chunks."""
    d = table(spark, sf_dir, "documents").filter("text is not null and lang is not null and source is not null")
    u = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    heads = F.array(F.concat(F.lit("H1: "), "lang"), F.concat(F.lit("H2: "), "source"))
    return d.select("doc_id", X.row_chunk_id(u, F.col("text")).alias("row_id"), X.table_chunk_id(u, heads, F.col("doc_id")).alias("table_id"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL THEN '' WHEN doc_id % 3 = 0 THEN 'calendar' ELSE lower(lang) || ' part: 2' END AS section,
regexp_matches(text, '(?i)(withdraw|final day|last day|drop|deadline|add/?drop|adjustment)') AS has_deadline_words FROM documents""")
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of heading paths, and whether a text has deadline words."""
    last = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("H3: The "), "lang", F.lit(" Calendar"))).otherwise(F.concat(F.lit("H2: "), "lang", F.lit(" Part: 2")))
    heads = F.when(F.col("lang").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("H1: Top"), last))
    return table(spark, sf_dir, "documents").select("doc_id", X.section_label(heads).alias("section"), F.col("text").rlike(X.DEADLINE_WORDS).alias("has_deadline_words"))


ANCHOR_IDS = [("requirementstextcontainer",), ("ProgramRequirements",), ("plan-ofstudytext",), ("sampleplantab",), ("policies",), ("nope",), ("tab",), (" coursestexttab ",), ("degree-requirements-overview",)]


@query(f"""WITH {values('a', 'id', ANCHOR_IDS)}, b AS (SELECT id, regexp_replace(lower(trim(id)), '(textcontainer|container|texttab|tab)$', '') AS base FROM a),
t AS (SELECT id, unnest([1, 2, 3, 4]) AS n, unnest([base, base || 'text', replace(base, '-', ''), replace(base, '_', '')]) AS name FROM b)
SELECT id, arg_min(name, n) FILTER (list_contains({X_.literal(X.ANCHORS)}, name)) AS anchor FROM t GROUP BY id""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element ids to known anchors."""
    return frame(spark, "id string", ANCHOR_IDS).select("id", X.canonical_anchor(F.col("id")).alias("anchor"))


@query(f"""WITH {_flat_candidates()}, u AS (SELECT * FROM raw UNION ALL SELECT qid, query, chunk_id + 100, 1 - embed_score, bm25, url, text, section_heading, b, term, t, w FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, url, section_heading, left(text, 200) ORDER BY embed_score DESC, chunk_id) AS n FROM u) SELECT qid, chunk_id, CAST(round(embed_score, 6) AS DOUBLE) AS embed_score FROM k WHERE n = 1""")
def candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates found twice, each kept at its best place."""
    c = _candidates(spark, sf_dir)
    again = c.withColumns({"chunk_id": F.col("chunk_id") + 100, "embed_score": 1 - F.col("embed_score")})
    return V.dedupe_candidates(c.unionByName(again)).select("qid", "chunk_id", F.round("embed_score", 6).alias("embed_score"))


_ASKS = _ANY("query", A.ADVISOR_WORDS)


@query(f"""WITH {_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce({_ASKS} AND contains(lurl, 'school-of-computing') AND {_ANY('text', ('advisor', 'graduate program coordinator', 'gpc'))}, false) DESC, rank) AS first FROM v WHERE rank <= 5)
SELECT qid, url, bucket, coalesce(section_heading, '') AS title FROM o WHERE first = 1""")
def primary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main source of each question."""
    return A.primary_sources(R.rerank(_candidates(spark, sf_dir), 5)).select("qid", "url", "bucket", "title")


REQUIRED = ["https://uni.example.com/needed/", "https://uni.example.com/policies/"]


@query(f"WITH {values('r', 'url', [(u,) for u in REQUIRED])} SELECT url FROM r WHERE url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required URLs that no page has."""
    return S.missing_urls(table(spark, sf_dir, "pages"), REQUIRED)


FRAGMENTS = (("/en/1", "first"), ("/en/", "english"), (".html", "file"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(url), '{f}') THEN '{b}'" for f, b in FRAGMENTS) + " ELSE '' END AS bucket FROM pages")
def fragment_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by fragments of URLs."""
    return table(spark, sf_dir, "pages").select("page_id", S.bucket_from_url(F.col("url"), FRAGMENTS).alias("bucket"))


@query(rf"""WITH {_PAGE_URLS}, m AS (SELECT 'see [a](' || path || '#x) and [b](/b' || path || '/?q) or [c](mailto:x)' AS md FROM u),
t AS (SELECT unnest(regexp_extract_all(md, '\]\((/[^)#?\s]+)', 1)) AS target FROM m) SELECT DISTINCT rtrim(target, '/') AS target FROM t""")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct absolute-path targets of markdown links."""
    path = U.path_of(F.col("url"))
    return S.link_targets(table(spark, sf_dir, "pages").select(F.concat(F.lit("see [a]("), path, F.lit("#x) and [b](/b"), path, F.lit("/?q) or [c](mailto:x)")).alias("text")))


@query("SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages WHERE regexp_matches(url, '^[a-zA-Z]+://[^/?#]+') AND lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) <> 'blog.tiontion.example.com'")
def unknown_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages that aren't known yet."""
    return D.new_hosts(table(spark, sf_dir, "pages"), ["blog.tiontion.example.com"])


@query("""WITH now AS (SELECT url, sha1(min(coalesce(html, ''))) AS h FROM pages WHERE page_id % 2 = 0 GROUP BY url), old AS (SELECT DISTINCT url, sha1('old') AS h FROM pages WHERE page_id % 3 = 0)
SELECT url, h AS content_sha1, 'today' AS last_fetch FROM now UNION ALL SELECT url, h, 'before' FROM old WHERE url NOT IN (SELECT url FROM now)""")
def state_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch state after a run over half of the pages."""
    p, n = table(spark, sf_dir, "pages"), F.lit(None).cast("string")
    old = p.filter("page_id % 3 = 0").select("url", n.alias("etag"), n.alias("last_modified"), F.sha1(F.lit("old")).alias("content_sha1"), F.lit("before").alias("last_fetch")).distinct()
    now = p.filter("page_id % 2 = 0").groupBy("url").agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
    return S.next_state(now, old, "today").select("url", "content_sha1", "last_fetch")


@query("""WITH old AS (SELECT DISTINCT url, sha1(url) AS etag FROM pages WHERE page_id % 3 = 0), u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)
SELECT url, etag, starts_with(url, 'https://blog') AS needs_render, regexp_matches(url, '/[0-9]+\\.html$') AS needs_tables FROM u LEFT JOIN old USING (url)""")
def fetch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetch of each page's URL needs."""
    p = table(spark, sf_dir, "pages")
    state = p.filter("page_id % 3 = 0").select("url", F.sha1("url").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    plan = D.fetch_plan(p.select("url").filter("url is not null").distinct(), state, ["https://blog"], [], [r"/[0-9]+\.html$"])
    return plan.select("url", "etag", "needs_render", "needs_tables")


@query(ORACLES["kb_argmax"].replace("SELECT seed_no, topic, doc_id, CAST(score AS BIGINT) AS score FROM r", "SELECT 'kb:' || left(sha1(question), 12) AS id, topic, doc_id AS chunk_id FROM r").replace("SELECT seed_no, topic, doc_id, 2 *", "SELECT seed_no, topic, question, doc_id, 2 *"))
def knowledge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge items of the seed questions."""
    n = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), "text", n.alias("source_url"), n.alias("bucket"), F.array().cast("array<string>").alias("headings"))
    return A.knowledge_items(frame(spark, X_.SEED_SCHEMA, X_.SEEDS), d.drop("doc_id")).select("id", "topic", "chunk_id")


@query(f"WITH j AS ({ORACLES['label_metrics']}) SELECT category, accuracy FROM j")
def category_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy by category, a bar chart's data."""
    return writers.accuracy_bars(label_metrics(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT id, question, category, CAST(substring_match AS VARCHAR) AS substring_match, CAST(em AS VARCHAR) AS \"EM\", printf('%.3f', f1) AS \"F1\", '' AS intent, coalesce(CAST(source_correct AS VARCHAR), '') AS source_correct, coalesce(primary_url, '') AS primary_url FROM j")
def eval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation's table as it is written."""
    return writers.eval_rows(_judged(spark).withColumn("intent", F.lit("")))


CELLS = [(1, " **Required  Courses** "), (2, "x<BR/>y&nbsp;z<br >  w"), (3, "a  \t b"), (4, ""), (5, "**half"), (6, "plain")]


@query(rf"""WITH {values('c', 'id, t', CELLS)} SELECT id, trim(regexp_replace(regexp_replace(replace(t, chr(160), ' '), '^\s*\*\*(.*?)\*\*\s*$', '\1'), '\s+', ' ', 'g')) AS heading,
regexp_replace(regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', ' / ', 'g'), '(?i)&nbsp;|\x{{00a0}}', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g') AS cell FROM c""")
def heading_and_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading lines without bold marks, and table cells without HTML blanks."""
    return frame(spark, "id int, t string", CELLS).select("id", X.heading_line(F.col("t")).alias("heading"), X.html_cell(F.col("t")).alias("cell"))


REQUIREMENT_ROWS = [
    (1, "What are the required courses?", 1, "catalog-programs", "Elective Courses"), (1, "What are the required courses?", 2, "catalog-programs", "Required Courses"), (1, "What are the required courses?", 3, "policies", "Elective rules"),
    (2, "electives beside required courses?", 1, "catalog-programs", "Electives"), (3, "program requirements", 1, "catalog-programs", "Electives A"), (3, "program requirements", 2, "catalog-programs", "Electives B"),
    (4, "hello", 1, "catalog-programs", "Electives"), (5, "degree requirements", 1, "catalog-programs", None), (5, "degree requirements", 2, "catalog-programs", "Elective Program Requirements"), (5, "degree requirements", 3, "catalog-programs", "Free electives"),
]
_NAMED = ("required courses", "required core", "program requirements", "degree requirements")


@query(f"""WITH {values('r', 'qid, query, rank, bucket, section_heading', REQUIREMENT_ROWS)}, d AS (SELECT *, {_ANY('query', _NAMED)} AND NOT contains(lower(query), 'elective') AND bucket = 'catalog-programs' AND NOT {_ANY("coalesce(section_heading, '')", _NAMED)} AND contains(lower(coalesce(section_heading, '')), 'elective') AS gone FROM r),
k AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY qid) AS n_left FROM d) SELECT qid, rank, section_heading FROM k WHERE n_left = 0 OR NOT gone""")
def requirement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of electives left out of questions about required courses."""
    return A.requirement_sections(frame(spark, "qid int, query string, rank int, bucket string, section_heading string", REQUIREMENT_ROWS)).select("qid", "rank", "section_heading")


ROW_TEXTS = [("u1", "Fall 2025", "**Term:** Full", "registrar", "Fall 2025", True), ("u1", "Fall 2025", "**Term:** A", "policies", "", False), ("u2", "", "x", "registrar", None, None)]


@query(f"WITH {values('r', 'url, section_heading, text, bucket, term, words', ROW_TEXTS)} SELECT 'sha1:' || sha1(url || '::row::' || text) AS id, url AS source_url, 'Calendar Row' AS title, section_heading, true AS is_table, 'calendar' AS section, term, words AS has_deadline_words FROM r WHERE bucket IN ('registrar')")
def table_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of the allowed buckets as chunks."""
    r = frame(spark, "url string, section_heading string, text string, bucket string, term string, has_deadline_words boolean", ROW_TEXTS)
    return C.row_chunks(r, ["registrar"]).select("id", "source_url", "title", "section_heading", "is_table", "section", "term", "has_deadline_words")


TERM_CASES = [(1, "a\n**TERM:** Spring 2026 \nb", "H1: Fall 2025"), (2, "in WINTER 2024", "H1: Dates of fall 2025"), (3, "in WINTER 2024, Fall 2025", "H1: Dates"), (4, "Fallout 2024 and prefall 2025", "H1: x"), (5, "", "")]


@query(r"WITH " + values("t", "id, text, heading", TERM_CASES) + r""", f AS (SELECT id, trim(regexp_extract(text, '(?m)^\*\*TERM:\*\*\s*(.+)$', 1)) AS mark, regexp_extract(heading, '(?i)\b(fall|spring|summer|winter)\s+(20\d{2})\b') AS a, regexp_extract(text, '(?i)\b(fall|spring|summer|winter)\s+(20\d{2})\b') AS b FROM t)
SELECT id, coalesce(nullif(mark, ''), nullif(upper(left(a, 1)) || lower(substr(a, 2)), ''), upper(left(b, 1)) || lower(substr(b, 2))) AS term FROM f""")
def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's term: its mark's, else its headings', else its text's."""
    return frame(spark, "id int, text string, heading string", TERM_CASES).select("id", X.infer_term(F.col("text"), F.array("heading")).alias("term"))


from sparkloom.plans import derived  # noqa: E402,F401  registers its queries beside these
