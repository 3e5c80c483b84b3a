"""Functions and operators on small inline inputs, against values worked out by hand or by plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import urls as U
from sparkloom.operators import answers as A
from sparkloom.operators import chunking as C
from sparkloom.operators import html as H
from sparkloom.operators import ranking as R
from sparkloom.operators import retrieval as V
from sparkloom.operators import selection as S
from sparkloom.operators import tables as T
from sparkloom.plans import fixtures as X_
from sparkloom.sources import readers, writers


def one(spark, schema, row, *cols):
    return tuple(spark.createDataFrame([row], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_labels_terms_and_anchors(spark):
    h, t = F.col("h"), F.col("t")
    got = one(spark, "h array<string>, t string", (["H1: A", "H2: Fall 2025 dates"], "x\n**TERM:** Spring 2026\ny"), X.section_label(h), X.infer_term(t, h), X.first_term(t), X.section_label(F.array().cast("array<string>")))
    assert got == ("fall 2025 dates", "Spring 2026", "Spring 2026", "")
    a = F.col("a")
    ids = ["requirementstextcontainer", "programrequirements", "plan-ofstudytext", "nope", "tab"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ids], "a string").select(X.canonical_anchor(a)).collect()] == ["requirementstext", "programrequirementstext", "planofstudytext", None, None]


def test_trim_answer_keeps_whole_paragraphs(spark):
    text = "aaaa\n\nbbbb\n\ncccccccccccc\n\nd"
    cols = [X.trim_answer(F.col("t"), n) for n in (100, 10, 9, 3)]
    assert one(spark, "t string", (text,), *cols) == (text, "aaaa\n\nbbbb", "aaaa", "aaa")


def test_most_common_keeps_the_first_of_equals(spark):
    assert one(spark, "x array<string>", (["b", "a", "A", "B", ""],), X.most_common(F.col("x"))) == ("B",)
    assert one(spark, "x array<string>", ([],), X.most_common(F.col("x"))) == (None,)


def test_season_ties(spark):
    cells = F.col("x")
    assert one(spark, "x array<string>", (["9/1 and 1/1", "2/3", None, "40/1"],), X.season_of(X.months_of(cells))) == ("Fall",)


def test_rules_stop_at_the_first_include(spark):
    buckets = [S.Bucket("a", ("^/x",), ("/no$",)), S.Bucket("b", ("^/x/no",))]
    rows = spark.createDataFrame([("/x/no",), ("/x/y",), ("/z",)], "p string")
    assert [r[0] for r in rows.select(S.bucket_of(F.col("p"), buckets)).collect()] == [None, "a", None]
    assert S.strict_patterns([r"\d"]) == [r"\\d"]


def test_keep_first_with_ties_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 1, "a"), (None, 2, None), (None, 3, "z")], "k string, o int, v string")
    assert sorted(map(tuple, S.keep_first(rows, ["k"], ["o"]).collect()), key=str) == sorted([("k", 1, "a"), (None, 2, None)], key=str)


def test_required_urls(spark):
    rows = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert S.require_urls(rows, ["u1"]).count() == 2
    with pytest.raises(Exception, match="missing"):
        S.require_urls(rows, ["u1", "u9"]).collect()
    assert [r[0] for r in S.missing_urls(rows, ["u1", "u9"]).collect()] == ["u9"]


def test_lexical_overlap_of_whole_texts(spark):
    from sparkloom.functions import text as X
    from sparkloom.operators import retrieval as V

    docs = spark.createDataFrame([(1, "s", "filler " * 400 + "rare passage"), (2, "s", "other")], "doc_id long, source string, text string")
    q = spark.createDataFrame([(1, "rare passage")], "qid long, query string")
    best = {c: V.lexical_top_k(q, docs, 1, chars=c).first()["score"] for c in (2000, None)}
    assert best[2000] == 0 and best[None] == round(2 / (2 * 402) ** 0.5, 6)
    assert [docs.filter("doc_id = 1").select(X.overlap_score(F.lit("rare passage"), F.col("text"), c) > 0).first()[0] for c in (2000, None)] == [False, True]


def test_registered_topic_filter_runs_the_operator(spark, tmp_path, monkeypatch):
    from sparkloom.operators import selection as S
    from sparkloom.plans.queries import QUERIES

    texts = ["the and", "the band", "éthe and", "una", "unas", None, "", "THE\nwith_ and"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, real = [], S.topic_filter
    monkeypatch.setattr(S, "topic_filter", lambda *a, **k: calls.append(k) or real(*a, **k))
    got = {r["doc_id"]: r["in_scope"] for r in QUERIES["topic_filter"](spark, str(tmp_path)).collect()}
    assert calls and [got[i] for i in range(8)] == [True, False, True, True, False, None, False, True]


def test_topics_count_distinct_terms_and_quote_them(spark):
    rows = spark.createDataFrame([("pass/fail and grades",), ("grades grades",), ("a.b",), ("axb",)], "t string")
    assert [r[0] for r in rows.select(S.topic_matches(F.col("t"), ["pass/fail", "grades"])).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(S.topic_matches(F.col("t"), [], ["a.b"])).collect()] == [False, False, True, False]


def plain_safe_slice(t, s, e, pad=40):
    """The description of the snap, as a loop."""
    bound = re.compile(r"[ \t\n\r\f\v.,;:!?)\]]")
    n, e = len(t), min(e, len(t))
    lo, hi = s, e
    m = bound.search(t[s : s + pad])
    if m:
        lo = s + m.end()
    back = [m.end() for m in bound.finditer(t[max(e - pad, 0) : e])]
    if back:
        hi = max(e - pad, 0) + back[-1]
    if lo >= hi:
        return t[max(s - pad, 0) : min(e + pad, n)]
    return t[lo:hi]


def test_safe_slice_against_a_loop(spark):
    texts = ["word, " * 30 + "x" * 90 + " end.", "y" * 200, "a b", "no-break-here" * 9 + ". Done"]
    rows = [(t, s, s + w) for t in texts for s in range(0, len(t), 17) for w in (5, 60, 120)]
    df = spark.createDataFrame(rows, "t string, s int, e int").select("t", "s", "e", C.safe_slice(F.col("t"), F.col("s"), F.col("e"), snap_ends=True).alias("x"))
    for r in df.collect():
        assert r["x"] == plain_safe_slice(r["t"], r["s"], r["e"])


def test_windows_cover_the_text(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    got = one(spark, "t string", (text,), C.windows(F.col("t")))[0]
    at = 0
    for w in got:
        place = text.index(w, max(0, at - 300))
        assert place <= at
        at = place + len(w)
    assert at == len(text)


def test_sections_of_exactly_two_targets(spark):
    rows = [(n, "x" * n) for n in (2400, 2401)]
    df = spark.createDataFrame(rows, "n int, t string").select("n", F.size(C.windows(F.col("t"))).alias("k"))
    assert dict(map(tuple, df.collect())) == {2400: 1, 2401: 3}


def test_chunk_ids_are_unique_and_collide_without_section_numbers(spark):
    md = spark.createDataFrame([("u", "t", "b", [], "# A\nx\n# A\ny")], X_.MD_SCHEMA)
    assert C.chunk_documents(md).count() == 2
    assert [r["text"] for r in C.chunk_documents(md, id_by_section=False).collect()] == ["x"]


def test_chunk_documents_sections(spark):
    """Table marks cut a section, a document without a section is one, only program pages are cleaned, short sections stay as they are."""
    rows = [
        ("u1", "t", "registrar", [], "# H\nlead\n### Table 1\n| a |\n### Table 2\n| b |"), ("u2", "t", "policies", [], ""), ("u3", "t", "catalog-courses", [], "# C\nPrint this page\na\n\n\n\nb"),
        ("u4", "t", "catalog-programs", [], "# P\nPrint this page\nMATH 101\nNumbers\n3"), ("u5", "t", None, [], None),
    ]
    d = spark.createDataFrame(rows, "source_url string, source_title string, bucket string, tags array<string>, md string")
    got = {}
    for r in C.chunk_documents(d).orderBy("source_url", "section_no", "piece_no").collect():
        got.setdefault(r["source_url"], []).append((r["text"], r["is_table"]))
    assert got["u2"] == got["u5"] == [("", False)] and got["u3"] == [("Print this page\na\n\n\n\nb", False)]
    assert len(got["u4"]) == 1 and "Print" not in got["u4"][0][0] and "MATH 101 Numbers (3 credits)" in got["u4"][0][0]
    assert any("| a |" in t for t, _ in got["u1"]) and any("| b |" in t for t, _ in got["u1"])


def test_catalog_cleaning(spark):
    text = "Search Catalog\nProgram Requirements\nline\nline\nProgram Requirements\n\nCourse List Code Title Credits\nCSIT 515\nSoftware Engineering\n3\nMATH 101\nCalculus"
    got = one(spark, "t string", (text,), C.clean_catalog_text(C.normalize_courses(F.col("t"))))[0]
    assert got == "Program Requirements\nline\nCourse List\nCSIT 515 Software Engineering (3 credits)\nMATH 101 Calculus"


def test_scores_by_hand(spark):
    meta = ("registrar", "Fall 2025", True, True)
    row = (1, "final day to withdraw Fall 2025", 1, 0.5, 0.4, "https://uni.example.com/x/", "withdraw by 12/2", "Table of dates", meta)
    got = R.score_candidates(spark.createDataFrame([row], X_.CANDIDATE_SCHEMA)).first()
    # table .10, words .06, term match .08, "table" .05, withdraw .18, registrar table .10 and match .10, keyword .02, same term 2.5
    feats = 0.10 + 0.06 + 0.08 + 0.05 + 0.18 + 0.10 + 0.10 + 0.02 + 2.5
    assert got["intent"] == "deadline"
    assert got["feats"] == pytest.approx(feats)
    assert got["final_score"] == pytest.approx(0.55 * 0.5 + 0.25 * 0.4 + 0.1 * (1.10 - 1) + 0.1 * feats)


def test_ranking_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame(X_.candidates(), X_.CANDIDATE_SCHEMA)
    a, b = (sorted(map(tuple, R.rerank(rows.repartition(n), 5).select("qid", "rank", "chunk_id").collect())) for n in (1, 8))
    assert a == b
    per_url = R.rerank(rows, 12).filter("intent = 'default'").groupBy("qid", "url").count().agg(F.max("count")).first()[0]
    assert per_url <= 2


def test_hashed_search_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r["qid"], r["vec_id"]) for r in V.vector_top_k(q, v, 10).collect()}
    h = V.HashedVectors(64)
    found = {(r["qid"], r["vec_id"]) for r in h.search(q, h.index(v), v, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


PAGE = """<html><head><title>T</title></head><body><nav><a href="/nav">n</a></nav><main><h1>Top &amp; more</h1><p>One<br>two<p>three
<div id="requirementstextcontainer"><h2>Requirements</h2><ul><li>first</li><li>second</li></ul></div>
<h2>Fall 2025 dates</h2><table><tr><th>Part of Term</th><th>Final Day to Withdraw</th></tr><tr><td>Full<br>Term</td><td>11/4</td></tr></table>
<div id="coursestext"><p>CSIT 104 Intro (3 credits)</p></div></main><script>var x = "<p>no</p>";</script><footer>f</footer>"""


def test_html(spark):
    p = H.parse_pages(spark.createDataFrame([("https://uni.example.com/a/", PAGE), ("b", None), ("c", "")], "url string, html string")).cache()
    md = {r["url"]: r["md"] for r in H.to_markdown(p).collect()}
    assert md["https://uni.example.com/a/"].startswith("# Top & more\n\nOne\ntwo\n\nthree\n\n## Requirements\n\n- first\n\n- second")
    assert "| Full / Term | 11/4 |" in md["https://uni.example.com/a/"] and "no" not in md["https://uni.example.com/a/"].split() and md["b"] == md["c"] == ""
    secs = [(r["url"].partition("#")[2], r["title"]) for r in H.sections(p).filter("url like 'https%'").orderBy("ordinal").collect()]
    assert secs == [("", "Top & more"), ("requirementstext", "Requirements"), ("coursestext", "coursestext")]
    t = H.tables(p).first()
    assert (t["heading"], t["headers"], t["rows"]) == ("Fall 2025 dates", ["Part of Term", "Final Day to Withdraw"], [["Full / Term", "11/4"]])
    assert {r["href"] for r in H.links(p).collect()} == {"/nav"}
    assert [tuple(r) for r in H.courses(p).select("code", "title", "credits").collect()] == [("CSIT 104", "Intro", 3)]
    base = F.lit("https://uni.example.com/a/b")
    assert one(spark, "x int", (1,), *[H.resolve(F.lit(h), base) for h in ("/z", "c.html", "//cdn.org/q", "mailto:x", "#t", "http://o.org/")]) == ("https://uni.example.com/z", "https://uni.example.com/a/c.html", "https://cdn.org/q", None, None, "http://o.org/")


def test_tables(spark):
    t = spark.createDataFrame(X_.TABLES, X_.TABLE_SCHEMA)
    maps = T.column_maps(t).filter("url = 'u1' and table_no = 0 and row_no = 0").first()["cells"]
    assert maps == {"Part of Term": "Full Term", "Last Day to Add/Drop": "9/8", "Final Day to Withdraw": "11/4"}
    rec = T.row_records(t, "registrar").filter("url = 'u1' and row_no = 1").first()
    assert (rec["session"], rec["desc"], rec["final_withdraw"], rec["has_deadline_words"]) == ("Session a", "Session A", "10/1", True)
    md = spark.createDataFrame([("u", "## Fall 2025\n| A | B |\n|---|---|\n| 1 | 2 |\ntext\n| not | a table |\n")], "url string, md string")
    assert [(r["heading"], r["headers"], r["rows"]) for r in T.pipe_tables(md).collect()] == [("Fall 2025", ["A", "B"], [["1", "2"]])]


def test_answers(spark):
    ranked = R.rerank(spark.createDataFrame(X_.candidates(), X_.CANDIDATE_SCHEMA), 6)
    got = {r["qid"]: r for r in A.answer_questions(ranked, lambda s, u: "generated").collect()}
    assert len(got) == len(X_.INTENT_QUERIES)
    assert all(r["answer"] == "generated" or r["answer"].startswith("According to") for r in got.values())


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "md"
    d.mkdir()
    (d / "a.md").write_text("---\nsource_url: 'https://uni.example.com/a/'\ntags: ['x', 'y']\nbucket: 'policies'\n---\n\n# A\nbody", encoding="utf-8")
    (d / "b-pdf.md").write_text("stub", encoding="utf-8")
    got = readers.read_markdown(spark, str(d)).collect()
    assert [(r["source_url"], r["bucket"], r["tags"]) for r in got] == [("https://uni.example.com/a/", "policies", ["x", "y"])]
    (tmp_path / "gold.csv").write_text("﻿id,question,expected_substring,category\n1,\"a, b\",x,c\n", encoding="utf-8")
    assert tuple(readers.read_gold(spark, str(tmp_path / "gold.csv")).first()) == ("1", "a, b", "x", "c", None, None)
    assert readers.read_state(spark, str(tmp_path / "missing.json")).count() == 0
    pages = spark.createDataFrame([("u1", "x"), ("u2", "y")], "url string, html string")
    state = S.next_state(pages, readers.read_state(spark, "none"), "now")
    writers.write_state(state, str(tmp_path / "state.json"))
    again = readers.read_state(spark, str(tmp_path / "state.json"))
    assert S.changed(pages, again).count() == 0
    assert S.changed(spark.createDataFrame([("u1", "new"), ("u3", None)], "url string, html string"), again).count() == 2
    writers.write_json(spark.createDataFrame([("c1", "text")], "id string, text string"), str(tmp_path / "chunks"))
    assert readers.read_chunks(spark, str(tmp_path / "chunks")).first()["id"] == "c1"
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.jsonl").write_text('{"id": "c1"}\n\n{"id": \n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_chunks(spark, str(tmp_path / "broken")).collect()
    fetched = readers.fetch(pages, lambda u, e, m: (None, "not-modified") if u == "u1" else (1 / 0, "ok"))
    assert dict((r["url"], r["status"]) for r in fetched.collect()) == {"u1": "not-modified", "u2": "error"}


def test_stream_equals_batch(spark, tmp_path):
    from sparkloom.streaming.incremental import refresh_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, html string").write.parquet(src)
    run = lambda: refresh_stream(spark.readStream.schema("url string, html string").parquet(src), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("u1", "a"), ("u2", "B"), ("u3", "c")], "url string, html string").write.mode("append").parquet(src)
    run()
    out = sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect())
    assert out == ["u2", "u3"]


def test_urls(spark):
    u = F.col("u")
    rows = ["HTTPS://Uni.Example.com/A?x=1", "https://evilexample.com/b.pdf", "http://other.org/", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "u string").select(U.normalize_url(u, "example.com")).collect()]
    assert got == ["https://uni.example.com/A/", "https://evilexample.com/b.pdf", None, None, None]
    assert one(spark, "u string", ("https://a.b/c/?q",), U.file_path(u, "raw", ".md"), U.audit_path(u)) == ("raw/c/index.md", "/c")


def test_discovery_and_embeddings(spark):
    from sparkloom.operators import discovery as D
    from sparkloom.sources.embeddings import embed, hashed_vector

    hosts = spark.createDataFrame([("a.example.com",), ("b.example.com",)], "host string")
    get = lambda u, e, m: ("<urlset></urlset>", "ok") if u == "https://a.example.com/sitemap_index.xml" else (None, "error")
    assert [tuple(r)[:2] for r in D.probe_sitemaps(hosts, get).collect()] == [("a.example.com", "https://a.example.com/sitemap_index.xml")]
    found = spark.createDataFrame([("https://a.example.com/x",), ("https://c.example.com/y.pdf",)], "url string")
    assert [r[0] for r in D.new_hosts(found, ["a.example.com"]).collect()] == ["c.example.com"]
    plan = {r["url"]: r for r in D.fetch_plan(found, readers.read_state(spark, "none"), render_prefixes=["https://a."]).collect()}
    assert plan["https://a.example.com/x"]["needs_render"] and plan["https://c.example.com/y.pdf"]["is_pdf"]
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    assert {r["id"]: r["embedding"] for r in embed(rows, lambda: lambda ts: [[len(t), 1] for t in ts]).collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    v = rows.select(hashed_vector(F.col("text"), 8).alias("v")).collect()
    assert sum(map(abs, v[0]["v"])) == 1 and v[1]["v"] == [0.0] * 8


def test_large_query_sets_meet_every_row_once(spark):
    q, r = spark.range(101).select(F.col("id").alias("a")), spark.range(300).select(F.col("id").alias("b"))
    both = V.pair_up(q, r, most=100)
    assert both.columns == ["b", "a"] and both.count() == both.distinct().count() == 101 * 300


def test_windows_equal_slices_of_the_whole_text(spark):
    texts = ["", "ab", "é" * 700, "wörd, " * 300, "x" * 130 + " " + "yz " * 90, "𝄞 a" * 111]
    for target, overlap, snap in ((100, 20, False), (97, 50, True), (60, 0, False)):
        got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.slid(F.col("t"), F.lit(target), overlap, snap)).collect()]
        for t, g in zip(texts, got, strict=True):
            n, step, want = len(t), target - overlap, []
            for s in range(0, 1 if n <= target else -(-(n - target) // step) * step + 1, step):
                e = min(s + target, n)
                edge = " \t\n\r\f\x0b.,;:!?)]"
                head, tail = t[s : s + 40], t[max(e - 40, 0) : e]
                lead = next((i for i, c in enumerate(head) if c in edge), len(head))
                trail = next((i for i, c in enumerate(tail[::-1]) if c in edge), len(tail))
                lo = s if lead == len(head) or (s == 0 and not snap) else s + lead + 1
                hi = e if trail == len(tail) or (e == n and not snap) else e - trail
                want.append((t[lo:hi] if lo < hi else t[max(s - 40, 0) : min(e + 40, n)]).strip())
            assert g == want
