"""Pages, sections, tables, sitemaps, courses, snapshots and cells on small fixtures."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunking as C
from sparkloom.operators import html as H
from sparkloom.operators import retrieval as V
from sparkloom.operators.ivf import InvertedFile
from sparkloom.sources import readers, snapshots


def pages(spark, *html):
    return H.parse_pages(spark.createDataFrame([(f"https://u.example.com/{i}", h) for i, h in enumerate(html)], "url string, html string"))


def test_spread_fills_spans():
    td = lambda t, r=1, c=1, th=False: (t, r, c, th)
    assert H.spread([[td("a", 2), td("b", 1, 2)], [td("c"), td("d")]]) == ([["a", "b", "b"], ["a", "c", "d"]], 0)
    assert H.spread([[td("h", th=True), td("i", th=True)], [td("x", 9)], [td("y")], []]) == ([["h", "i"], ["x"], ["x", "y"], ["x"]], 1)
    assert H.spread([[td("a"), td("b", 2)], [td("c")]]) == ([["a", "b"], ["c", "b"]], 0)
    assert H.spread([]) == ([], 0)
    assert [H.span(x) for x in (None, "", "0", "-2", "3", "x", "99999")] == [1, 1, 1, 1, 3, 1, H.MOST_SPAN]


def test_tables_with_spans(spark):
    t = "<h2>Fall 2025</h2><table><tr><th rowspan=2>Term</th><th colspan=2>Dates</th></tr><tr><th>Add</th><th>Drop</th></tr><tr><td rowspan='2'>Full</td><td>9/8</td><td>11/4</td></tr><tr><td colspan=2>none</td></tr></table>"
    rows = H.tables(pages(spark, t, "<table><tr><td>a</td></tr></table>", "<table></table>", None)).collect()
    assert [(r["heading"], r["headers"], r["rows"]) for r in rows] == [("Fall 2025", ["('Term', 'Term')", "('Dates', 'Add')", "('Dates', 'Drop')"], [["Full", "9/8", "11/4"], ["Full", "none", "none"]]), ("", ["a"], [])]


def test_repeated_headings_are_sections_of_their_own(spark):
    rows = H.sections(pages(spark, "<h1>T</h1><p>lead</p><h2>Notes</h2><p>one</p><h3>Rules</h3><h2>Notes</h2><p>two</p>", "<p>plain</p>", "")).collect()
    assert [(r["url"], r["title"], r["text"]) for r in rows if "/0" in r["url"]] == [
        ("https://u.example.com/0", "T", "T\nlead"), ("https://u.example.com/0#notes", "Notes", "Notes\none"), ("https://u.example.com/0#rules", "Rules", "Rules"), ("https://u.example.com/0#notes", "Notes", "Notes\ntwo")]
    assert [(r["url"], r["text"]) for r in rows if "/0" not in r["url"]] == [("https://u.example.com/1", "plain")]


def test_small_sections_are_taken_from_their_container(spark):
    long = "word " * 120
    html = f"""<p>lead</p><a id="requirementstext"></a><h2>Requirements</h2><a id="coursestext"></a><h2>Courses</h2><p>{long}</p>
    <div id="RequirementsTextContainer"><p>all of it</p><p>and more</p></div><div id="coursestextcontainer"><p>not this</p></div>"""
    rows = {r["url"].partition("#")[2]: r["text"] for r in H.sections(pages(spark, html)).collect()}
    assert rows["requirementstext"] == "all of it\nand more"
    assert rows["coursestext"].startswith("Courses\n" + long.strip()) and set(rows) == {"", "requirementstext", "coursestext"}


def test_sections_are_linear(spark):
    html = "".join(f"<h2>Head {i % 50}</h2><p>text {i}</p>" for i in range(1_000))
    began = time.time()
    assert H.sections(pages(spark, html)).count() == 1_000
    assert time.time() - began < 60


def test_sitemaps_as_xml(spark):
    ns = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
    files = spark.createDataFrame(
        [
            ("a", f"\n<?xml version='1.0'?><urlset {ns} xmlns:image='http://i'><!-- <url><loc>https://no</loc></url> --><url><image:image><image:loc>https://img</image:loc></image:image><loc>\n https://x/?a=1&amp;b=&quot;&#50;&#x33;\n</loc></url><url><lastmod>2024</lastmod></url></urlset>"),
            ("b", f"<m:sitemapindex xmlns:m='http://www.sitemaps.org/schemas/sitemap/0.9'><m:sitemap><m:loc><![CDATA[https://x/one.xml]]></m:loc></m:sitemap><m:sitemap><m:loc>https://x/users.xml</m:loc></m:sitemap></m:sitemapindex>"),
            ("c", "<urlset><url><loc>https://broken</loc>"), ("d", "not xml"), ("e", None), ("f", "<html><body/></html>"),
        ],
        "sitemap string, xml string",
    )
    assert [tuple(r)[:3] for r in readers.sitemap_urls(files).collect()] == [("a", 'https://x/?a=1&b="23', "")]
    assert [tuple(r)[:2] for r in readers.sitemap_children(files).collect()] == [("b", "https://x/one.xml")]
    assert {r["sitemap"] for r in readers.broken_sitemaps(files).collect()} == {"c", "d"}


def plain_courses(text):
    """The rules of course lines, a line at a time."""
    import re

    code, lines, out, i = re.compile(r"(?i)^(?:CSIT|MATH|AMAT|STAT|PHYS)\s*\d{3}\b"), re.split(r"\r\n|\n|\r", text), [], 0
    skip = lambda k: next((x for x in range(k, len(lines)) if lines[x].strip()), len(lines))
    while i < len(lines):
        if not code.match(lines[i].strip()):
            out.append(lines[i])
            i += 1
            continue
        entry, j = lines[i].strip(), skip(i + 1)
        titled = j < len(lines) and not code.match(lines[j].strip())
        if titled:
            entry, j = f"{entry} {lines[j].strip()}", j + 1
        k = skip(j)
        if titled and k < len(lines) and re.fullmatch(r"\d{1,2}", lines[k].strip()):
            entry, k = f"{entry} ({lines[k].strip()} credits)", k + 1
        out.append(entry)
        i = max(i + 1, j, k)
    return "\n".join(out)


def test_courses_equal_a_walk_over_the_lines(spark):
    r = random.Random(2)
    parts = ["CSIT 515", "math101 and text", "STAT 3333", "  PHYS 222  ", "Software", "3", "12", "123", "", "", " ", "end\r"]
    texts = ["", "\n\n", *["\n".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.normalize_courses(F.col("t")).alias("got")).collect()
    assert {x["i"]: x["got"] for x in rows} == {i: plain_courses(t) for i, t in enumerate(texts)}


def test_readers_keep_their_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path)
    first = snapshots.write_snapshot(spark.range(3), path)
    opened = snapshots.read_snapshot(spark, path)
    second = snapshots.write_snapshot(spark.range(10, 14), path)
    assert (first, second) == (1, 2) and opened.count() == 3
    assert snapshots.read_snapshot(spark, path).count() == 4 and snapshots.read_snapshot(spark, path, 1).count() == 3
    snapshots.write_snapshot(spark.range(1), path)
    snapshots.prune(spark, path, 2)
    assert snapshots.versions(spark, path) == [2, 3]


def test_cells_find_the_nearest(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    extra = spark.createDataFrame([(None, [1.0] * 64, 1), (9001, None, 1), (9002, [0.0] * 64, 1)], v.schema)
    found = InvertedFile(v)
    index = found.index(v.unionByName(extra), f"file://{tmp_path}/cells")
    assert index.count() == v.count() + 1
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r["qid"], r["vec_id"]) for r in V.vector_top_k(q, v, 10).collect()}
    got = {(r["qid"], r["vec_id"]) for r in found.search(q, index, 10).collect()}
    assert len(exact & got) / len(exact) >= 0.9
    n = 4_000  # in 40 groups, as vectors of texts lie
    near = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.rand(3) + 6 * F.pmod(F.xxhash64(F.col("id") % 40, i), F.lit(7))).cast("float"))
    grouped = spark.range(n).select(F.col("id").alias("vec_id"), near.alias("embedding"))
    snapshots.write_snapshot(grouped, f"file://{tmp_path}/grouped")
    grouped = snapshots.read_snapshot(spark, f"file://{tmp_path}/grouped")
    few = InvertedFile(grouped)
    at = few.index(grouped, f"file://{tmp_path}/few")
    asked = grouped.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r["qid"], r["vec_id"]) for r in V.vector_top_k(asked, grouped, 10).collect()}
    got = {(r["qid"], r["vec_id"]) for r in few.search(asked, at, 10).collect()}
    assert len(exact & got) / len(exact) >= 0.9 and few.candidates(asked, at).count() <= 0.1 * asked.count() * n
    nothing = InvertedFile(v.limit(0))
    assert nothing.search(q, nothing.index(v.limit(0), f"file://{tmp_path}/none"), 5).count() == 0


def test_exports_keep_their_keys(spark, tmp_path):
    from sparkloom.operators import tables as T

    t = spark.createDataFrame([("u", 0, "Fall 2025", ["Part of Term", "Final Day to Withdraw", "Final Day to Withdraw"], [["Full", "11/4", "x"], ["Session A", "", None]]), ("u", 3, "", ["A"], []), ("v", 0, "", ['say "q"', "B"], [["1", "2"]])], "url string, table_no int, heading string, headers array<string>, rows array<array<string>>")
    T.write_table_exports(t, f"file://{tmp_path}/x")
    rows = {r["url"]: r["j"] for r in T.read_summaries(spark, f"file://{tmp_path}/x").select("url", F.to_json("summary").alias("j")).collect()}
    import json

    assert json.loads(rows["u"]) == {"source": "table_extractor", "tables_found": 2, "rows": [{"Part of Term": "Full", "Final Day to Withdraw": "11/4"}, {"Part of Term": "Session A", "Final Day to Withdraw": ""}], "normalized_calendar": [{"term": "Fall 2025", "last_day_to_add_drop": None, "final_day_to_withdraw": "11/4"}, {"term": "Fall 2025", "last_day_to_add_drop": None, "final_day_to_withdraw": None}]}
    assert json.loads(rows["v"])["rows"] == [{'say "q"': "1", "B": "2"}]
    md = {r["url"]: r["md"] for r in spark.read.parquet(f"file://{tmp_path}/x/markdown").collect()}
    assert md["u"].startswith("### Table 1\n\n**SECTION:** Fall 2025\n\n**TERM:** Fall 2025\n\n| Part of Term |") and "### Table 2\n\n| A |\n| --- |" in md["u"]
    objects = sorted((json.loads(r[0]) for r in spark.read.text(f"file://{tmp_path}/x/rows").collect()), key=lambda o: -len(o["text"]))
    assert [o["text"] for o in objects] == ["**Part of Term:** Full\n**Final Day to Withdraw:** 11/4\n**Final Day to Withdraw:** x", "**Part of Term:** Session A"]
    assert objects[0]["meta"]["term"] == "Fall 2025" and objects[1]["meta"]["session"] == "Session a" and objects[0]["meta"]["waitlist_ends"] is None
    assert [r["term"] for r in readers.read_table_rows(spark, f"file://{tmp_path}/x/rows").collect()] == []


def test_pages_source(spark, tmp_path):
    from sparkloom.sources.http import PageSource, write_url_list

    for name, text in (("a.org/x/index.html", "<p>é</p>"), ("a.org/y.html", "y"), ("b.org/index.html", "b")):
        (tmp_path / "site" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / name).write_text(text, encoding="utf-8")
    spark.dataSource.register(PageSource)

    def read(rows):
        write_url_list(spark.createDataFrame(rows, "url string, etag string, last_modified string"), f"file://{tmp_path}/list")
        df = spark.read.format("pages").option("list", f"file://{tmp_path}/list").option("transport", "file").option("root", f"file://{tmp_path}/site").load()
        assert df.rdd.getNumPartitions() == max(1, len({r[0].split("/")[2].lower() for r in rows if r[0] and "//" in r[0]}))
        return {r["url"]: r for r in df.collect()}

    urls = [("https://A.org/x/", None, "Mon"), ("https://a.org/y.html", None, None), ("https://b.org", None, None), ("https://b.org/gone", "1", None), ("https://b.org/../../etc/passwd", None, None), (None, None, None), ("no url", None, None)]
    first = read(urls)
    assert {u: (r["status"], r["html"], r["code"]) for u, r in first.items()} == {"https://A.org/x/": ("ok", "<p>é</p>", 200), "https://a.org/y.html": ("ok", "y", 200), "https://b.org": ("ok", "b", 200), "https://b.org/gone": ("error", None, 404), "https://b.org/../../etc/passwd": ("error", None, 404)}
    (tmp_path / "site/a.org/y.html").write_text("new", encoding="utf-8")
    again = read([(u, r["etag"], r["last_modified"]) for u, r in first.items()])
    assert {u: r["status"] for u, r in again.items() if r["code"] != 404} == {"https://A.org/x/": "not-modified", "https://a.org/y.html": "ok", "https://b.org": "not-modified"}
    assert again["https://a.org/y.html"]["html"] == "new" and again["https://b.org"]["html"] is None
    assert read([("x", None, None)]) == {}


def test_pages_source_over_http(spark, tmp_path):
    """A server on this machine answers with 200, 304 and 500."""
    import http.server
    import threading

    from sparkloom.sources.http import PageSource, write_url_list

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = 500 if self.path == "/bad" else 304 if self.headers.get("If-None-Match") == '"1"' or self.headers.get("If-Modified-Since") == "Mon" else 200
            self.send_response(code)
            self.send_header("ETag", '"1"')
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            if code == 200:
                self.wfile.write("caf\xe9".encode("latin-1"))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(PageSource)
    write_url_list(spark.createDataFrame([(f"{at}/", None, None), (f"{at}/b", '"1"', None), (f"{at}/c", None, "Mon"), (f"{at}/bad", None, None), ("http://127.0.0.1:1/", None, None)], "url string, etag string, last_modified string"), f"file://{tmp_path}/list")
    rows = {r["url"].rpartition("/")[2] + str(r["code"] or ""): r for r in spark.read.format("pages").option("list", f"file://{tmp_path}/list").option("pause", 0).load().collect()}
    server.shutdown()
    assert {k: (r["status"], r["html"], r["etag"]) for k, r in rows.items()} == {"200": ("ok", "caf\xe9", '"1"'), "b304": ("not-modified", None, '"1"'), "c304": ("not-modified", None, '"1"'), "bad500": ("error", None, '"1"'), "": ("error", None, None)}
