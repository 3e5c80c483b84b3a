"""Files that tasks write, united chunks and the topic filter's scope."""

import io

from pyspark.sql import functions as F

from sparkloom.operators import chunking as C
from sparkloom.operators import selection as S
from sparkloom.sources import files, readers, writers


def test_markdown_files_are_read_again(spark, tmp_path):
    docs = spark.createDataFrame([("https://u.org/a/", "It's A", "policies", ["x", "y"], "# A\nbody"), ("https://u.org/b.html", None, "registrar", None, None), (None, "no", "b", [], "lost"), ("https://u.org/../../c", "C", "b", [], "kept inside")], "source_url string, source_title string, bucket string, tags array<string>, md string")
    root = f"file://{tmp_path}/processed"
    done = {r["path"]: r["bytes"] for r in files.write_files(files.document_files(docs), root).collect()}
    assert set(done) == {"a/index.md", "b.md", "c.md"} and done["b.md"] == (tmp_path / "processed/b.md").stat().st_size
    got = {r["source_url"]: (r["bucket"], r["tags"], r["md"].strip()) for r in readers.read_markdown(spark, root).collect()}
    assert got == {"https://u.org/a/": ("policies", ["x", "y"], "# A\nbody"), "https://u.org/b.html": ("registrar", [], ""), "https://u.org/../../c": ("b", [], "kept inside")}

    secs = spark.createDataFrame([("https://u.org/p/cs/#requirementstext", "Requirements", "all of it"), ("https://u.org/p/cs/", "", "lead")], "url string, title string, text string")
    files.write_files(files.section_files(secs, "catalog"), root).collect()
    text = (tmp_path / "processed/p/cs/index__requirementstext.md").read_text()
    assert text == "---\nsource_url: 'https://u.org/p/cs/#requirementstext'\nsource_title: 'Requirements'\nbucket: 'catalog'\ntags: ['catalog', 'catalog-section']\n---\n\n## Requirements\n\nall of it"
    assert (tmp_path / "processed/p/cs/index.md").read_text().endswith("---\n\nlead")


def test_downloads_and_stubs(spark, tmp_path):
    urls = spark.createDataFrame([("https://u.org/x/a.PDF", "uploads-pdf"), ("https://u.org/gone.pdf", "uploads-pdf"), ("https://u.org/page", "b"), (None, "b")], "url string, bucket string")

    def open_url(url):
        if "gone" in url:
            raise OSError("404")
        return io.BytesIO(b"%PDF" * 100_000)

    rows = {r["path"]: (r["bytes"], r["error"]) for r in files.download(urls.filter(F.lower("url").endswith(".pdf")), f"file://{tmp_path}/raw", open_url).collect()}
    assert rows == {"x/a.PDF": (400_000, None), "gone.pdf": (None, "OSError: 404")}
    assert [p.name for p in (tmp_path / "raw").rglob("*") if p.is_file()] == ["a.PDF"]
    files.write_files(files.pdf_stubs(urls), f"file://{tmp_path}/processed").collect()
    assert "tags: ['uploads-pdf', 'pdf']\n---\n\n(PDF content not yet extracted)" in (tmp_path / "processed/x/a-pdf.md").read_text()
    assert readers.read_markdown(spark, f"file://{tmp_path}/processed").count() == 0


def test_united_chunks_and_allowed_buckets(spark, tmp_path):
    assert [C.allowed_buckets(c) for c in (None, {}, {"allowed_buckets": "x"}, {"allowed_buckets": []}, {"allowed_buckets": ["a ", "b", "a"]}, {"allowed_buckets": ["a", "*"]})] == [["registrar"]] * 4 + [["a", "b"], ["*"]]
    docs = spark.createDataFrame([("https://u.org/a", "A", "policies", ["t"], "# H\nsome text")], "source_url string, source_title string, bucket string, tags array<string>, md string")
    rows = spark.createDataFrame([("https://u.org/t", "Dates", "**A:** 1", b, "Fall 2025", True) for b in ("registrar", "registrar", "other")], "url string, section_heading string, text string, bucket string, term string, has_deadline_words boolean")
    one = C.united_chunks(C.chunk_documents(docs), rows)
    assert sorted((r["bucket"], r["has_deadline_words"] is None) for r in one.collect()) == [("policies", True), ("registrar", False)]
    writers.write_json(one, f"file://{tmp_path}/chunks")
    assert readers.read_chunks(spark, f"file://{tmp_path}/chunks").count() == 2


def test_topic_filter_looks_at_its_buckets_alone(spark):
    docs = spark.createDataFrame([(1, "policies", "grades and credits"), (2, "policies", "nothing"), (3, "registrar", "nothing"), (4, None, None), (5, "uploads-pdf", None)], "i int, bucket string, text string")
    topics = {"t": (["grades", "credits"], [])}
    got = lambda **k: {r["i"] for r in S.topic_filter(docs, topics, **k).filter("in_scope").collect()}
    assert got() == {1} and got(buckets=S.TOPIC_BUCKETS) == {1, 3, 4}
