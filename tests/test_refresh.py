"""The keyed refresh against a plain walk over the batches."""

import hashlib
import json


def test_keyed_refresh_equals_the_batches(spark, tmp_path):
    from sparkloom.streaming.incremental import refresh_keyed

    batches = [
        [("a", "one", 1), ("b", "two", 1), ("c", None, 1), (None, "x", 1)],
        [("a", "one", 2), ("b", "three", 3), ("b", "two again", 2), ("d", "new", 1)],
        [("c", "", 5), ("a", "four", 9)],
        [("a", "one", 10)],
    ]
    known, want = {}, []
    for i, rows in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("url", "html", "ordinal"), r))) for r in rows))
        stream = spark.readStream.schema("url string, html string, ordinal long").json(f"file://{tmp_path}/in")
        query = refresh_keyed(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ckpt")
        assert query.awaitTermination(120) and query.exception() is None
        for url in sorted({r[0] for r in rows if r[0]}):
            html = max((r for r in rows if r[0] == url), key=lambda r: r[2])[1] or ""
            sha = hashlib.sha1(html.encode()).hexdigest()
            if known.get(url) != sha:
                want.append((url, html, sha, known.get(url)))
                known[url] = sha
        assert sorted(map(str, (tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()))) == sorted(map(str, want))
