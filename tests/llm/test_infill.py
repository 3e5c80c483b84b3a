"""Fill-in-middle against plain slicing, and odd rows."""

import hashlib

import pytest

from tests.conftest import DATA
from tests.llm.test_operators import ODD, clash, frame


def plain(doc_id, text):
    """The transformation of one text as the query's contract words it."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", lo, hi - lo, f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [*ODD, *[(i, "has <M> in it <P") for i in range(20, 24)], *[(i, "ends in <P and S> or < 🙂\r\n" * (i - 29)) for i in range(30, 60)], (60, "é" * 300_000)]


def test_infill_equals_plain_slicing(spark):
    from sparkloom.llm.infill import fill_in_middle

    got = [tuple(r) for r in fill_in_middle(clash(frame(spark, TEXTS))).collect()]
    assert sorted(map(str, got)) == sorted(str((k, *plain(k, t))) for k, t in TEXTS)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_infill_query_over_whole_documents(spark):
    from sparkloom.llm.infill import op11_fill_in_middle

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op11_fill_in_middle(spark, DATA).collect()
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        n, form, a, m, output = plain(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, a, m, sha(output), sha(docs[r["doc_id"]] or ""))


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_infill_cuts_between_units_and_restores(spark, unit):
    from sparkloom.llm.infill import UNITS, Infill, fill_in_middle

    rule = Infill(unit=UNITS[unit], plain=0, spm=50)
    text = "one two\nthree  four\r\nfive\n\n six"
    for r in fill_in_middle(frame(spark, [(i, text) for i in range(60)]), rule).collect():
        assert rule.restore(r["form"], r["output"]) == text
        for at in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]):
            if unit == "word" and 0 < at < len(text):
                assert not text[at].isspace()
            if unit == "line" and 0 < at < len(text):
                assert text[at - 1] == "\n"


def test_infill_marks_must_not_overlap():
    from sparkloom.llm.infill import Infill

    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P>", "><", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            Infill(marks=marks)
