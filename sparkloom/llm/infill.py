"""Fill-in-middle: a text is cut at two places between its units and put together again with its middle last.

An Arrow-batched pandas UDF does the work of a batch: ``finditer`` of the regex library gives the units, whose end offsets
lie in one compact array (four bytes a unit); two look-ups in it give the cuts; hashlib gives the seeds. Rows are
independent: no shuffle and no state, and a lost task is just run again. A worker holds one batch of bounded bytes and
the offsets of one text.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import bound_batches, docs_only

#: Patterns of the units that a text may be cut into.
UNITS = {"character": r"(?s:.)", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Infill:
    """The rule of one transformation.

    ``plain`` and ``spm`` are shares in percent: of texts left as they are, and, of the others, of those whose suffix goes
    first. ``marks`` stand before prefix, suffix and middle; none may occur in another, nor begin with another's end.
    """

    unit: str = UNITS["character"]
    seed: str = "1"
    plain: int = 10
    spm: int = 20
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        ends = {m[-k:] for m in self.marks for k in range(1, len(m))}
        if len(set(self.marks)) < 3 or any(not m or any(m.startswith(e) for e in ends) or any(m in o for o in self.marks if o != m) for m in self.marks):
            raise ValueError("marks must be distinct and must not overlap")

    def draws(self, key: str) -> list[int]:
        """Four numbers below 2^32 that the seed and the document's key fix."""
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).digest()
        return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]

    def cut(self, key: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, characters of prefix and middle (None if plain), and the text in its new order."""
        ends = array("I", [0])
        ends.extend(m.end() for m in regex.finditer(self.unit, text))
        n = len(ends) - 1
        h1, h2, h3, h4 = self.draws(key)
        if not text or h3 % 100 >= 100 - self.plain or any(m in text for m in self.marks):
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = ends[a], ends[b]
        p, s, m = self.marks
        if h4 % 100 < self.spm:
            return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))

    def restore(self, form: str, output: str) -> str:
        """The text that an output of this form was made from."""
        if form == "plain":
            return output
        p, s, m = self.marks
        first, second = (p, s) if form == "psm" else (s, p)
        one, _, rest = output[len(first) :].partition(second)
        two, _, middle = rest.partition(m)
        return one + middle + two if form == "psm" else two + middle + one


def infill_column(key: Column, text: Column, rule: Infill) -> Column:
    """n, form, prefix_chars, middle_chars, output as one struct."""

    @F.pandas_udf(PARTS)
    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([rule.cut(k, t) for k, t in zip(keys, texts, strict=True)], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def restored_digests(form: Column, output: Column, rule: Infill) -> Column:
    """SHA-256 of an output and of the text rebuilt from it, as one struct."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def digests(forms: pd.Series, outputs: pd.Series) -> pd.DataFrame:
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        return pd.DataFrame([(sha(o), sha(rule.restore(f, o))) for f, o in zip(forms, outputs, strict=True)], columns=["output_sha256", "restored_sha256"])

    return digests(form, output)


def fill_in_middle(docs: DataFrame, rule: Infill | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text in its new order: ``key``, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Null and empty texts are plain and give "". A null key draws as the key "". Rows are returned as they come, repeated ones
    alike; other columns are left behind; an empty table gives no row. A text that holds a mark stays plain, so every output
    can be told apart and restored.
    """
    bound_batches(docs.sparkSession)
    rows = docs_only(docs, key, text).toDF("k", "t")
    return rows.select(F.col("k").alias(key), infill_column(F.col("k"), F.col("t"), rule or Infill()).alias("x")).select(key, "x.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole document cut between code points; digests of the output and of what it restores to."""
    rule = Infill()
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), rule)
    return out.withColumn("d", restored_digests(F.col("form"), F.col("output"), rule)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.*")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
v AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM w
"""
