"""Language identification by multilingual mixture inference.

Training counts byte trigrams of the lower-cased words for each language, over all labelled rows outside the
held-out fold; the counts are summed by Spark, and the table that reaches the driver has at most
GRAMS x languages numbers. A document is a sequence of units of UNIT words; a unit's likelihood under a language is
the product of its trigrams' probabilities. Expectation-maximisation finds the proportions of the languages; then
the weakest language is dropped for as long as that raises the penalised likelihood (the Bayesian information
criterion), which selects the document's language set.

Documents are scored where they are read: no shuffle, and a lost task is just rerun.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import docs_only, held_out, map_frames

GRAMS = 1 << 16
UNIT = 8
#: EM steps of the first fit and of each fit after a language was dropped.
STEPS, MORE = 12, 6
SMOOTH = 0.5
#: Bytes handled at once.
SLICE = 1 << 20
UNKNOWN = "und"

#: ASCII letters and all bytes over 127 stay; the rest separate words.
_TABLE = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_ascii_letter = re.compile("[A-Za-z]").search


def has_letter(text: str) -> bool:
    """Numerals such as a half or a circled one are no letters."""
    return bool(_ascii_letter(text)) or any(map(str.isalpha, text))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def grams_of(raw: np.ndarray) -> np.ndarray:
    """The number (below GRAMS) of the trigram that begins at each byte but the last two."""
    code = raw[:-2].astype(np.uint32) | (raw[1:-1].astype(np.uint32) << 8) | (raw[2:].astype(np.uint32) << 16)
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(16)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and log p(trigram | language) as a GRAMS x languages table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                have = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                held, size = [], 0
                for text in group["text"]:
                    held.append(b" ".join(words_of(text)))
                    size += len(held[-1])
                    if size > SLICE:
                        have += _counts(held)
                        held, size = [], 0
                have += _counts(held)
        for lang, have in sums.items():
            used = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "gram": used.astype(np.int32), "n": have[used]})

    rows = docs_only(docs, "doc_id", "text", "lang").filter(~held_out("doc_id")).filter("lang is not null and text is not null").select("text", "lang")
    total = map_frames(rows, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(total["lang"].unique().tolist())
    table = np.full((GRAMS, len(langs)), SMOOTH)
    for i, lang in enumerate(langs):
        own = total[total["lang"] == lang]
        table[own["gram"].to_numpy(), i] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _counts(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" " + b"  ".join(parts) + b" ", np.uint8)
    return np.bincount(grams_of(raw), minlength=GRAMS) if len(raw) > 2 else np.zeros(GRAMS, np.int64)


def unit_likelihoods(text: str, table: np.ndarray) -> np.ndarray:
    """Log-likelihoods, units x languages, of a text that has a letter."""
    words = words_of(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[::UNIT]
    raw = np.frombuffer(b" " + b" ".join(words) + b"  ", np.uint8)
    ends = np.append(starts[1:], len(raw) - 2)
    out = np.empty((len(starts), table.shape[1]), np.float32)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        grams = grams_of(raw[starts[lo] : ends[hi - 1] + 2])
        np.add.reduceat(table[grams], starts[lo:hi] - starts[lo], axis=0, out=out[lo:hi])
        lo = hi
    return out


def infer(likelihoods: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For several documents at once: the language proportions, and the size of each language set."""
    sizes = np.array([len(x) for x in likelihoods])
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = np.repeat(np.arange(len(sizes)), sizes)
    every = np.concatenate(likelihoods).astype(np.float64)
    top = every.max(axis=1)
    p = np.exp(np.maximum(every - top[:, None], -700.0))
    base = np.add.reduceat(top, at)
    count, n = len(sizes), p.shape[1]
    charge = 0.5 * np.log(np.maximum(sizes, 2))

    def fit(share: np.ndarray, steps: int, p: np.ndarray, of: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            r = p * share[of]
            r /= r.sum(axis=1, keepdims=True)
            share = np.add.reduceat(r, at, axis=0) / sizes[:, None]
        with np.errstate(divide="ignore"):
            return share, np.add.reduceat(np.log(np.maximum((p * share[of]).sum(axis=1), 1e-300)), at)

    share, like = fit(np.full((count, n), 1.0 / n), STEPS, p, of, at, sizes)
    active = np.ones((count, n), bool)
    open_ = np.flatnonzero(active.sum(axis=1) > 1)
    while len(open_):
        keep = np.isin(of, open_)
        own = np.searchsorted(open_, of[keep])
        own_sizes = sizes[open_]
        own_at = np.concatenate(([0], np.cumsum(own_sizes)[:-1]))
        drop = np.where(active[open_], share[open_], np.inf).argmin(axis=1)
        less = active[open_].copy()
        less[np.arange(len(open_)), drop] = False
        start = np.where(less, np.maximum(share[open_], 1e-6), 0.0)
        one = less.sum(axis=1) == 1
        # the last language standing need not be the one with the largest share: take the likelier
        if one.any():
            alone = np.add.reduceat(np.where(p[keep] > 0, np.log(np.maximum(p[keep], 1e-300)), -690.0), own_at, axis=0)
            best = alone.argmax(axis=1)
            less[one] = False
            less[one, best[one]] = True
            start[one] = less[one].astype(float)
        fitted, fitted_like = fit(start / start.sum(axis=1, keepdims=True), MORE, p[keep], own, own_at, own_sizes)
        gain = (fitted_like - like[open_]) + charge[open_] > 0
        won = open_[gain]
        share[won], like[won], active[won] = fitted[gain], fitted_like[gain], less[gain]
        open_ = won[active[won].sum(axis=1) > 1]
    assert np.isfinite(base).all()
    return share, active.sum(axis=1)


def predict_texts(texts: list[str | None], langs: list[str], table: np.ndarray) -> list[tuple[str, float, int, list[float]]]:
    """(language, its share, languages in the set, all shares) of each text."""
    out: list[tuple[str, float, int, list[float]]] = [(UNKNOWN, 0.0, 0, [])] * len(texts)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            share, n = infer([x for _, x in held])
            for (i, _), s, k in zip(held, share, n.tolist(), strict=True):
                best = int(s.argmax())
                out[i] = (langs[best], min(1.0, float(s[best])), k, s.tolist())
            held.clear()

    size = 0
    for i, text in enumerate(texts):
        if langs and text and has_letter(text):
            held.append((i, unit_likelihoods(text, table)))
            size += len(held[-1][1])
            if size > 40_000:
                flush()
                size = 0
    flush()
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """Adds held_out, lang_pred, score, n_langs and shares (language -> proportion) to doc_id.

    Null and letterless texts are ``und`` with score 0, and so is everything if there is nothing to learn
    from. Rows are scored one by one: repeated rows and null ids need no care; ties between languages go to
    the first by name. Other columns are left behind.
    """
    langs, table = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own = shared.value
        for batch in batches:
            got = predict_texts(batch["t"].tolist(), names, own)
            out = batch.drop(columns="t")
            yield out.assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got], n_langs=[g[2] for g in got], shares=[dict(zip(names, g[3])) for g in got])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("t"))
    return map_frames(rows, score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_langs int, shares map<string,double>")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents (all columns) whose language set is known: only ``und`` goes, however the shares are dealt.

    Where nothing could be learnt, all rows stay.
    """
    model = train(docs)
    if not model[0]:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = predict_texts(batch["text"].tolist(), *shared.value)
            yield batch[[g[0] != UNKNOWN for g in got]]

    return map_frames(docs, keep, docs.schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The query: every whole document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
