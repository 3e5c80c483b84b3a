"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause's words are first tagged (insult, threat, target, negation, reported speech, quotation mark, other). The
tags then run through a cascade of small transducers, composed on the fly: each reads one symbol, writes one, and adds a
weight.

    negation   a negation opens a scope of a few words, in which insults and threats are written as denied
    reporting  after a verb of saying or inside quotation marks they are written as reported
    target     an insult or threat near a target (before or after it) is written as aimed

So a clause is scored as a whole: "you are an idiot" outweighs "idiot" alone, and "he never said they were
idiots" counts little. The weighted clause outputs are a document's features; a logistic regression fitted on labelled rows
outside the held-out fold turns them into a score. The insult list is a seed list and words learnt from the same rows:
words that are far more frequent in toxic rows.

The fit uses at most FIT_ROWS labelled rows (those with the smallest hash of the id), so what is broadcast (their ids and
labels) and what reaches the driver is bounded. Scoring is row by row over whole texts: no shuffle, and a lost task is just rerun.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import docs_only, held_out, map_frames

FIT_ROWS = 30_000
#: A learnt insult is in at least this share of the toxic rows (and 5 rows), and so many times likelier in them.
LEAST_SHARE, LEAST_LIFT = 0.01, 20.0

# Seed words of each class.
INSULTS = "bastard clown cretin degenerate disgusting dumb fool garbage idiot idiotic imbecile jerk loathsome loser moron moronic pathetic pig repulsive scum stupid trash vermin worthless"
THREATS = "beat crush destroy hang hurt kill murder punch shoot stab strangle threaten"
TARGETS = "he her him ihr it she that their them these they this those tu u ustedes vous you your yours"
NEGATIONS = "ain't aren't didn't doesn't don't hardly isn't kein keine never nicht no nobody none nor not nunca pas wasn't weren't without won't"
REPORTS = "accused alleged called calls claimed claims quoted reported said says shouted tells told wrote"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
# Outputs: plain, denied and reported insults and threats, and the aimed forms of the plain ones.
PLAIN_I, PLAIN_T, DENIED, REPORTED, AIMED_I, AIMED_T = 10, 11, 12, 13, 14, 15
#: Weight of each output symbol.
WEIGHT = {PLAIN_I: 1.0, PLAIN_T: 0.7, DENIED: 0.15, REPORTED: 0.25, AIMED_I: 2.0, AIMED_T: 2.0}
SCOPE, REACH = 3, 4

#: Clause ends and word characters: a table for str.translate would be slow, so ASCII bytes are mapped.
_END, _MARK, _BLANK = 1, 2, 32
_TABLE = bytes(b if 97 <= b <= 122 or b > 127 or b == 39 else _END if b in b".!?;:\n|" else _MARK if b == 34 else _BLANK for b in range(256))
_SPLIT = _TABLE.replace(bytes([_END]), b" ").replace(bytes([_MARK]), b" ")


class Transducer:
    """A weighted transducer: arcs map (state, symbol) to (state, symbol written, weight); others copy the symbol."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int, float]], fall: dict[int, int] | None = None):
        self.arcs, self.fall = arcs, fall or {}

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        if (arc := self.arcs.get((state, symbol))) is not None:
            return arc
        return self.fall.get(state, state), symbol, 0.0


def negation() -> Transducer:
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {(s, NEGATION): (SCOPE, OTHER, 0.0) for s in range(SCOPE + 1)}
    for s in range(1, SCOPE + 1):
        arcs |= {(s, x): (s - 1, DENIED, WEIGHT[DENIED]) for x in (INSULT, THREAT)}
    return Transducer(arcs, {s: s - 1 for s in range(1, SCOPE + 1)})


def reporting() -> Transducer:
    """States: 0 plain, 1 after a verb of saying, 2 inside quotation marks, 3 both."""
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for s in range(4):
        arcs[s, REPORT] = (s | 1, OTHER, 0.0)
        arcs[s, QUOTE] = (s ^ 2, OTHER, 0.0)
        if s:
            arcs |= {(s, x): (s, REPORTED, WEIGHT[REPORTED]) for x in (INSULT, THREAT)}
    return Transducer(arcs)


def aiming() -> Transducer:
    """States: words left in which a target just read (1..REACH) or an insult just read (-1..-REACH) still reaches."""
    aimed = {INSULT: (AIMED_I, PLAIN_I), THREAT: (AIMED_T, PLAIN_T)}
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for s in range(-REACH, REACH + 1):
        for x, (yes, no) in aimed.items():
            arcs[s, x] = (0, yes, WEIGHT[yes]) if s > 0 else (-REACH, no, WEIGHT[no])
        arcs[s, TARGET] = (0, AIMED_I, WEIGHT[AIMED_I] - WEIGHT[PLAIN_I]) if s < 0 else (REACH, TARGET, 0.0)
    return Transducer(arcs, {s: s - 1 if s > 0 else s + 1 for s in range(-REACH, REACH + 1) if s})


class Cascade:
    """Transducers composed: each symbol goes through all of them; weights add up."""

    def __init__(self, machines: list[Transducer]):
        self.machines = machines
        self.made: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int, float]] = {}

    def step(self, states: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int, float]:
        """One arc of the composed machine; it is built when first used and kept (there are finitely many)."""
        if (arc := self.made.get((states, symbol))) is None:
            out, total, nxt = symbol, 0.0, []
            for m, s in zip(self.machines, states, strict=True):
                s, out, w = m.step(s, out)
                nxt.append(s)
                total += w
            self.made[states, symbol] = arc = (tuple(nxt), out, total)
        return arc

    def run(self, symbols: list[int]) -> tuple[float, Counter]:
        """A clause's weight, and how often each output was written."""
        states, total, seen = (0,) * len(self.machines), 0.0, Counter()
        for x in symbols:
            states, out, w = self.step(states, x)
            total += w
            if out >= PLAIN_I:
                seen[out] += 1
        return total, seen


@dataclass
class Grammar:
    """The tagging lexicon and the cascade."""

    insults: frozenset[str]
    tags: dict[bytes, int] = field(init=False)
    strong: frozenset[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.tags = {}
        for words, tag in ((TARGETS.split(), TARGET), (REPORTS.split(), REPORT), (NEGATIONS.split(), NEGATION), (THREATS.split(), THREAT), (sorted(self.insults), INSULT)):
            self.tags |= {w.encode(): tag for w in words}
        self.strong = frozenset(w for w, t in self.tags.items() if t in (INSULT, THREAT))
        self.cascade = Cascade([negation(), reporting(), aiming()])

    def clauses(self, text: str | None) -> list[tuple[float, Counter]]:
        """Weight and outputs of each clause of the text that holds an insult or a threat."""
        raw = text.lower().encode("utf-8", "surrogatepass") if text else b""
        words = raw.translate(_SPLIT).split()
        if self.strong.isdisjoint(words):
            return []
        out = []
        for clause in raw.translate(_TABLE).split(bytes([_END])):
            own = clause.replace(bytes([_MARK]), b" \x02 ").split()
            if not self.strong.isdisjoint(own):
                out.append(self.cascade.run([QUOTE if w == b"\x02" else self.tags.get(w, OTHER) for w in own]))
        return out

    def features(self, text: str | None) -> tuple[float, ...]:
        """log(1 + count) of each output, the largest clause weight, log(1 + total weight), and whether any clause matched."""
        found = self.clauses(text)
        seen: Counter = sum((c for _, c in found), Counter())
        weights = [w for w, _ in found]
        return (*(math.log1p(seen[x]) for x in WEIGHT), max(weights, default=0.0), math.log1p(max(0.0, sum(weights))), float(bool(found)))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression on rows that occur n times; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - penalty * beta
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[frozenset[str], np.ndarray]:
    """The insult list and the regression, from at most ``fit_rows`` labelled rows outside the held-out fold.

    A label that is given twice counts twice, and so does a document that occurs twice.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id")).select(labels["doc_id"].alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    picked = marks.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(fit_rows)
    rows = docs_only(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", F.col("_toxic").alias("toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {0: Counter(), 1: Counter()}
        size = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic > 0)].update(set(text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()))
                size[int(toxic > 0)] += 1
        words = [w for w in seen[1] if seen[1][w]]
        yield pd.DataFrame({"word": [b"", *words], "bad": [size[1], *(seen[1][w] for w in words)], "good": [size[0], *(seen[0][w] for w in words)]})
        rest = [w for w in seen[0] if w not in seen[1]]
        yield pd.DataFrame({"word": rest, "bad": [0] * len(rest), "good": [seen[0][w] for w in rest]})

    words = map_frames(rows, count, "word binary, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = words.filter(F.octet_length("word") == 0).first()
    insults = frozenset(INSULTS.split())
    if not total or not total["bad"] or not total["good"]:
        return insults, np.array([*[1.0] * len(WEIGHT), 0.5, 0.5, 1.0, -3.0])
    bad, good = total["bad"], total["good"]
    lift = (F.col("bad") / bad) / ((F.col("good") + 0.5) / (good + 1.0))
    learnt = words.filter((F.octet_length("word") > 0) & (F.col("bad") >= max(5, LEAST_SHARE * bad)) & (lift >= LEAST_LIFT)).select("word").collect()
    other = {w for group in (TARGETS, NEGATIONS, REPORTS, THREATS) for w in group.split()}
    insults |= {bytes(r["word"]).decode("utf-8", "replace") for r in learnt} - other

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(insults)
        for batch in batches:
            yield pd.DataFrame({"x": [list(grammar.features(t)) for t in batch["text"]], "y": batch["toxic"].to_numpy()})

    # Equal rows are counted, not listed: most texts match nothing and share one row.
    sample = map_frames(rows, measure, "x array<double>, y int").groupBy("x", "y").count().toPandas()
    x = np.array(sample["x"].tolist())
    y = (sample["y"].to_numpy() > 0).astype(float)
    n = sample["count"].to_numpy()
    return insults, fit_logistic(x, y, n.astype(float))


def score_documents(docs: DataFrame, model: tuple[frozenset[str], np.ndarray]) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5), n_clauses, weight (the heaviest clause's).

    Null and empty texts match nothing and have the score of a text without a match. Rows are scored
    one by one, so repeated rows and null ids need no care. Other columns are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        insults, beta = shared.value
        grammar = Grammar(insults)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch["t"]]).reshape(len(batch), len(beta) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            clauses = np.rint(np.expm1(x[:, : len(WEIGHT)]).sum(axis=1)).astype(np.int64)
            yield batch.drop(columns="t").assign(score=p, predicted=(p >= 0.5).astype(np.int32), n_clauses=clauses, weight=x[:, len(WEIGHT)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("t"))
    return map_frames(rows, score, f"doc_id {kind}, held_out boolean, score double, predicted int, n_clauses long, weight double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The query: fits on the labels outside the held-out fold and scores every whole document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit(docs, labels))
