"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone, by fixed patterns and checks) are always kept. Beyond them, wider patterns
propose candidates: card- and phone-like numbers that the base patterns dropped, secrets, account numbers. Every
candidate, base or not, is voted on (for, against or no vote) by labelers of three sorts: pattern
labelers (shape, check digits), gazetteer labelers (known prefixes, top-level domains, reserved ranges) and context
labelers (words before the span, what stands around it).

Spark counts the vote patterns and shapes (levels of length, digits and entropy) of all candidates of all documents; there are at
most 3 ** labelers patterns and 280 shapes a kind, so the counts that reach the driver are bounded. Expectation-maximisation on
the vote patterns' counts estimates each labeler's reliability and each pattern's probability; a logistic regression on votes and shape,
trained on those probabilities, is the final span classifier. Two passes over the documents, no shuffle of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import docs_only, map_frames

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "card_like", "phone_like")
KINDS = BASE + ADDED
THRESHOLD = 0.5

# The base patterns. An e-mail's domain is matched behind each @; an ip begins at the first digit of a run, which
# finds the same matches as the plain pattern without trying every digit of a long run.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The wider patterns.
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{32,}+(?![A-Za-z0-9_/+-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

# Context words (in several languages), domains, card prefixes.
CONTEXT = {
    "email": "contact e-mail email mail correo courriel adresse write",
    "ip": "address client from host ip login server",
    "card": "amex card carte credit karte mastercard number pan tarjeta visa",
    "phone": "call cell fax mobile phone tel telefon telefono telephone",
    "secret": "api apikey auth bearer credential key passwd password pwd secret token",
    "account": "account bank iban konto social ssn",
}
CONTEXT |= {"card_like": CONTEXT["card"], "phone_like": CONTEXT["phone"]}
CONTEXT_WORDS = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
AGAINST_WORDS = frozenset("commit digest hash isbn issn md5 order part revision serial sha sha1 sha256 sku uuid version".split())
DOMAINS = frozenset("com org net edu gov io co de fr es uk us info eu ca".split())
CARD_PREFIXES = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65", "35", "30", "36", "38")

LABELERS = ("shape", "check", "gazetteer", "context", "counter", "border")
_digits = re.compile(r"[0-9]").search
_ascii_letter = re.compile(r"[A-Za-z]").search
_before = re.compile(r"[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of the e-mail pattern."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)]
    if _digits(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p := q.lstrip("0") or "0") <= 3 and int(p) <= 255 for q in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that only the wider patterns propose; they may overlap each other and base spans."""
    if not _digits(text):
        return []
    out = [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if _digits(m.group()) and _ascii_letter(m.group())]
    out += [(m.start(), m.end(), "account") for m in ACCOUNT.finditer(text)]
    out += [(m.start(), m.end(), "phone_like") for m in LOCAL_PHONE.finditer(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and not luhn(digits):
            out.append((m.start(), m.end(), "card_like"))
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    shape = check = gazetteer = 0
    if kind == "email":
        name, _, domain = span.partition("@")
        shape = 1 if 1 <= len(name) <= 64 and ".." not in span and not name.startswith(".") else -1
        check = 1 if domain.rpartition(".")[2].isalpha() else -1
        gazetteer = 1 if domain.rpartition(".")[2].lower() in DOMAINS else 0
    elif kind == "ip":
        parts = [int(p.lstrip("0") or "0") for p in span.split(".")]
        shape = 1 if all(str(p) == q for p, q in zip(parts, span.split("."), strict=True)) else -1
        check = 1 if max(parts) > 20 else -1  # version numbers are small
        gazetteer = -1 if parts[0] in (0, 127, 255) else 1 if parts[0] < 224 else 0
    elif kind in ("card", "card_like"):
        shape = 1 if len(digits) in (15, 16) else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif kind in ("phone", "phone_like"):
        shape = 1 if span.count("(") == span.count(")") else -1
        check = 1 if 10 <= len(digits) <= 13 else -1
        gazetteer = 1 if span.startswith("+") and not digits.startswith("0") else 0
    elif kind == "secret":
        shape = 1 if len(span) in (32, 36, 40, 64) else 0
        check = 1 if entropy(span) >= 3.3 else -1
        gazetteer = 1 if text[max(0, start - 1) : start] in "\"'=" and text[end : end + 1] in "\"'" else 0
    else:
        shape = 1
        check = 1 if len(set(digits)) > 3 else -1
        gazetteer = 0
    words = [w.lower() for w in _before.findall(text[max(0, start - 40) : start])[-4:]]
    context = 1 if any(w in CONTEXT_WORDS[kind] for w in words) else 0
    counter = -1 if any(w in AGAINST_WORDS for w in words) else 0
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    border = -1 if before.isalnum() or after.isalnum() else 1
    return shape, check, gazetteer, context, counter, border


def shape_of(span: str) -> tuple[int, int, int]:
    """Levels of a span's length (0 to 7), share of digits (0 to 4) and entropy in bits (0 to 6)."""
    return min(7, len(span).bit_length()), 4 * sum(map(str.isdigit, span)) // max(1, len(span)), min(6, int(entropy(span)))


Seen = tuple[str, tuple[int, ...], tuple[int, int, int]]


def seen(text: str, start: int, end: int, kind: str) -> Seen:
    """What the classifier knows of a span: kind, votes, shape."""
    return kind, votes(text, start, end, kind), shape_of(text[start:end])


def expectation_maximisation(counts: dict[tuple[int, ...], int], steps: int = 100) -> tuple[dict[tuple[int, ...], float], float, np.ndarray]:
    """Dawid and Skene's model for one kind: (probability of each vote pattern, prior, reliabilities).

    reliabilities[labeler, truth, vote + 1]: how often the labeler votes so on spans of that truth.
    It starts from the patterns' majority, and pseudo-counts keep every reliability off 0 and 1.
    """
    patterns = sorted(counts)
    v = np.array(patterns) + 1
    n = np.array([counts[p] for p in patterns], float)
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))
    onehot = np.eye(3)[v]
    prior, rel = 0.5, np.zeros((v.shape[1], 2, 3))
    for _ in range(steps):
        w = np.stack([n * (1 - p), n * p])
        prior = float((w[1].sum() + 1) / (n.sum() + 2))
        # a weak belief that votes are right keeps the two truths from changing places
        rel = np.einsum("tp,plv->ltv", w, onehot) + np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])
        rel /= rel.sum(axis=2, keepdims=True)
        logs = np.log(rel)[np.arange(v.shape[1])[None, :], :, v].sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] + math.log(1 - prior) - logs[:, 1] - math.log(prior), -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(patterns, p.tolist(), strict=True)), prior, rel


def span_features(kind: str, vote: tuple[int, ...], shape: tuple[int, int, int] = (0, 0, 0)) -> list[float]:
    """The classifier's inputs: votes for, votes against, the kind, the shape (where it is known)."""
    return [*(float(x > 0) for x in vote), *(float(x < 0) for x in vote), *(float(kind == k) for k in KINDS), shape[0] / 7, shape[1] / 4, shape[2] / 6]


def train_classifier(counts: dict[Seen, int]) -> np.ndarray:
    """A logistic regression on all candidates' votes and shapes, with EM's probabilities of the votes as targets.

    Patterns weigh as often as they occur, at any size: a rare kind isn't pulled to the prior as others grow.
    """
    x, y, n = [], [], []
    for kind in sorted({k for k, *_ in counts}):
        own: Counter = Counter()
        for (k, v, *_), c in counts.items():
            own[v] += c if k == kind else 0
        p, _, _ = expectation_maximisation({v: c for v, c in own.items() if c})
        for (k, v, *s), c in sorted(counts.items()):
            if k == kind:
                x.append(span_features(kind, v, *s))
                y.append(p[v])
                n.append(c)
    width = len(span_features(KINDS[0], (0,) * len(LABELERS))) + 1
    beta = np.zeros(width)
    if not x:
        return beta
    a = np.column_stack([np.array(x), np.ones(len(x))])
    yy, nn = np.array(y), np.array(n, float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (nn * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(width), a.T @ (nn * (yy - p)) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, text: str = "text") -> dict[Seen, float]:
    """The final classifier as a table: (kind, votes, shape) -> probability, from the candidates of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                if t and (_digits(t) or "@" in t):
                    found.update(seen(t, a, b, k) for a, b, k in chain(base_spans(t), candidates(t)))
        if found:
            yield pd.DataFrame({"kind": [k for k, *_ in found], "v": [list(v) for _, v, _ in found], "s": [list(s) for *_, s in found], "n": list(found.values())})

    total = map_frames(docs_only(docs, text).toDF("t"), count, "kind string, v array<int>, s array<int>, n long").groupBy("kind", "v", "s").agg(F.sum("n").alias("n")).collect()
    counts = {(r["kind"], tuple(r["v"]), tuple(r["s"])): r["n"] for r in total}
    beta = train_classifier(counts)
    return {x: float(1 / (1 + math.exp(-float(np.clip(np.dot(span_features(*x), beta[:-1]) + beta[-1], -30, 30))))) for x in counts}


def find(text: str, model: dict[Seen, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that the classifier adds; an added span overlaps no span that comes before it in
    the order of base spans, then falling probability, then place."""
    if not (_digits(text) or "@" in text):
        return [], []
    base = base_spans(text)
    more = sorted((-p, a, b, k) for a, b, k in candidates(text) if (p := model.get(seen(text, a, b, k), 0.0)) >= THRESHOLD)
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b, _ in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    added = []
    for _, a, b, k in more:
        at = bisect_left(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            added.append((a, b, k))
    return base, added


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans (and the digest of ""). Rows are handled one by one, so
    repeated rows and null ids need no care; in an empty table nothing is learnt. Other columns are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["t"]:
                base, added = find(t, shared.value) if t else ([], [])
                n = Counter(k for _, _, k in base)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], docs["text"].alias("t"))
    return map_frames(rows, mark, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, model: dict[Seen, float]) -> str:
    """The text with each found span replaced by its kind in brackets; of overlapping spans, the union is replaced once."""
    base, added = find(text, model)
    out, at, end = [], 0, -1
    for a, b, k in sorted(base + added, key=lambda s: (s[0], -s[1])):
        if a >= max(end, 0):
            out += [text[at:a], f"[{k.upper()}]"]
            at = end = b
        elif b > end:
            at = end = b
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents (all columns, all rows) with personal data replaced in ``text``; ``n_chars``, where there is one, is counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            was = batch["text"].tolist()
            now = [redact(t, shared.value) if t else t for t in was]
            batch = batch.assign(text=now)
            if "n_chars" in batch:
                batch["n_chars"] = [c if a == b else len(b) for c, a, b in zip(batch["n_chars"], was, now, strict=True)]
            yield batch

    return map_frames(docs, clean, docs.schema)


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    """The query: every whole document."""
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
