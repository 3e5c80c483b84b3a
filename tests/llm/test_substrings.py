"""Repeated passages against a plain count of all windows; the index against plain counts; odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.test_operators import ODD, clash, frame


def plain(texts, window):
    """(n_words, kept words, removed places) of every text."""
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), " ".join(x.decode() for i, x in enumerate(w) if i not in gone), gone))
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 5, 9, 35])
def test_index_marks_repeated_windows(window):
    from sparkloom.llm.fmindex import FmIndex

    r = random.Random(window)
    for _ in range(120):
        letters = r.choice([1, 2, 3, 10])
        texts = [[str(r.randrange(letters)).encode() for _ in range(r.randrange(1, 120))] for _ in range(r.randrange(1, 8))]
        texts.append([*texts[0][: len(texts[0]) // 2], b"x"] * r.choice([1, 2]))
        weights = [r.choice([1, 1, 1, 2]) for _ in texts]
        count = Counter()
        for t, n in zip(texts, weights, strict=True):
            for i in range(len(t) - window + 1):
                count[tuple(t[i : i + window])] += n
        want = [i + window <= len(t) and count[tuple(t[i : i + window])] > 1 for t in texts for i in range(len(t) + 1)]
        assert FmIndex(texts, weights).repeated(window).tolist() == want


def test_wavelet_ranks_and_size():
    from sparkloom.llm.fmindex import Wavelet

    rng = np.random.default_rng(1)
    counts = np.sort(rng.zipf(1.5, 300).clip(max=3000))[::-1]
    seq = rng.permutation(np.repeat(np.arange(300), counts))
    tree = Wavelet(seq, counts)
    symbols, at = rng.integers(0, 300, 500), rng.integers(0, len(seq) + 1, 500)
    assert tree.rank(symbols, at).tolist() == [int((seq[:i] == s).sum()) for s, i in zip(symbols, at, strict=True)]
    p = counts / len(seq)
    assert sum(len(x[1]) * 64 for x in tree.levels) <= len(seq) * (1 - (p * np.log2(p)).sum()) + 64 * tree.depth


def test_word_hashes_see_whole_words():
    from sparkloom.llm.substrings import pieces, word_hashes, word_places

    raw = " a b\ta\r\nabcdefgh abcdefghi abcdefgh\x0bé\xa0é é\xa0é x\x1cy ".encode() + b"z" * 100 + b" " + b"z" * 100 + b" " + b"z" * 99
    words = raw.split()
    at, n = word_places(raw)
    assert [raw[i : i + k] for i, k in zip(at, n, strict=True)] == words
    h = word_hashes(raw).tolist()
    assert {(a == b) == (x == y) for a, x in zip(words, h, strict=True) for b, y in zip(words, h, strict=True)} == {True}
    assert b"".join(pieces(raw)) == raw and word_hashes(b"").tolist() == []


def check(spark, texts, window=35, **options):
    from sparkloom.llm.substrings import remove_repeated

    rows = remove_repeated(clash(frame(spark, texts)), window, **options).collect()
    want = [(k, n, n - len(kept.split(" ")) if kept else n, kept) for (k, _), (n, kept, _) in zip(texts, plain([t for _, t in texts], window), strict=True)]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows) == Counter(want)
    for r in rows:
        assert sum(e - s for s, e in r["removed"]) == r["n_removed"] and all(a[1] < b[0] for a, b in zip(r["removed"], r["removed"][1:]))


@pytest.mark.parametrize("window", [1, 4, 35])
def test_passages_against_brute_force(spark, window):
    r = random.Random(window)
    say = lambda n: " ".join(f"w{int(r.paretovariate(0.4)) % 4000}" for _ in range(n))
    shared, line = [say(n) for n in (34, 35, 36, 60, 200)], say(12)
    texts = [(i, "  ".join([say(r.randrange(60)), r.choice(shared), say(r.randrange(50)), line, say(r.randrange(40))])) for i in range(120)]
    check(spark, [*ODD, *texts, (900, texts[0][1]), (901, say(3000)), (902, f"{shared[4]} and {shared[4]}")], window)


def test_passages_with_hot_marks_small_shards_and_pieces(spark, monkeypatch):
    """Marks beyond the bound are dealt by two marks; the sizes of pieces, shards and batches change no result."""
    from sparkloom.llm import substrings as S

    r = random.Random(5)
    say = lambda n: " ".join(f"v{r.randrange(3000)}" for _ in range(n))
    line, passage = say(14), say(50)
    texts = [(i, f"{say(30)} {line} {say(30)} {passage} {say(20)}") for i in range(40)] + [(50, say(2000)), (51, "x" * 5000 + " " + passage), (52, "again " * 60), (53, f"{say(40)} {'a b c ' * 30}")]
    monkeypatch.setattr(S, "HOT", 3)
    check(spark, texts)

    whole = list(S.text_segments([t for _, t in texts], 35, 8, 94))
    for name, value in (("PIECE", 2000), ("AT_ONCE", 150)):
        monkeypatch.setattr(S, name, value)
    for (n, a), (k, b), (_, t) in zip(whole, S.text_segments([t for _, t in texts], 35, 8, 94), texts, strict=True):
        assert n == k == len(t.split())
        marks = [{i: x["m"] for x in np.frombuffer(y, S.SEGMENT) for i in range(x["at"], x["at"] + x["w"])} for y in (a, b)]
        assert marks[0] == marks[1] and set(marks[0]) == set(range(max(0, n - 34)))

    rows = [(i % 3, i % 3, i, 0, 1, " ".join(["w"] * 35 if i % 2 else say(40).split()).encode()) for i in range(12)]
    whole = S.of_shard(rows, 35)
    assert sorted(whole["s"]) == [1, 3, 5, 7, 9, 11] and set(whole["hi"] - whole["lo"]) == {35}


def test_passages_of_no_rows(spark):
    from sparkloom.llm.substrings import remove_repeated

    assert remove_repeated(frame(spark, [])).collect() == []


def test_passage_query(spark):
    from sparkloom.llm.substrings import op13_repeated_passages

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {(k, n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for (k, _), (n, kept, gone) in zip(docs, plain([t for _, t in docs], 35), strict=True)}
    assert {tuple(r) for r in op13_repeated_passages(spark, DATA).collect()} == want
