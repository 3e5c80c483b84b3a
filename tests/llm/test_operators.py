"""The training-data operators on small fixtures: against brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import DATA

DOC = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
#: Columns whose names an operator uses itself.
CLASH = ("k", "t", "id", "h", "d", "n", "score", "shard", "component", "bucket", "hits", "_gone")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})



def frame(spark, texts, start=0):
    return spark.createDataFrame([(None if i is None else start + i, t, "en", "s", None if t is None else len(t)) for i, t in texts], DOC)


ODD = [(0, None), (1, ""), (2, "   \n "), (3, "word"), (4, "same text here now and then"), (5, "same text here now and then"), (None, "a text without an id"), (7, "long " * 30_000), (8, "é漢字🙂 İstanbul ΣΑΣ"), (9, "same text here now and then"), (9, "same text here now and then")]


@pytest.fixture(scope="module")
def odd(spark):
    return clash(frame(spark, ODD)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


# ---------------------------------------------------------------- toxicity


def test_toxicity_clauses():
    from sparkloom.llm.toxicity import INSULTS, Grammar

    g = Grammar(frozenset(INSULTS.split()))
    w = lambda t: sum(x for x, _ in g.clauses(t))
    assert w("you are an idiot") > w("idiot") > w('she said "idiot"') > 0
    assert w("idiot, you") == w("you idiot") > w("not an idiot") > 0
    assert w("a kind word") == 0 and w(None) == 0 and w("") == 0
    assert w("not so. idiot") == w("idiot")


def test_toxicity_odd_rows(spark, odd, empty):
    from sparkloom.llm.toxicity import fit, score_documents

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(odd, labels)
    assert score_documents(odd, model).count() == len(ODD)
    assert score_documents(empty, model).count() == 0


def test_toxicity_held_out(spark, docs):
    from sparkloom.llm.toxicity import op1_toxicity

    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    p = op1_toxicity(spark, big).join(labels, "doc_id").filter("held_out").toPandas()
    hit = p[p.predicted == 1]
    assert len(hit) and (hit.toxic == 1).mean() >= 0.9
    assert (p.predicted == p.toxic).mean() >= 0.9
    assert p.score.between(0, 1).all()


# ---------------------------------------------------------------- sharding


def check_shards(rows, shards=8, tolerance=0.002):
    total = sum(r["size"] for r in rows)
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * max(tolerance * total / shards, max(r["size"] for r in rows))


def test_shards_are_even_with_hot_groups(spark):
    from sparkloom.llm.histsort import shard_documents

    rng = random.Random(1)
    texts = [(i, "hot copy of a text " * 5 if i % 3 == 0 else "null" if i % 11 == 0 else "x" * rng.randrange(400)) for i in range(3000)]
    rows = shard_documents(frame(spark, texts), part_rows=100).collect()
    assert len(rows) == 3000
    check_shards(rows)
    sizes = {i: len(t.encode()) + 1 for i, t in texts}
    assert all(r["size"] == sizes[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    assert all(r["text_crc32"] == zlib.crc32(dict(texts)[r["doc_id"]].encode()) for r in rows[:50])


def test_shards_of_equal_rows_and_few_cells(spark, monkeypatch):
    """Equal texts are cut by doc_id; with few cells a round the splitters meet the same tolerance."""
    from sparkloom.llm import histsort as hs

    monkeypatch.setattr(hs, "ALL_CELLS", 64)
    rows = hs.shard_documents(frame(spark, [(i, "same text") for i in range(4000)])).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(rows) == 8 and all(abs(r["n"] - 500) <= 2 and r["m"] == r["n"] - 1 for r in rows)


def test_shards_odd_rows(spark, odd, empty):
    from sparkloom.llm.histsort import shard_documents

    rows = shard_documents(odd).collect()
    assert len(rows) == len(ODD)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shard_documents(empty).count() == 0


def test_shards_real(spark, docs):
    from sparkloom.llm.histsort import shard_documents

    check_shards(shard_documents(docs).collect())


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark, docs):
    from sparkloom.llm.ordermin import fingerprint_documents

    rows = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        nxt, t = texts[order[(i + 1) % len(order)]], texts[d]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    long = [d for d in order if len(texts[d]) > 300]
    assert np.mean([rows[d]["near_edited"] > rows[d]["near_next"] for d in long]) > 0.9


def test_fingerprints_see_order(spark):
    from sparkloom.llm.ordermin import fingerprint, likeness

    a = " ".join(f"w{i}" for i in range(400))
    moved = " ".join([*(f"w{i}" for i in range(200, 400)), *(f"w{i}" for i in range(200))])
    near = a.replace("w7 ", "v7 ")
    r = spark.createDataFrame([(a, moved, near)], "a string, m string, n string").select(*[fingerprint(F.col(c)).alias(c) for c in "amn"]).select(likeness(F.col("a"), F.col("m")).alias("m"), likeness(F.col("a"), F.col("n")).alias("n"), likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert r["same"] == 1 and r["n"] > 0.9 > r["m"]


def test_fingerprints_of_short_texts_see_order(spark):
    """Swapped halves: every entry selects from the whole text, so short texts are no more alike than long ones."""
    from sparkloom.llm.ordermin import fingerprint, likeness

    rng = random.Random(5)
    rows = []
    for n in (20, 40, 80, 160):
        for _ in range(20):
            w = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    pairs = spark.createDataFrame(rows, "n int, a string, b string").select("n", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("x"))
    got = {r["n"]: r["x"] for r in pairs.groupBy("n").agg(F.avg("x").alias("x")).collect()}
    assert sorted(got) == [20, 40, 80, 160] and all(0.3 < x < 0.55 for x in got.values()), got


def test_fingerprints_of_unbroken_texts_survive_an_insertion(spark):
    """One code point more, anywhere, in a text without blanks; and other text in its place is still other text."""
    from sparkloom.llm.ordermin import fingerprint, likeness

    rng = random.Random(8)
    han, ascii_ = [chr(0x4E00 + i) for i in range(3000)], list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/")
    rows = []
    for letters in (han, ascii_, [chr(0x20000 + i) for i in range(3000)]):
        for n in (400, 2000):
            t, other = ("".join(rng.choices(letters, k=n)) for _ in range(2))
            rows += [(t, t[:at] + letters[7] + t[at:], other) for at in (0, 1, n // 2, n - 20, n)]
    got = spark.createDataFrame(rows, "a string, b string, c string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("b"), likeness(fingerprint(F.col("a")), fingerprint(F.col("c"))).alias("c")).collect()
    assert all(r["b"] > 0.75 and r["c"] < 0.1 for r in got), got


def test_fingerprints_do_not_depend_on_rounds_worked_out(spark):
    from sparkloom.llm.ordermin import fingerprint

    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(90)], k=n)) for n in (1, 2, 3, 4, 9, 30, 200, 700)]
    texts.append("same " * 700)
    of = lambda dealt, entries, kept=10**6: fingerprint(F.col("t"), entries=entries, dealt=dealt, kept=kept)
    for entries in (64, 48, 16):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(of(1, entries).alias("a"), of(448, entries).alias("b"), of(10**9, entries).alias("c"), of(448, entries, 20).alias("d")).collect()
        assert all(r["a"] == r["b"] == r["c"] == r["d"] and None not in r["a"] and len(r["a"]) == entries for r in rows)


def test_fingerprints_small_buckets_and_odd_rows(spark, odd, empty):
    from sparkloom.llm.ordermin import fingerprint_documents, with_next

    ids = frame(spark, [(i * i, f"text {i}") for i in range(40)])
    nxt = {r["doc_id"]: r["next_text"] for r in with_next(ids, bucket_rows=3).collect()}
    assert nxt == {i * i: f"text {(i - 1) % 40}" for i in range(40)}
    rows = fingerprint_documents(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        if r["doc_id"] in (4, 5, 9):
            by.setdefault(r["fingerprint"], []).append(r["doc_id"])
    assert len(by) == 1
    assert fingerprint_documents(empty).count() == 0


# ---------------------------------------------------------------- personal data


def plain_spans(text):
    """The base spans by the patterns as they are stated."""
    import re

    from sparkloom.llm.pii import BASE, luhn

    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2]), s[1]))


def test_base_spans_equal_the_patterns(docs):
    from sparkloom.llm.pii import base_spans

    rng = random.Random(3)
    made = ["".join(rng.choice("a1.@+- (9%_b\n5") for _ in range(200)) for _ in range(400)]
    cards = ["4111 1111 1111 1111", "x4111-1111-1111-1111.1.2.3.4", "256.1.1.1 1.2.3.4.5.6.7.8", "a@b.c@d.e f@g a..@x-.y", "+1 (555) 555-0100 +", "9" * 3000, "a@" * 500 + "b.c"]
    for t in [*made, *cards, *(r["text"] for r in docs.collect())]:
        assert base_spans(t) == plain_spans(t)


def test_pii_finds_planted_and_leaves_clean(spark, odd, empty):
    from sparkloom.llm.pii import find_spans, redact_documents

    secret = "4efe2d42c16b845d5c2e16d71d7cc67296c995e8"
    texts = [(i, f'some words and token = "{secret[: 39 - i % 3]}{i % 10}" after') for i in range(40)] + [(100 + i, "mail me at a.b@mail.example.com or +1 (555) 555-0100") for i in range(5)] + [(200, "a clean text of 12 words in 2024, with 3.5 of 10")]
    rows = {r["doc_id"]: r for r in find_spans(frame(spark, texts)).collect()}
    assert rows[200]["spans"] == "" and rows[100]["n_email"] == 1 and rows[100]["n_phone"] == 1
    assert rows[100]["spans"].startswith("email:11:31,phone:")
    assert sum("secret:" in r["spans"] for r in rows.values()) >= 36
    clean = {r["doc_id"]: r["text"] for r in redact_documents(frame(spark, texts)).collect()}
    assert clean[200] == dict(texts)[200] and clean[100] == "mail me at [EMAIL] or [PHONE]"
    assert find_spans(odd).count() == len(ODD) and find_spans(empty).count() == 0
    assert redact_documents(odd).columns == odd.columns and redact_documents(odd).count() == len(ODD)


def test_long_secrets_are_candidates(spark):
    """A token of any length is voted on, and is taken out whole."""
    from sparkloom.llm.pii import candidates, find_spans, redact_documents

    rng = random.Random(4)
    token = lambda n: "a1" + "".join(rng.choices("abcdefghijABCDEFGHIJ0123456789_-", k=n - 2))
    texts = [(i, f'api key "{token(n)}" end') for i, n in enumerate([40] * 30 + [31, 32, 128, 129, 2000, 300_000])]
    for i, t in texts:
        span = (9, len(t) - 5, "secret")
        assert [c for c in candidates(t) if c[2] == "secret"] == ([span] if i != 30 else [])
    rows = {r["doc_id"]: r["spans"] for r in find_spans(frame(spark, texts)).collect()}
    clean = {r["doc_id"]: r["text"] for r in redact_documents(frame(spark, texts)).collect()}
    for i, t in texts:
        if i != 30:
            assert f"secret:9:{len(t) - 5}" in rows[i] and clean[i] == 'api key "[SECRET]" end'


def test_many_spans_in_one_text():
    """A long text of numbers is done in seconds, and added spans overlap nothing taken before them."""
    import time

    from sparkloom.llm.pii import KINDS, candidates, find, seen

    text = " ; ".join(f"415 555 {i:04d} a{'0f' * 20}{i:05d} +1415555{i:04d}" for i in range(8000))
    model = {seen(text, a, b, k): 0.9 for a, b, k in candidates(text)}
    began = time.process_time()
    base, added = find(text, model)
    assert time.process_time() - began < 60 and len(base) >= 8000 and len(added) >= 8000
    spans = sorted((a, b) for a, b, _ in added)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and {k for *_, k in added} <= set(KINDS)


def test_rare_kinds_do_not_change_with_size():
    """A kind of fixed count keeps its probabilities while the others grow."""
    from sparkloom.llm.pii import span_features, train_classifier

    rare = {("account", (1, -1, 0, 0, 0, 1)): 20, ("account", (1, 1, 0, 1, 0, 1)): 30, ("account", (1, -1, 0, 0, -1, -1)): 25}
    for n in (10**3, 10**5, 10**7, 10**9):
        others = {("email", (1, 1, 1, 1, 0, 1)): 6 * n, ("email", (-1, -1, 0, 0, -1, -1)): 3 * n, ("ip", (1, 1, 1, 0, 0, 1)): 2 * n, ("ip", (-1, -1, -1, 0, 0, 1)): 4 * n}
        beta = train_classifier(rare | others)
        p = [1 / (1 + np.exp(-(np.dot(span_features(k, v), beta[:-1]) + beta[-1]))) for k, v in rare]
        assert p[0] > 0.95 and p[1] > 0.95 and p[2] < 0.05, (n, p)


# ---------------------------------------------------------------- language


def test_language_held_out(spark, docs):
    from sparkloom.llm.langid import identify

    p = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (p.lang == p.lang_pred).mean() >= 0.95 and p.score.between(0, 1).all()


def test_language_mixtures(spark, docs):
    from sparkloom.llm.langid import predict_texts, train

    langs, table = train(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("n_chars > 1500").collect()}
    two = by["en"][:1500] + "\n" + by["de"][:1400]
    one, both, none = predict_texts([by["fr"], two, "12 !?"], langs, table)
    assert one[0] == "fr" and one[2] == 1
    assert both[2] == 2 and min(dict(zip(langs, both[3]))[x] for x in ("en", "de")) > 0.3
    assert none[0] == "und"


def test_language_odd_rows(spark, odd, empty):
    from sparkloom.llm.langid import identify, keep_identified

    rows = {r["doc_id"]: r for r in identify(odd).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    assert identify(empty).count() == 0 and keep_identified(empty).count() == 0
    assert keep_identified(odd).columns == odd.columns


def test_numerals_are_no_letters():
    from sparkloom.llm.langid import has_letter

    assert not any(map(has_letter, ["½", "² ①", "12 Ⅷ!", " "])) and all(map(has_letter, ["½a", "é", "漢", "ª"]))


def test_language_stage_drops_only_unknown(spark, docs):
    """The exact rows that go: null and letterless texts, and none of several languages; nothing where nothing is learnt."""
    import corpus_pipeline as P
    from sparkloom.llm.langid import keep_identified, predict_texts, train

    long = docs.filter("n_chars > 1500 and lang is not null").select("lang", "text").collect()
    by = {r["lang"]: r["text"][:1500] for r in long}
    mixed = "\n".join(by[x] for x in sorted(by)[:3])
    texts = [(10**6, mixed), (10**6 + 5, None), (10**6 + 6, "12 !?"), (10**6 + 7, "")]
    # the mixed rows carry no label, so they aren't learnt from
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(frame(spark, texts).withColumn("lang", F.lit(None).cast("string")))
    assert predict_texts([mixed], *train(every))[0][1] < 0.5
    kept = {r["doc_id"] for r in P.language_id(spark, every, DATA).collect()}
    lettered = {r["doc_id"] for r in every.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert kept == lettered and 10**6 in kept
    unlabelled = frame(spark, [(i, f"text {i}") for i in range(9)] + texts).withColumn("lang", F.lit(None).cast("string"))
    assert keep_identified(unlabelled).count() == 13


# ---------------------------------------------------------------- decontamination


def test_decontamination_against_brute_force(spark, docs):
    from sparkloom.llm.decontaminate import brute_force, contamination, remove_contaminated

    items = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one two"), (901, "two"), (902, None), (903, "..."), (None, "Three"), (901, "two")], "item_id long, text string"))
    held = [tuple(r) for r in items.collect()]
    # planted passages and the items' own texts
    texts = [(i, f"lead words {t} tail words" if t else t) for i, (_, t) in enumerate(held[:25])] + [(100, "One, TWO! three"), (101, None), (102, ""), (103, "two two"), (104, held[0][1][:60])]
    got = sorted(tuple(r)[:6] for r in contamination(clash(frame(spark, texts)), items).collect())
    assert got == sorted([(*x[:3], *_items(x, texts, held)) for x in brute_force(texts, held)])
    kept = {r["doc_id"] for r in remove_contaminated(frame(spark, texts), items).collect()}
    assert kept == {x[0] for x in got if not x[5]}


def _items(row, texts, held):
    """Items with a null id mark hits but aren't listed."""
    from sparkloom.llm.decontaminate import brute_force

    only = brute_force([(row[0], dict(texts)[row[0]])], [(i, t) for i, t in held if i is not None])[0]
    return only[3], only[4], row[5]


def test_decontamination_longest_match_and_repeated_items(spark, monkeypatch):
    """Items that share a window: the longest match is that of the item that goes on as the text does. Several blocks change nothing."""
    from sparkloom.llm import decontaminate as dc

    head = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(1, f"{head} a b c d"), (2, f"{head} x y"), (3, f"{head} x y"), (4, "solo"), (None, head), (5, None), (6, " ")], "item_id long, text string")
    docs = frame(spark, [(1, f"q {head} x y"), (2, f"{head} a b z"), (3, "no solo here"), (4, head[:-3]), (5, None)])
    for size in (32 << 20, 40):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        got = {r["doc_id"]: (r["longest"], r["items"], r["hits"]) for r in dc.find_matches(docs, items).collect()}
        assert got == {1: (12, ["1", "2", "3"], [[1, 13]]), 2: (12, ["1", "2", "3"], [[0, 12]]), 3: (1, ["4"], [[1, 2]]), 4: (0, [], []), 5: (0, [], [])}


def test_decontamination_of_long_items(spark):
    """Memory in proportion to the items' words; brute force beside items longer than documents."""
    import tracemalloc

    from sparkloom.llm.decontaminate import Block, brute_force, find_matches

    r = random.Random(11)
    say = lambda n: " ".join(f"w{int(r.paretovariate(0.5)) % 5000}" for _ in range(n))
    long, other = say(100_000), say(4_000)
    tracemalloc.start()
    Block([([1], long)])
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    words = long.split()
    texts = [(1, " ".join(words[500:530])), (2, "x " + " ".join(words[99_980:])), (3, say(300)), (4, " ".join(words[7:16])), (5, f"{other} {' '.join(words[:12])}")]
    small = " ".join(words[400:1600]), " ".join([*words[:200], *words[99_800:]])
    items = [(7, small[0]), (8, small[1]), (9, other), (9, "w1 w1 w2")]
    rows = find_matches(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {x[0]: x for x in brute_force(texts, items)}
    for x in rows:
        assert (x["n_words"], sum(e - s for s, e in x["hits"]), len(x["items"])) == want[x["doc_id"]][1:4]
    assert {x["doc_id"]: x["longest"] for x in rows} == {1: 30, 2: 20, 3: 3, 4: 0, 5: 4000}


def test_decontamination_empty(spark, empty, odd):
    from sparkloom.llm.decontaminate import contamination

    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd, none).filter("contaminated").count() == 0
    assert contamination(empty, none).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_near_duplicates_against_brute_force(spark):
    from sparkloom.llm.neardup import brute_force, near_duplicates

    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choices(words, k=60))
    texts, base = [], [rng.choices(words, k=rng.randrange(20, 120)) for _ in range(25)]
    for i in range(260):
        b = list(base[i % 5 if i % 2 else i % 25])
        for _ in range(rng.randrange(0, 5)):
            b[rng.randrange(len(b))] = rng.choice(words)
        texts.append((i, " ".join(b) if i % 7 else passage + " " + " ".join(rng.choices(words, k=25))))
    texts += [(400, None), (401, ""), (402, "one two"), (403, "ONE  two"), (404, "one two three"), (405, texts[3][1]), (406, texts[3][1].upper())]
    got = sorted(tuple(r) for r in near_duplicates(clash(frame(spark, texts))).collect())
    assert got == brute_force(texts)


@pytest.mark.parametrize("deviations", [4.5, None])
def test_near_duplicates_in_many_blocks(spark, monkeypatch, deviations):
    """Buckets of several blocks, hubs of several parts and bounded hand-overs give the brute-force components."""
    from sparkloom.llm import neardup as nd

    for name, value in (("BLOCK", 3), ("SPOKES", 2), ("HELD", 4)):
        monkeypatch.setattr(nd, name, value)
    rng = np.random.default_rng(3)
    texts = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(12):
            words = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 6)):
                words[at] = f"x{rng.integers(0, 1000)}"
            texts.append((len(texts), " ".join(words)))
    got = sorted(tuple(r) for r in nd.near_duplicates(frame(spark, texts), deviations=deviations).collect())
    assert got == nd.brute_force(texts) and len({g[2] for g in got}) < len(texts) - 10


def test_shingles_of_long_texts_come_in_slices(monkeypatch):
    """Slices change no hash; a long text takes little beside its own bytes and its hashes."""
    import tracemalloc

    from sparkloom.llm import neardup as N

    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(3000)}é" for _ in range(n))
    texts = [say(n).replace(" ", r.choice([" ", "\n", " \t\x0b"])) for n in (1, 4, 5, 6, 200, 3000)] + ["x" * 9000 + " b c d e f " + "y" * 20_000]
    whole = [N.shingle_hashes(t) for t in texts]
    for text, h in zip(texts, whole, strict=True):
        words = text.encode().split()
        assert len(h) == (len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) if len(words) >= 5 else 1)
    long = (say(20_000) + " ") * 60
    tracemalloc.start()
    assert len(N.shingle_hashes(long)) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    monkeypatch.setattr(N, "SLICE", 400)
    assert all((N.shingle_hashes(t) == h).all() for t, h in zip(texts, whole, strict=True))


def test_near_duplicates_odd_rows(spark, odd, empty):
    from sparkloom.llm.neardup import keep_one_of_each, near_duplicates

    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5, 9)} == {4}
    assert near_duplicates(empty).count() == 0
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, None, 7, 8]))


def test_every_pair_within_the_radius_shares_a_key():
    from sparkloom.llm.neardup import CHUNKS, RADIUS, SYMBOLS, bucket_keys

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (400, SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for r in range(len(b)):  # errors spread over the chunks as evenly as can be: the worst case
        order = np.concatenate(list(zip(*[rng.permutation(x)[:3] for x in np.array_split(np.arange(SYMBOLS), CHUNKS)])))
        b[r, order[:RADIUS]] ^= 1
    assert (bucket_keys(a) == bucket_keys(b)).any(axis=1).all()


def test_components(spark):
    from sparkloom.llm._common import Stage
    from sparkloom.llm.components import connected_components

    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "t")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


# ---------------------------------------------------------------- token files


def test_token_files(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    from sparkloom.llm.bitplanes import default_vocabulary, read_token_files, write_token_files

    extra = frame(spark, [(1, "a  b \n c"), (2, "x<|endoftext|>y"), (3, " lead"), (4, "tail "), (5, "don't stop, now… 1 2")], 10_000)
    every = docs.unionByName(extra)
    rows = read_token_files(spark, write_token_files(every, f"file://{tmp_path}/a")).collect()
    library, at = Tokenizer.from_file(default_vocabulary()), 0
    got = {r["doc_id"]: r for r in rows}
    for r in sorted(every.collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert read_token_files(spark, write_token_files(odd, f"file://{tmp_path}/b")).count() == len(ODD)
    assert read_token_files(spark, write_token_files(empty, f"file://{tmp_path}/c")).count() == 0


def test_pieces_equal_the_librarys():
    """Every plain code point, after a letter, a digit and white space, and before them."""
    from sparkloom.llm.bitplanes import ByteBpe, default_vocabulary

    bpe = ByteBpe(default_vocabulary(), cache=100_000)
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bpe.odd(chr(c))]
    assert len(plain) > 30_000
    for lo in range(0, len(plain), 50):
        text = "".join(f"a{c}b 1{c}2 {c}{c}\n{c} " for c in plain[lo : lo + 50])
        assert bpe.encode(text) == bpe.whole(text)
    for text in ("x½", "\x1c a", " ", "", "<|endoftext|>", "w" * 70 + " " + "w" * 70, "don't  \n\n they'll '"):
        assert bpe.encode(text) == bpe.whole(text)
    assert len(bpe.kept) + len(bpe.kept.older) < 1000


def test_rows_of_one_id_may_lie_in_several_files(spark, tmp_path):
    from sparkloom.llm.bitplanes import read_token_files, write_token_files

    rows = frame(spark, [(7, f"text {i}") for i in range(40)] + [(7, "text 1"), (8, None), (None, "n")])
    files = write_token_files(rows, f"file://{tmp_path}/x", parts=5)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in read_token_files(spark, files).collect())
    assert len(files) > 1 and [g[2] for g in got] == [None, *[7] * 41, 8]
    assert [g[0] for g in got] == [sum(g[1] for g in got[:i]) for i in range(len(got))]


def test_bit_planes_round_trip(tmp_path):
    from sparkloom.llm.bitplanes import Reader, Writer, from_planes, to_planes

    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert (from_planes(to_planes(ids), n) == ids).all()
    w = Writer(f"file://{tmp_path}/x.slb", block=64)
    held = [(i if i % 5 else None, rng.integers(0, 50_257, rng.integers(0, 300)).astype("<u4")) for i in range(50)]
    for i, ids in held:
        w.add(i, ids.tobytes())
    w.close()
    r = Reader(f"file://{tmp_path}/x.slb")
    assert [(i, a.tolist()) for i, a in r.documents()] == [(i, a.tolist()) for i, a in held]
    assert (r.block(1) == np.concatenate([a for _, a in held])[64:128]).all()


# ---------------------------------------------------------------- WARC


def test_warc(spark, tmp_path):
    from sparkloom.llm.warc import read_chunks, read_records, write_archives

    big, mid = "<p>é</p>" * 2000, "y" * 1000
    pages = [(1, "u1", big), (2, "u2", "small"), (3, "u3", big), (4, "u4\r\nX: y", mid), (9, None, mid), (5, "u5", None), (6, "u6", "small"), (7, "u7", "WARC/1.1\r\n\r\n" * 300), (-8, "u8", mid), (None, "u9", "z" * 1500), (10, "u10", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"size": F.lit(1), "digest": F.lit("x"), "first": F.lit(0)})
    files = write_archives(df, f"file://{tmp_path}/w", parts=3, chunk=700)
    got = {r["page_id"]: tuple(r)[1:] for r in read_records(spark, files, chunk=900).collect()}
    largest = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    for i, _, h in pages:
        raw = (h or "").encode()
        to = largest.get(h) if h in largest and largest[h] != i else None
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to)
    chunks = read_chunks(spark, files, chunk=900).filter("page_id = 3").orderBy("chunk_no").collect()
    assert b"".join(bytes(c["bytes"]) for c in chunks) == big.encode() and max(len(c["bytes"]) for c in chunks) <= 900
    assert chunks[-1]["digest_so_far"] == hashlib.sha1(big.encode()).hexdigest()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_records(spark, write_archives(none, f"file://{tmp_path}/e")).count() == 0


def test_warc_repeated_rows(spark, tmp_path):
    """Of equal rows one is the response; every record has an id of its own."""
    from sparkloom.llm.warc import read_records, records_in, write_archives

    big = "y" * 3000
    pages = [(1, "a", big), (1, "a", big), (0, "b", big), (1, "a", "z" * 2000), (2, "c", "small"), (2, "c", "small"), (None, "n", "w" * 1200), (None, "n", "w" * 1200)]
    files = write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/r", parts=3, chunk=700)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read_records(spark, files).collect())
    assert got == sorted(
        [("1", 3000, "response", None), ("1", 3000, "revisit", 1), ("0", 3000, "revisit", 1), ("1", 2000, "response", None)]
        + [("2", 5, "response", None)] * 2 + [("None", 1200, "response", None)] * 2,
        key=lambda r: (r[0], r[1], r[2]),
    )
    heads = {head["warc-record-id"] for f in files for head, *_ in records_in(f)}
    assert len(heads) == len(pages)


# ---------------------------------------------------------------- BPE


def test_bpe_equals_the_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    from sparkloom.llm.bpe import WordBpe, default_vocabulary, digest_documents, encode_documents

    library, own = Tokenizer.from_file(default_vocabulary()), WordBpe(default_vocabulary(), cache=50_000)
    odd_texts = ["", "  ", "İstanbul ΣΑΣ é  x y don't 's'S'T 123½ ²", "a\x1cb \x85c", "<|startoftext|>Hi<|endoftext|> <|endoftext|>", "漢字かな🙂👨‍👩‍👧 ﬁ ß ẞ", "</w> a</w>", "̀abc ​z", "a'll've'", "K Å Ω ǅ J̌a", "x" * 500, "ab" * 3000, "thequickbrownfox" * 40, "é" * 700]
    for t in odd_texts + [r["text"] for r in docs.limit(60).collect()]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert (got, own.decode(got)) == (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))
    rows = {r["doc_id"]: r for r in digest_documents(odd).collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0 and rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digest_documents(odd).count() == len(ODD) and encode_documents(empty).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark):
    """Each stage's decisions, worked out from the stage before by plain code."""
    import corpus_pipeline as P
    from sparkloom.llm.decontaminate import brute_force as hits
    from sparkloom.llm.neardup import brute_force as groups

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["language ID", "near-dedup", "decontamination", "PII", "BPE"]
    held, frames = docs, [docs]
    for _, step in P.STAGES:
        held = step(spark, held, DATA).cache()
        frames.append(held)
    texts = [{r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for f in frames[:5]]
    assert all(f.columns == docs.columns for f in frames[:5])
    assert len(texts[1]) >= 0.95 * len(texts[0])
    assert set(texts[2]) == {k for k, _, _, kept in groups(list(texts[1].items())) if kept}
    small = dict(list(texts[2].items())[:60])
    assert {k for k in small if k in texts[3]} == {x[0] for x in hits(list(small.items()), items) if not x[5]}
    assert set(texts[4]) == set(texts[3])
    assert {r["doc_id"] for r in frames[5].collect()} == set(texts[4])
    assert {tuple(r) for r in P.run(spark, DATA).collect()} == {tuple(r) for r in frames[5].collect()}
