"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct five-word shingles (64-bit hashes). Its signature has SYMBOLS MinHash values of
24 bits. Signatures within RADIUS differing symbols are guaranteed to be found: the symbols are split into
CHUNKS chunks, so by pigeonhole some chunk has at most RADIUS // CHUNKS errors, and every choice of so many
wrong symbols in a chunk is enumerated as a key of the remaining ones. At a similarity of 0.75 a pair exceeds RADIUS
with a probability below 1e-5. Links are confirmed on the full sets.

No group's pairs are listed. Equal sets are one class. In a first round, each class tries TRIES others: of its buckets' smallest
classes those that it shares most keys with; so a group of copies becomes one component after a few checks for each of
its members. Only in buckets that still hold different components are the members compared with each
other, in blocks of rows and by sketches alone: first to try a forest of the nearest pairs (fewer pairs than members), then, in
the buckets where a pair could still be a link, every pair of two components. A link between two members of one component can't
change the result, and no other is left out. A pair is looked at in the first bucket that it shares only. Pairs within RADIUS
also pass a second sketch (BINS one-permutation minima) that rules out those whose similarity is
``deviations`` standard errors below the limit, before full sets are compared; ``deviations=None`` leaves that filter out.

To confirm pairs, only the texts in question move: those of a pair's larger id once a pair, those of the smaller id once for
every SPOKES pairs, so a hub is dealt to many tasks. Every other move is of keys, ids or sketches of a fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import Stage, docs_only, map_frames
from sparkloom.llm.components import connected_components

WORDS = 5
SIMILARITY = 75  # per cent
SYMBOLS, CHUNKS, RADIUS = 48, 14, 26
#: Bins of the second sketch, and standard errors of its estimate that a pair may fall short by.
BINS, DEVIATIONS = 256, 4.5
#: Bits of the broadcast filter of ids: at most FILTER_BITS / 64 rows of 12 bytes.
FILTER_BITS = 1 << 22
#: Classes that a class is checked against in the first round.
TRIES = 1
#: Rows of a block in the comparison within a bucket, and pairs that a task holds before it hands them on.
BLOCK, HELD = 4096, 1 << 19
#: Pairs that the set of their smaller id is sent for.
SPOKES = 1024
_SEED = 0x5EED
SPACE = re.compile(r"[\x20\x09-\x0D]")

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes whose shingles are hashed at once; a word of more bytes than LONG counts as its digest.
SLICE, LONG = 1 << 18, 1 << 12
#: What precedes a digest that stands for a word.
DIGEST = b"\x00sha256:"


def _powers(by: int, n: int) -> np.ndarray:
    """by ** i mod 2**64 for i < n."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * (out[-1] * np.uint64(by))])
    return out[:n]


#: Powers for a slice of words with those it shares with the one before.
_SIZE = 2 * SLICE + 8 * LONG
with np.errstate(over="ignore"):
    POWERS, INVERSES = _powers(int(BASE), _SIZE), _powers(pow(int(BASE), -1, 1 << 64), _SIZE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_slices(text: str, words: int) -> Iterator[list[bytes]]:
    """The text's words about SLICE bytes at a time, each slice with the last ``words`` - 1 words before it."""
    before: list[bytes] = []
    lo = 0
    while lo < len(text):
        hi = lo + SLICE // 4  # up to four bytes a character
        if hi < len(text):
            space = SPACE.search(text, hi)
            hi = space.end() if space else len(text)
        parts = text[lo:hi].encode("utf-8", "surrogatepass").lower().split()
        if parts and hi - lo > LONG // 4 and max(map(len, parts)) > LONG:
            parts = [DIGEST + hashlib.sha256(p).hexdigest().encode() if len(p) > LONG else p for p in parts]
        parts = before + parts
        if len(parts) > len(before):
            yield parts
        before = parts[len(parts) - words + 1 :] if len(parts) >= words else parts
        lo = hi


def slice_hashes(parts: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words."""
    with np.errstate(over="ignore"):
        raw = np.frombuffer(b" ".join(parts), np.uint8)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS[: len(raw)], out=sums[1:])
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(raw)]))
        starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
        h = (sums[ends] - sums[starts]) * INVERSES[starts]
        return mix(h ^ mix((ends - starts).astype(np.uint64)))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words, of the whole sequence. Memory beside the hashes is a slice's."""
    held, more, size = np.zeros(0, np.uint64), [], 0
    parts: list[bytes] = []
    for parts in word_slices(text or "", words):
        if len(parts) >= words:
            more.append(np.unique(slice_hashes(parts, words)))
            size += len(more[-1])
            if size > max(len(held), SLICE):
                held, more, size = np.unique(np.concatenate([held, *more])), [], 0
    if not len(held) and not more:
        return slice_hashes(parts, len(parts)) if parts else held
    return more[0] if len(more) == 1 and not len(held) else np.unique(np.concatenate([held, *more]))


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    draw = rng.integers(0, 1 << 63, (2, k), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


MUL, ADD = _multipliers(SYMBOLS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS MinHash values of 24 bits."""
    low = np.empty(SYMBOLS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SYMBOLS):
            x = shingles * MUL[i] + ADD[i]
            low[i] = (x ^ (x >> np.uint64(32))).min()
        return (mix(low) & np.uint64(0xFFFFFF)).astype(np.uint32)


def pack(symbols: np.ndarray) -> bytes:
    """Three bytes a symbol."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(signatures: pd.Series) -> np.ndarray:
    """Packed signatures as rows of symbols."""
    out = np.zeros((len(signatures), SYMBOLS, 4), np.uint8)
    out[:, :, :3] = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, SYMBOLS, 3)
    return out.view("<u4")[:, :, 0]


def bin_minima(shingles: np.ndarray) -> np.ndarray:
    """A byte a bin: 0 if it is empty, else 1 to 255 from the bin's least hash. The hashes are sorted and their leading bits are the bin."""
    out = np.zeros(BINS, np.uint8)
    shift = np.uint64(64 - (BINS - 1).bit_length())
    bins = (shingles >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    with np.errstate(over="ignore"):
        out[bins[first]] = (mix(shingles[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def similar_enough(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, deviations: float | None = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two bin sketches: the estimated similarity, and whether it could be SIMILARITY or more (None: always)."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    j = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(used, 1)
    if deviations is None:
        return j, np.ones(len(j), bool)
    limit = SIMILARITY / 100
    union = (na + nb) / (1 + limit)
    # minima of bins are drawn without replacement from the union
    error = np.sqrt(limit * (1 - limit) / np.maximum(used, 1) * np.maximum(1 - used / np.maximum(union, used), 0.02))
    return j, j >= limit - deviations * error - 0.01


def chunk_keys(symbols: int = SYMBOLS, chunks: int = CHUNKS, radius: int = RADIUS) -> list[list[int]]:
    """The symbols of each key: for every chunk, every way to leave out the errors that pigeonhole allows it."""
    errors = radius // chunks
    return [[s for s in part.tolist() if s not in out] for part in np.array_split(np.arange(symbols), chunks) for out in combinations(part.tolist(), errors)]


KEYS = chunk_keys()
NO_BITS = (len(KEYS) - 1).bit_length()
#: The same as an array, short keys padded with their last symbol.
KEY_SYMBOLS = np.array([k + k[-1:] * (max(map(len, KEYS)) - len(k)) for k in KEYS])


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each signature (rows) and each entry of KEYS, whose number is in the key's lowest NO_BITS bits."""
    out = np.empty((len(signatures), len(KEYS)), np.uint64)
    with np.errstate(over="ignore"):
        for j, own in enumerate(KEYS):
            h = np.full(len(signatures), j + 1, np.uint64)
            for s in own:
                h = mix(h * np.uint64(0x100000001B3) + signatures[:, s])
            out[:, j] = (h & ~np.uint64((1 << NO_BITS) - 1)) | np.uint64(j)
    return out.view(np.int64)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["t"]:
            s = shingle_hashes(text)
            if len(s):
                with np.errstate(over="ignore"):
                    a, b = int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5)).sum().view(np.int64))
                rows.append((len(s), a, b, pack(signature(s)), bin_minima(s).tobytes()))
            else:
                rows.append((0, None, None, None, None))
        yield pd.DataFrame({"k": batch["k"].array, "n": [r[0] for r in rows], "s1": pd.array([r[1] for r in rows], "Int64"), "s2": pd.array([r[2] for r in rows], "Int64"), "signature": [r[3] for r in rows], "bins": [r[4] for r in rows]})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["id"].to_numpy()
        for lo in range(0, len(batch), 1024):
            got = bucket_keys(unpack(batch["signature"].iloc[lo : lo + 1024]))
            yield pd.DataFrame({"key": got.ravel(), "id": np.repeat(ids[lo : lo + 1024], len(KEYS))})


def _could_link(deviations: float | None):
    """Rows (a, b, sa, sb, ba, bb, na, nb) to the pairs (a, b) that their signatures and sketches don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            na, nb = rows["na"].to_numpy(), rows["nb"].to_numpy()
            bins = [np.frombuffer(b"".join(rows[c]), np.uint8).reshape(-1, BINS) for c in ("ba", "bb")]
            ok = 100 * np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb)
            ok &= (unpack(rows["sa"]) != unpack(rows["sb"])).sum(axis=1) <= RADIUS
            ok &= similar_enough(*bins, na, nb, deviations)[1]
            yield rows.loc[ok, ["a", "b"]]

    return run


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (b, part, a, t), sorted, those with a null a (the texts of b) first: the pairs (a, b) whose sets are similar enough."""
    hub, sets = None, []
    for batch in batches:
        found = []
        ids = batch["a"].astype(object).where(batch["a"].notna(), None)
        for b, part, a, t in zip(batch["b"], batch["part"], ids, batch["t"], strict=True):
            if hub != (b, part):
                hub, sets = (b, part), []
            s = shingle_hashes(t)
            if a is None:
                sets.append(s)
            elif len(s) and any(linked(s, x) for x in sets):
                found.append((int(a), b))
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes are similar enough."""
    if 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def forest(pairs: pd.DataFrame) -> list[int]:
    """Places of the pairs (ca, cb, d, a, b) that a minimum spanning forest of the components takes, nearest first."""
    order = pairs.sort_values(["d", "b", "a"]).index.to_numpy()
    nodes, flat = np.unique(np.concatenate((pairs["ca"].to_numpy(), pairs["cb"].to_numpy())), return_inverse=True)
    x, y = flat[: len(pairs)], flat[len(pairs) :]
    root = np.arange(len(nodes))
    taken: list[int] = []
    for lo in range(0, len(order), 1 << 15):
        part = order[lo : lo + (1 << 15)]
        part = part[root[x[part]] != root[y[part]]]
        for at in part.tolist():
            p, q = x[at], y[at]
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                taken.append(at)
        while (root[root] != root).any():
            root = root[root]
    return taken


def _compare_blocks(nearest: bool, deviations: float | None):
    """Rows (g, i, j, side, id, component, n, signature, bins), sorted by block pair, to pairs of two components that could be links.

    ``nearest``: only a forest of the nearest pairs over the components. A block pair without such a pair gives no row.
    """

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, comp, n, side, key = (rows[c].to_numpy() for c in ("id", "component", "n", "side", "g"))
        no = key & ((1 << NO_BITS) - 1)
        sig = unpack(rows["signature"])
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, BINS)
        edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(rows["i"].to_numpy()) != 0) | (np.diff(rows["j"].to_numpy()) != 0)) + 1
        end = np.repeat(np.concatenate((edge, [len(rows)])), np.diff(np.concatenate(([0], edge, [len(rows)]))))
        same = rows["i"].to_numpy() == rows["j"].to_numpy()
        held: list[pd.DataFrame] = []
        at, step = np.arange(len(rows)), 1
        while len(at):
            at = at[at + step < end[at]]
            to = at + step
            ok = (comp[at] != comp[to]) & (same[at] | (side[at] != side[to]))
            ok &= 100 * np.minimum(n[at], n[to]) >= SIMILARITY * np.maximum(n[at], n[to])
            every = np.flatnonzero(ok)
            for lo in range(0, len(every), 1 << 13):
                p = at[every[lo : lo + (1 << 13)]]
                q = p + step
                equal = sig[p] == sig[q]
                near = SYMBOLS - equal.sum(axis=1) <= RADIUS
                p, q, equal = p[near], q[near], equal[near]
                first = equal[:, KEY_SYMBOLS].all(axis=2).argmax(axis=1) == no[p]
                p, q = p[first], q[first]
                j, could = similar_enough(bins[p], bins[q], n[p], n[q], deviations)
                p, q, j = p[could], q[could], j[could]
                if len(p):
                    held.append(pd.DataFrame({"a": np.maximum(ids[p], ids[q]), "b": np.minimum(ids[p], ids[q]), "d": 1.0 - j, "ca": np.maximum(comp[p], comp[q]), "cb": np.minimum(comp[p], comp[q]), "g": key[p]}))
            if sum(map(len, held)) > HELD:
                got = pd.concat(held, ignore_index=True)
                if nearest:  # a forest of forests is a forest of all
                    held = [got.iloc[forest(got)]]
                else:
                    yield got
                    held = []
            step += 1
        if held:
            got = pd.concat(held, ignore_index=True)
            # the forest is one of all the block pairs held, so each bucket with a pair keeps one to be known by
            yield pd.concat([got.iloc[forest(got)], got.drop_duplicates("g")]).drop_duplicates() if nearest else got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            same = (batch[["g", "i", "j"]].to_numpy() == batch[["g", "i", "j"]].to_numpy()[-1]).all(axis=1)
            first = int(np.argmax(same))  # sorted, so the last block pair's rows are the batch's tail
            if first:
                yield from pairs(pd.concat([*held, batch.iloc[:first]], ignore_index=True))
                held = [batch.iloc[first:]]
            elif held and (held[-1][["g", "i", "j"]].to_numpy()[-1] != batch[["g", "i", "j"]].to_numpy()[0]).any():
                yield from pairs(pd.concat(held, ignore_index=True))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from pairs(pd.concat(held, ignore_index=True))

    return run


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among the (distinct) ids. A bitmap of hashed ids, of a fixed size, is broadcast first, so
    that few other rows reach the exchange of the join."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    word, mask = F.floor(bit / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))")
    words = ids.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("bits"))
    near = rows.withColumn("w", word).join(F.broadcast(words), "w").filter(F.col("bits").bitwiseAND(mask) != 0)
    return near.drop("w", "bits").join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", deviations: float | None = DEVIATIONS) -> DataFrame:
    """Per row: ``key``, n_shingles long, component_id (smallest key reachable), kept (key = component_id).

    Texts without words (null and empty ones too) have an empty set and are linked with nothing. Rows
    that share a key are one node. Rows with a null key belong to the component of their set's smallest
    key (null if there is none, and then they are kept: nothing can be compared with them). Repeated rows and equal sets are one class. Other columns
    are left behind; an empty table gives an empty result. ``deviations=None`` compares full sets of all pairs within RADIUS.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "neardup")
    rows = docs_only(docs, key, text).toDF("k", "t").withColumn("k", F.col("k").cast("long"))
    sketch = stage.keep(map_frames(rows, _sketch, "k long, n long, s1 long, s2 long, signature binary, bins binary"))
    found = sketch.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min_by(F.struct("k", "signature", "bins"), "k").alias("r"))
    found = stage.keep(found.select("s1", "s2", "n", F.col("r.k").alias("id"), "r.signature", "r.bins"))
    sets = stage.keep(sketch.select("k", "n", "s1", "s2"))
    stage.drop(sketch)
    nodes = found.filter("id is not null").select("id", "n", "signature", "bins")
    keys = map_frames(nodes.select("id", "signature"), _keys, "key long, id long")
    low = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "low")
    shared = stage.keep(keys.join(low, "key"))
    # only classes that share a bucket are looked at from here on
    live = stage.keep(among(nodes, shared.select("id").distinct()))
    classes = stage.keep(found.select("s1", "s2", "n", "id"))
    stage.drop(found)
    texts = rows.select(F.col("k").alias("id"), "t")
    links: list[DataFrame] = []

    def confirm(pairs: DataFrame) -> bool:
        """Adds the pairs (a, b) whose full sets are similar enough to the links; sets are made anew from the few texts in question."""
        pairs = stage.keep(pairs.select("a", "b").distinct())
        ids = stage.keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        own = among(texts, ids).groupBy("id", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t")).drop("h")
        own = stage.keep(own)
        hubs = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / SPOKES).cast("int"))
        spokes = pairs.join(hubs.select("b", "parts"), "b").select("b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), "a").join(own.withColumnRenamed("id", "a"), "a")
        hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("b", "part", F.lit(None).cast("long").alias("a"))
        both = hubs.join(own.withColumnRenamed("id", "b"), "b").select("b", "part", "a", "t").union(spokes.select("b", "part", "a", "t"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        both = both.repartition(parts, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        got = stage.keep(map_frames(both, _confirm, "a long, b long"))
        stage.drop(own, ids, pairs)
        links.append(got)
        return not got.isEmpty()

    # Round one: each class and, of its buckets' smallest classes, those that are smallest in most of them.
    counts = shared.filter("id > low").groupBy("id", "low").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("low").alias("b")))), 1, TRIES)  # at most a low a key
    tries = counts.groupBy("id").agg(best.alias("p")).select(F.col("id").alias("a"), F.explode("p").alias("p")).select("a", "p.b")
    side = lambda x: live.select(F.col("id").alias(x), *[F.col(c).alias(c[0] + x) for c in ("n", "signature", "bins")])
    confirm(map_frames(tries.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "ba", "bb", "na", "nb"), _could_link(deviations), "a long, b long"))

    # Rounds two and three: buckets that hold several components, block against block.
    comp = connected_components(links[0], stage)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for nearest in (True, False):
        held = shared.select("key", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = held.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("size")).filter("c0 < c1")
        mixed = stage.keep(held.join(mixed.select("key", "size"), "key"))
        # A bucket's rows are dealt to blocks; every pair of blocks is compared somewhere.
        n = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = mixed.join(live, "id").withColumn("n_blocks", n).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        dealt = dealt.select(F.col("key").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "component", "n", "signature", "bins")
        dealt = dealt.repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j")
        pairs = stage.keep(map_frames(dealt, _compare_blocks(nearest, deviations), "a long, b long, d double, ca long, cb long, g long"))
        stage.drop(mixed)
        if not nearest:
            stage.drop(shared, live)
        if pairs.isEmpty():
            break
        if nearest:
            # a bucket without a pair that could be a link has none later on either
            shared = shared.join(pairs.select(F.col("g").alias("key")).distinct(), "key", "left_semi")
            more = confirm(pairs.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b"))
        else:
            more = confirm(pairs)
        if more:
            comp = connected_components(_union(links), stage)
    # written, so that a class with very many copies can be split in the join
    of_class = stage.keep(classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component")))
    out = sets.filter("n > 0").join(of_class, ["s1", "s2", "n"])
    out = out.select("k", "n", "component").union(sets.filter("n = 0").select("k", "n", F.col("k").alias("component")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("k").eqNullSafe(F.col("component")).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents (all columns) less those whose component has a smaller doc_id."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def brute_force(texts: list[tuple[int, str | None]]) -> list[tuple[int, int, int, bool]]:
    """The query's rows by comparing all pairs of word-shingle sets; for tests."""
    sets = {}
    for k, t in texts:
        ws = t.encode().lower().split() if t else []
        n = min(WORDS, len(ws))
        sets[k] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
    root = {k: k for k in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= SIMILARITY * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((k, len(s), find(k), find(k) == k) for k, s in sets.items())


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The query: every whole document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
