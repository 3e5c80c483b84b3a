"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

The sort key is (62-bit hash of the text, doc_id), so copies of a text lie side by side. The splitters' places in
the order of bytes are fixed (equal shares); their keys are not known. In each round the range in which a splitter must lie is cut
at equally spaced probes, and one map-side combined aggregate counts the exact bytes and rows in every cell; the cell
that holds the splitter's place is the next range. Ranges of hashes come first; a range of one hash (a hot text) is cut by doc_id.
It ends when every splitter is within the tolerance or its range holds one key.

A narrow (doc_id, hash, size) table is written once; the rounds read it. Beside the shards' splitters, more splitters cut
shards into parts of about PART_ROWS rows (by bytes and rows together), so that the ranking
within shards, which the slots come from, is done in many tasks, whatever text is hot. The probes, cells and splitters that reach
the driver depend on the number of parts, not on the rows. DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import Stage

SHARDS = 8
#: Of a shard's equal share of the bytes: how far a splitter may be from its place.
TOLERANCE = 0.002
#: Cells a range is cut into in each round, and cells of all ranges at most: they reach the driver. Many ranges take more rounds.
CELLS, ALL_CELLS = 1024, 1 << 17
PART_ROWS = 500_000
LEAST_PARTS = 64
HASH_BITS = 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


class Range:
    """Keys lo..hi (inclusive) of one field: of hashes, or of doc_ids within one hash; with what lies before them."""

    def __init__(self, hash_: int | None, lo: int, hi: int, before: float):
        self.hash, self.lo, self.hi, self.before = hash_, lo, hi, before

    def step(self, cells: int) -> int:
        return -(-(self.hi - self.lo + 1) // cells)

    def first(self) -> tuple[int, int]:
        return (self.lo, LEAST) if self.hash is None else (self.hash, self.lo)

    def last(self) -> tuple[int, int]:
        return (self.hi, MOST) if self.hash is None else (self.hash, self.hi)


def find_splitters(keys: DataFrame, places: dict[int, tuple[float, float]], weight: Column) -> dict[int, tuple[int, int]]:
    """For each splitter its key (hash, doc_id): rows with smaller keys weigh its place, to within its tolerance.

    ``places``: splitter -> (weight before it, tolerance). ``weight``: of a row.
    """
    ends = keys.agg(F.min("h"), F.max("h")).first()
    done: dict[int, tuple[int, int]] = {}
    open_ = {s: Range(None, ends[0], ends[1], 0.0) for s in places} if places and ends[0] is not None else {}
    while open_:
        # Ranges are disjoint: those of one round are cells of the last round's, or doc_id ranges within a single hash.
        ranges = sorted({(r.first(), r.last()): r for r in open_.values()}.items(), key=lambda x: x[0])
        own = [r for _, r in ranges]
        cut = max(4, min(CELLS, ALL_CELLS // len(own)))
        put = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        placed = keys.withColumn("n", part_of([k[0] for k, _ in ranges]) - 1).filter("n >= 0")
        inside = placed.filter(F.struct("h", "d") <= F.struct(F.get(put(k[1][0] for k, _ in ranges), "n").alias("h"), F.get(put(k[1][1] for k, _ in ranges), "n").alias("d")))
        field = F.when(F.get(F.array(*[F.lit(r.hash is None) for r in own]), "n"), F.col("h")).otherwise(F.col("d"))
        at = field.cast("decimal(20,0)") - F.get(put(r.lo for r in own), "n")
        step = F.get(put(r.step(cut) for r in own), "n")
        cells = inside.groupBy("n", F.floor(at / step).cast("int").alias("cell")).agg(F.sum(weight).alias("w"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1")).collect()
        by_range: dict[int, list] = {}
        for c in sorted(cells, key=lambda c: (c["n"], c["cell"])):
            by_range.setdefault(c["n"], []).append(c)
        number = {key: n for n, (key, _) in enumerate(ranges)}
        for s, r in list(open_.items()):
            own, before = by_range[number[r.first(), r.last()]], r.before
            place, slack = places[s]
            for c in own:
                after = before + c["w"]
                first = (c["h0"], c["d0"] if r.hash is not None else LEAST)
                if abs(before - place) <= slack or before >= place:
                    done[s] = first
                elif after < place - slack:
                    before = after
                    continue
                elif c["h0"] < c["h1"]:
                    open_[s] = Range(None, c["h0"], c["h1"], before)
                    break
                elif c["d0"] < c["d1"]:
                    open_[s] = Range(c["h0"], c["d0"], c["d1"], before)
                    break
                elif place - before <= after - place:  # one key: the nearer of its two ends
                    done[s] = (c["h0"], c["d0"])
                else:
                    done[s] = _after(c["h0"], c["d0"])
                del open_[s]
                break
            else:  # the place is at the range's end
                c = own[-1]
                done[s] = _after(c["h1"], c["d1"] if c["h0"] == c["h1"] else MOST)
                del open_[s]
    return done


def _after(h: int, d: int) -> tuple[int, int]:
    return (h, d + 1) if d < MOST else (h + 1, LEAST)


def part_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are <= (h, d). The rows' leading hash bits pick a short list of splitters; the rest are counted."""
    if not splitters:
        return F.lit(0)
    bits = max(1, min(12, len(splitters).bit_length()))
    shift = HASH_BITS - bits
    groups: list[list[tuple[int, int]]] = [[] for _ in range(1 << bits)]
    for h, d in splitters:
        groups[min(h >> shift, len(groups) - 1)].append((h, d))
    firsts, total = [], 0
    for g in groups:
        firsts.append(total)
        total += len(g)
    key = F.struct(F.col("h"), F.col("d"))
    kind = "array<array<struct<h:bigint,d:bigint>>>"
    lists = F.from_json(F.lit("[" + ",".join("[" + ",".join(f'{{"h":{h},"d":{d}}}' for h, d in g) + "]" for g in groups) + "]"), kind)
    slot = F.shiftright("h", shift).cast("int")
    return (F.get(F.array(*[F.lit(x) for x in firsts]), slot) + F.size(F.filter(F.get(lists, slot), lambda x: x <= key))).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard; law ``bytes``: the shards' sizes are near equal.

    Size is the UTF-8 bytes of the text plus 1 (null: 1). A splitter is within ``tolerance`` of a shard's share, or else one row away
    from its place. Copies of a text share a shard unless a splitter has to cut them. Slots follow
    the sort order, from 0 without gaps in each shard. Null texts sort as empty ones, null ids as the
    least id; repeated rows take neighbouring slots in any order; an empty table gives an empty result. Other columns
    are left behind.
    """
    stage = Stage(docs.sparkSession, "histsort")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)).alias("d"),
        text_key(docs["text"]).alias("h"),
        (F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows = stage.keep(rows)
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    bytes_, n = total["bytes"] or 0, total["rows"]
    marks = find_splitters(rows, {s: (bytes_ * s / shards, tolerance * bytes_ / shards) for s in range(1, shards)}, F.col("size"))
    borders = [marks[s] for s in sorted(marks)]
    parts = max(LEAST_PARTS, -(-n // part_rows))
    mixed = F.col("size") / F.lit(float(max(1, bytes_))) + F.lit(1.0 / max(1, n))
    inner = find_splitters(rows, {p: (2.0 * p / parts, 0.5 / parts) for p in range(1, parts)}, mixed)
    cuts = sorted({*borders, *inner.values()})
    # parts that lie in shard s are those from first[s] on
    first = [0, *(bisect_left(cuts, b) + 1 for b in borders)]
    dealt = rows.withColumn("part", part_of(cuts)).withColumn("shard", F.size(F.filter(F.array(*[F.lit(x) for x in first[1:]]), lambda x: x <= F.col("part"))) if len(first) > 1 else F.lit(0))
    dealt = stage.keep(dealt)
    stage.drop(rows)
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, at, shard = [], 0, 0
    for p in range(len(cuts) + 1):
        while shard + 1 < len(first) and first[shard + 1] <= p:
            shard, at = shard + 1, 0
        offsets.append(at)
        at += counts.get(p, 0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "d"))
    slot = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("part")) + rank - 1
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """The query: every document, into shards 0 to 7."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
