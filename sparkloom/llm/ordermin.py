"""Order MinHash fingerprints, sensitive to edit distance.

A text is a sequence of tokens: its white-space-free runs, cut into pieces of at most PIECE code points. Where at least
LONG code points follow without a blank, pieces of PIECE begin at every code point, so that in unbroken text
an edit changes only the pieces that hold it; the run's last LONG - 1 are cut as a run of their own. Its
K-mers of tokens are numbered by occurrence, so that repeats differ. Each of ENTRIES entries orders all numbered k-mers of
the text by a hash of its own; the TUPLE least are selected, put back into their order in the text, and hashed as a
tuple. Two texts agree in an entry only if they share its least k-mers and have them in the same order, so moved text
lowers the likeness, which a set's MinHash would not see.

An entry's hash of a k-mer is (round, rank): in each round a k-mer visits one entry, and in as many rounds as there are entries it
visits each once. Start and step of its way are hashed, so an entry's order of the k-mers is a random one. A k-mer
of an early round comes before all of later rounds, so only so many rounds are worked out that about DEALT visits are made; an
entry that then holds fewer than TUPLE k-mers looks up the rounds of all k-mers. How many rounds are worked out never
changes the result, and the cost stays linear in the text.

Everything within a text is done by array functions in its own row: no row is made for a k-mer, and the one exchange is of the documents
themselves, so that each can see the next one. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import bounds_of, bucket_of

PIECE, K = 8, 2
#: So many code points without a blank are unbroken text.
LONG = 32
ENTRIES, TUPLE = 64, 2
#: Visits after which few entries still hold fewer than TUPLE k-mers.
DEALT = 448
#: Visits of round 0 kept in a text of more than twice as many k-mers; an entry that holds too few of them looks up all.
LEAST_RANKS = 896
#: Places are kept in so many low bits: an array of Spark's holds fewer than 2 ** 28 numbers, as it has less than 2 ** 31 bytes.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Documents in a bucket of neighbouring ids, and buckets at most (their bounds are literals of the plan); beyond, buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 1500, 1 << 14


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: array functions would work it out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(h: Column, p: Column) -> Column:
    """A hash's leading bits and a place in one number, which sorts by hash first."""
    return h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(p.cast("long").bitwiseAND(F.lit(PLACES)))


def hash_of(v: Column) -> Column:
    return v.bitwiseAND(F.lit(~PLACES))


def numbered_kmers(text: Column, piece: int = PIECE, k: int = K) -> Column:
    """array<long> of a text: each k-mer's hash, with its occurrence number worked in, packed with its place."""
    tokens = F.regexp_extract_all(text, F.lit(rf"(?=([^\s]{{1,{piece}}}))(?:(?=[^\s]{{{LONG}}})[^\s]|[^\s]{{1,{piece}}})"), F.lit(1))
    none = F.array().cast("array<bigint>")

    def of_hashes(h: Column) -> Column:
        last = F.greatest(F.size(h) - k, F.lit(0))
        kmers = F.transform(F.sequence(F.lit(0), last), lambda i: packed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))
        # sorted, equal k-mers are neighbours in text order
        return let(F.sort_array(kmers), lambda s: let(F.filter(s, lambda v, i: repeats(s, v, i)), lambda again: numbers(s, again)))

    def repeats(s: Column, v: Column, i: Column) -> Column:
        """Whether v, at place i of s, has the same hash as the one before it."""
        return (i > 0) & (F.shiftright(v.bitwiseXOR(F.get(s, i - 1)), PLACE_BITS) == 0)

    def number(v: Column, i: Column) -> Column:
        return packed(F.xxhash64(hash_of(v), i), v)

    def numbers(s: Column, again: Column) -> Column:
        """First occurrences have the number 0; of the others, which are few, runs give the numbers."""
        first = F.transform(F.when(F.size(again) == 0, s).otherwise(F.filter(s, lambda v, i: ~repeats(s, v, i))), lambda v: number(v, F.lit(0)))
        return F.when(F.size(again) == 0, first).otherwise(F.concat(first, let(starts(again), lambda b: later(again, b))))

    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == F.size(s)) | ~repeats(s, F.get(s, i), i))

    def later(s: Column, b: Column) -> Column:
        return F.flatten(F.transform(F.slice(b, 1, F.size(b) - 1), lambda lo, r: F.transform(F.slice(s, lo + 1, F.get(b, r + 1) - lo), lambda v, i: number(v, i + 1))))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) == 0, none).otherwise(of_hashes(h)))


def fingerprint(text: Column, entries: int = ENTRIES, size: int = TUPLE, dealt: int = DEALT, kept: int = LEAST_RANKS) -> Column:
    """array<long> of an entry each: the hash of its tuple; null: the text has no k-mer. Null texts count as empty.

    A visit is one number: entry, round, rank and place, from the leading bits down. ``dealt`` and ``kept`` change the cost only.
    """
    bits = (entries - 1).bit_length()
    ways, low = 1 << bits, 64 - 2 * bits

    def step(v: Column) -> Column:
        """Odd, so that a way visits every entry; of the hash's last bits, which no rank of round 0 uses."""
        return F.shiftrightunsigned(v, PLACE_BITS).bitwiseAND(F.lit(ways // 2 - 1)) * 2 + 1

    def start(v: Column) -> Column:
        return F.shiftrightunsigned(v, 64 - bits)

    def entry(v: Column) -> Column:
        return F.shiftrightunsigned(v, 64 - bits).cast("int")

    def visit(v: Column, e: Column, r: Column) -> Column:
        rank = F.when(r == 0, F.shiftrightunsigned(v, bits)).otherwise(F.xxhash64(hash_of(v), r))
        head = F.shiftleft(F.shiftleft(e, bits).bitwiseOR(r), low)
        return head.bitwiseOR(rank.bitwiseAND(F.lit((1 << low) - 1 - PLACES))).bitwiseOR(v.bitwiseAND(F.lit(PLACES)))

    def in_first(v: Column) -> Column:
        """visit(v, start(v), 0): the hash's leading part is the entry, what follows the rank."""
        kept = ((1 << 64) - (1 << (64 - bits)) - (1 << 64)) | PLACES
        return v.bitwiseAND(F.lit(kept)).bitwiseOR(F.shiftrightunsigned(v, bits).bitwiseAND(F.lit((1 << low) - 1 - PLACES)))

    def in_round(v: Column, r: Column) -> Column:
        return visit(v, (start(v) + r * step(v)).bitwiseAND(F.lit(ways - 1)), r)

    def to_entry(v: Column, e: Column) -> Column:
        """v's visit to e: its round is (e - start) / step, and an odd s has the inverse s (2 - s s) modulo 64, as s s = 1 modulo 8."""
        s = step(v)
        inverse = s
        for _ in range(max(1, (bits - 1).bit_length() - 1)):
            inverse = (inverse * (F.lit(2) - s * inverse)).bitwiseAND(F.lit(ways - 1))
        return visit(v, e, ((e - start(v)) * inverse).bitwiseAND(F.lit(ways - 1)))

    def firsts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.shiftrightunsigned(F.get(s, i).bitwiseXOR(F.get(s, i - 1)), 64 - bits) != 0))

    def tuples(x: Column, s: Column, b: Column) -> Column:
        picked = F.transform(b, lambda lo: F.struct(entry(F.get(s, lo)).alias("e"), F.filter(F.slice(s, lo + 1, size), lambda v: entry(v) == entry(F.get(s, lo))).alias("own")))
        whole = F.least(F.lit(size), F.size(x))

        def of(own: Column, e: Column) -> Column:
            return in_order(F.when(F.size(own) >= whole, own).otherwise(F.slice(F.sort_array(F.transform(x, lambda v: to_entry(v, e))), 1, size)))

        return let(F.map_from_entries(picked), lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(entries - 1).cast("long")), lambda e: let(F.coalesce(F.try_element_at(m, e.cast("int")), F.array().cast("array<bigint>")), lambda own: of(own, e))))

    def in_order(own: Column) -> Column:
        """The selected k-mers by place: place and hash change sides, and are sorted again."""
        by_place = F.sort_array(F.transform(own, lambda v: F.shiftleft(v.bitwiseAND(F.lit(PLACES)), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(v, PLACE_BITS))))
        return F.xxhash64(F.transform(by_place, lambda x: x.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1))))

    def least_ranks(x: Column) -> Column:
        """The k-mers whose rank in round 0 is among the least ``kept`` of size(x), or about so many: each entry's least are there if any TUPLE are."""
        ranks = 64 - PLACE_BITS - bits
        bound = F.floor(F.lit(kept << ranks) / F.size(x)).cast("long")
        return let(bound, lambda t: F.filter(x, lambda v: F.shiftrightunsigned(F.shiftleft(v, bits), bits + PLACE_BITS) < t))

    def selected(x: Column) -> Column:
        n = F.size(x)
        rounds = F.least(F.lit(ways), F.ceil(F.lit(dealt) / n)).cast("long")
        more = F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), rounds - 1), lambda r: F.transform(x, lambda v: in_round(v, r))))
        first = lambda y: F.transform(y, in_first)
        visits = F.when(n > 2 * kept, first(least_ranks(x))).when(rounds > 1, F.concat(first(x), more)).otherwise(first(x))
        # in sorted order an entry's visits are neighbours, for the entry is the leading part
        return let(F.sort_array(visits), lambda s: let(firsts(s), lambda b: tuples(x, s, b)))

    empty = F.array_repeat(F.lit(None).cast("long"), entries)
    return let(numbered_kmers(F.coalesce(text, F.lit(""))), lambda x: F.when(F.size(x) == 0, empty).otherwise(selected(x)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries among those not empty in both; two empty fingerprints are alike."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def as_text(fp: Column) -> Column:
    """16 hexadecimal digits an entry, ``-`` for an empty one."""
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lpad(F.hex(x), 16, "0"), F.lit("-"))), ".")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: doc_id, text, fp, and next_text, next_fp of the row with the next smaller id (after the smallest: the largest).

    Ids are cut into runs of about equal counts; a run's largest row is also sent to the run above, whose last row
    it follows, so each run finds its neighbours alone, in one exchange of the documents. Rows that share an id
    follow each other by text; rows with a null id come after the smallest.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    n = rows.count()
    bounds = bounds_of(rows, "doc_id", max(1, min(n // bucket_rows, MOST_BUCKETS)))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket_of("doc_id", bounds)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    # which buckets hold rows, and each one's first id: a row or so a bucket
    heads = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    above = {b: heads[(i + 1) % len(heads)][0] for i, (b, _) in enumerate(heads)}
    rows = rows.withColumn("fp", fingerprint(F.col("text")))
    to = F.create_map(*[F.lit(x) for b, a in above.items() for x in (b, a)]) if above else F.create_map(F.lit(-2), F.lit(-2))
    first = F.create_map(*[F.lit(x) for b, d in heads if d is not None for x in (b, d)]) if any(d is not None for _, d in heads) else F.create_map(F.lit(-2), F.lit(0))
    is_first = F.col("doc_id").eqNullSafe(F.try_element_at(first, F.col("bucket")))
    copies = F.when(is_first, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(F.try_element_at(to, F.col("bucket")).alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))))
    dealt = rows.withColumn("_c", F.explode(copies)).select("doc_id", "text", "fp", F.col("_c.b").alias("b"), F.col("_c.guest").alias("guest"))
    w = Window.partitionBy("b").orderBy(F.col("guest").asc(), *order)
    return dealt.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).filter("not guest")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document. Null texts count as empty; an only row is its own next. Other columns are left behind.
    """
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_fp": fingerprint(F.col("edited"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op3_order_minhash(spark, sf_dir: str) -> DataFrame:
    """The query: every whole document."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
