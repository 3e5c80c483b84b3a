"""BPE encoding and decoding with a contiguous rank array per word.

A word's parts lie side by side in two arrays: the part ids and, for each part, the rank of its merge
with the next part. Until no rank is left, the smallest rank is found by a scan, the boundary after it
is deleted, and the ranks of the two neighbours are refreshed. Words are short, so a scan beats a heap; a piece of more than
SHORT bytes, where scans would take the square of its length, merges the same pairs in the same order from a heap.

Texts are cut at white space (no piece of the vocabulary's pattern crosses it) and each distinct
white-space-free run is encoded once for a worker while it is kept; what is kept is bounded in bytes (the less recent half
goes when it is full) and holds no long runs, so memory is bounded whatever the corpus. Rows are independent: no shuffle, no state, and a lost task is just rerun.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import Kept, docs_only, map_frames

#: Bytes that a worker keeps for runs, and half as many for other pieces.
CACHE_BYTES = 96 << 20
#: Bytes of a piece up to which ranks are scanned.
SHORT = 256
NONE = 1 << 60
assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are laid out as the machine lays them out"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordBpe:
    """A lower-casing word BPE read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        every = [*self.vocab.items(), *self.added.items()]
        self.names = [""] * (max(i for _, i in every) + 1)
        for t, i in every:
            self.names[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.spaces = regex.compile(r"\p{White_Space}+").split
        self.odd = regex.compile("[\x1c-\x1f]").search  # white space to str.split, but not to the vocabulary
        self.letters = byte_letters()
        self.runs, self.words = Kept(self.run, cache), Kept(self.word, cache // 2)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges parts until no adjacent pair has a rank; the leftmost of equal ranks goes first."""
        get, none = self.merges.get, (NONE, 0)
        ranks = [get(pair, none)[0] for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NONE:
            at = ranks.index(low)
            ids[at] = get((ids[at], ids[at + 1]))[1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)[0]
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)[0]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order for a long piece: the least (rank, place) comes from a heap, parts are linked by place."""
        get, n = self.merges.get, len(ids)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [rank << 40 | i for i, pair in enumerate(zip(ids, ids[1:])) if (rank := get(pair, (NONE, 0))[0]) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 40)
            j = after[i]
            if ids[i] < 0 or j >= n or (to := get((ids[i], ids[j]), (NONE, 0)))[0] != rank:
                continue  # one of the parts has been merged since
            ids[i], ids[j], after[i] = to[1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (rank := get((ids[p], ids[q]), (NONE, 0))[0]) < NONE:
                    heapq.heappush(heap, rank << 40 | p)
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> bytes:
        """A piece's ids as little-endian 32-bit integers."""
        marks = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        marks[-1] += self.end
        ids = [self.vocab[m] for m in marks]
        return array("I", self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)).tobytes()

    def run(self, run: str) -> bytes:
        """The same of a white-space-free run. An ASCII piece in lower case is a run of its own, and kept as one."""
        if run.isascii():
            got = self.pieces(run.lower())
            return self.word(run) if got == [run] else b"".join([self.runs[p] for p in got])
        text = unicodedata.normalize("NFC", run)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return b"".join([self.words[p] for p in self.pieces(text)])

    def plain(self, text: str) -> Iterator[bytes]:
        return map(self.runs.__getitem__, [x for x in self.spaces(text) if x] if self.odd(text) else text.split())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens in the text become their ids."""
        if "<|" not in text:
            return b"".join(self.plain(text))
        return b"".join([b"".join([self.added[x].to_bytes(4, "little")] if x in self.added else self.plain(x)) for x in self.split_added(text)])

    def decode(self, ids: bytes) -> str:
        """The text of ids; every id's name, the suffix that ends words included, is set off by a blank."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the ids and the decoded text of every whole text.

    Returns ``key``, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded string.
    Null and empty texts have no ids and decode to ""; rows are returned as they come, repeats and null
    keys included; other columns are left behind.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                got = [bpe.encode(t or "") for t in part["t"]]
                yield pd.DataFrame({"k": part["k"].array, "n_tokens": [len(g) // 4 for g in got], "ids": got, "decoded": list(map(bpe.decode, got))})

    rows = docs_only(docs, key, text).toDF("k", "t")
    return map_frames(rows, encode, f"k {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("k", key)


def digest_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As encode_documents, with SHA-256 digests made beside the encoder instead of the ids and text themselves."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for t in batch["t"]:
                ids = bpe.encode(t or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "k", batch["k"].array)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs_only(docs, "doc_id", "text").toDF("k", "t")
    return map_frames(rows, encode, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").select(F.col("k").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """The query: every whole document, encoded and decoded."""
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
