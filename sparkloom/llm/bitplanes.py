"""Token ids in bit-plane files: fixed-size id blocks, transposed to bit planes, each plane zstandard-compressed.

File format (all integers little-endian):

    b"SLBITPL1"
    chunks, in any order:
        id block    up to BLOCK ids; bit plane b holds bit b of every id, eight ids a byte, padded with 0;
                    planes above the block's highest set bit are left out
        doc group   up to GROUP documents: int64 ids, uint8 null marks, int64 id counts, each compressed
    index           JSON, compressed: [["ids", offset, n, [plane lengths]] | ["docs", offset, n, [3 lengths]]]
    footer          uint64 index offset, uint64 index length, uint64 ids, uint64 documents, b"SLBITPL1"

A block is decoded alone through the index, so readers seek and hold one block and one group at a time.
Documents are range-partitioned by id, and rows of one id by their texts' hashes (one exchange of the texts), into as many ranges as their
bytes ask for; each task streams its sorted rows into one file, under a name of its own attempt that is moved into place
when it is whole. A rerun task writes the same bytes again, so lost executors cost only their own tasks.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import Kept, docs_only, map_frames, new_folder
from sparkloom.llm.bpe import byte_letters

MAGIC = b"SLBITPL1"
BLOCK = 1 << 16
GROUP = 1 << 14
LEVEL = 1
#: Bytes of texts in a file, about; bytes that a worker keeps for pieces; characters that are cut into pieces at once.
FILE_BYTES, CACHE_BYTES, AT_ONCE = 256 << 20, 192 << 20, 1 << 20
assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are laid out as the machine lays them out"


def open_store(path: str):
    """The file system and the path in it; any scheme that Arrow knows (file, hdfs, s3, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of unsigned 32-bit ids, lowest bit first, up to the highest bit in use."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    shifts = np.arange(top, dtype=np.uint32)[:, None]
    return [row.tobytes() for row in np.packbits(((ids[None, :] >> shifts) & 1).astype(np.uint8), axis=1)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return ids


class Writer:
    """Streams (doc id, id bytes) into one file; holds at most a block of ids and a group of documents."""

    def __init__(self, path: str, block: int = BLOCK):
        import zstandard

        self.store, self.path = open_store(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.block, self.index = len(MAGIC), block, []
        self.press = zstandard.ZstdCompressor(level=LEVEL).compress
        self.ids, self.docs, self.n_ids, self.n_docs = bytearray(), [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids += ids
        self.docs.append((doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.n_docs += 1
        size = 4 * self.block
        if len(self.ids) >= size:
            whole = len(self.ids) // size * size
            for lo in range(0, whole, size):
                self._ids(bytes(self.ids[lo : lo + size]))
            del self.ids[:whole]
        if len(self.docs) >= GROUP:
            self._docs()

    def _put(self, kind: str, n: int, parts: list[bytes]) -> None:
        packed = [self.press(p) for p in parts]
        self.index.append([kind, self.at, n, [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def _ids(self, raw: bytes) -> None:
        self._put("ids", len(raw) // 4, to_planes(np.frombuffer(raw, "<u4")))

    def _docs(self) -> None:
        keys = np.array([d or 0 for d, _ in self.docs], "<i8")
        nulls = np.array([d is None for d, _ in self.docs], np.uint8)
        self._put("docs", len(self.docs), [keys.tobytes(), nulls.tobytes(), np.array([n for _, n in self.docs], "<i8").tobytes()])
        self.docs = []

    def close(self) -> None:
        if self.ids:
            self._ids(bytes(self.ids))
        if self.docs:
            self._docs()
        index = self.press(json.dumps(self.index).encode())
        self.out.write(index + struct.pack("<4Q", self.at, len(index), self.n_ids, self.n_docs) + MAGIC)
        self.out.close()
        self.store.move(self.part, self.path)


class Reader:
    """Reads a file through its index."""

    def __init__(self, path: str):
        import zstandard

        store, at = open_store(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        where, length, self.n_ids, self.n_docs = struct.unpack("<4Q", tail[:32])
        if tail[32:] != MAGIC:
            raise ValueError(f"{path} isn't a bit-plane file")
        self.open = zstandard.ZstdDecompressor().decompress
        index = json.loads(self.open(self.file.read_at(length, where)))
        self.blocks, self.groups = ([x for x in index if x[0] == kind] for kind in ("ids", "docs"))

    def _parts(self, entry: list) -> list[bytes]:
        raw, at, out = self.file.read_at(sum(entry[3]), entry[1]), 0, []
        for n in entry[3]:
            out.append(self.open(raw[at : at + n]))
            at += n
        return out

    def block(self, i: int) -> np.ndarray:
        """Block i alone."""
        return from_planes(self._parts(self.blocks[i]), self.blocks[i][2])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, in file order."""
        held, nxt = np.zeros(0, np.uint32), 0
        for group in self.groups:
            keys, nulls, counts = self._parts(group)
            for key, null, n in zip(np.frombuffer(keys, "<i8").tolist(), nulls, np.frombuffer(counts, "<i8").tolist(), strict=True):
                if len(held) < n:
                    parts, have = [held], len(held)
                    while have < n:
                        parts.append(self.block(nxt))
                        have, nxt = have + len(parts[-1]), nxt + 1
                    held = np.concatenate(parts)
                yield (None if null else key), held[:n]
                held = held[n:]


# The vocabulary's pattern, and the code points among which Python's classes of letters, digits and white space
# are the vocabulary's; a text with any other code point goes to the library whole.
PIECES = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PLAIN = (
    "\\t-\\r -\\u00b1\\u00b4-\\u00b8\\u00ba\\u00bb\\u00bf-\\u052f\\u2000-\\u206f\\u20a0-\\u20cf\\u2190-\\u245f\\u2500-\\u2775\\u2794-\\u2bff"
    "\\u3000-\\u3006\\u3008-\\u3020\\u3040-\\u30ff\\u4e00-\\u9fef\\uac00-\\ud7a3\\uff01-\\uffef\\U0001f300-\\U0001faff"
)


class ByteBpe:
    """The tokenizers library, whose BPE model is asked once for each distinct piece.

    A plain text is cut into the pieces of the vocabulary's pattern here; the ids of pieces up to LONGEST characters are kept, up to
    CACHE_BYTES in two generations (the older one goes when the newer is full), so a worker's memory is bounded.
    Texts that hold an added token or a code point out of PLAIN go to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts = self.library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = re.compile(PIECES)
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.kept = Kept(self.piece, cache)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """A piece's ids; the model reads each byte as one letter, which for printable ASCII but the blank is the byte itself."""
        plain = piece.isascii() and piece.isprintable()
        read = piece.replace(" ", self.letters[32]) if plain else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.parts(read)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.odd(text) or any(a in text for a in self.added):
            return self.whole(text)
        if len(text) <= AT_ONCE:
            return b"".join(map(self.kept.__getitem__, self.pieces.findall(text)))
        found, out = self.pieces.finditer(text), []
        while some := [m.group() for m in islice(found, AT_ONCE // 8)]:
            out.append(b"".join(map(self.kept.__getitem__, some)))
        return b"".join(out)


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int | None = 2, parts: int | None = None) -> list[dict]:
    """Encodes every whole text and writes the ids, documents in ascending doc_id order, one file a range of ids.

    Returns one entry a file, in order: file, n_ids, n_docs, start (ids in the files before it). Null and
    empty texts hold only the end id; null doc_ids come first; repeated rows are all written, those of one id in the order of their
    texts' hashes; an empty table writes no file. There are at least as many ranges as shuffle partitions, and more if a file would
    exceed FILE_BYTES of text. Only the list of files reaches the driver.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    rows = docs_only(docs, "doc_id", "text")
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, out = load(path), None
        number = TaskContext.get().partitionId()  # ranges are numbered in order
        name = f"{folder}/ids-{number:07d}.slb"
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"], strict=True):
                out = out or Writer(name)
                out.add(None if doc_id is None else int(doc_id), bpe.encode(text or "") + end)
        if out is not None:
            out.close()
            yield pd.DataFrame({"number": [number], "file": [name], "n_ids": [out.n_ids], "n_docs": [out.n_docs]})

    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    files = map_frames(rows, write, "number int, file string, n_ids long, n_docs long").collect()
    start, out = 0, []
    for f in sorted(files, key=lambda f: f["number"]):
        out.append({"file": f["file"], "n_ids": f["n_ids"], "n_docs": f["n_docs"], "start": start})
        start += f["n_ids"]
    return out


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (of the little-endian ids)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"], strict=True):
                rows = []
                for doc_id, ids in Reader(name).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == GROUP:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    if not files:
        return spark.createDataFrame([], READ_SCHEMA)
    names = spark.createDataFrame([(f["file"], f["start"]) for f in files], "file string, start long")
    return names.repartitionByRange(len(files), "start").mapInPandas(read, READ_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
    return out


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole document's ids to files in the shared folder and back."""
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "tokens"))
    return read_token_files(spark, files)
