"""WARC archives by way of a chunked record table.

Spark cuts each payload into (record, chunk number, bytes) rows of CHUNK bytes, range-partitions the rows by record and
sorts them, and each task streams its rows into one archive. Reading is the same backwards: a task streams through an
archive and emits (record, chunk number, bytes) rows with the digest so far; the last row of a record carries its whole
digest. The archive's writer and reader never allocate a record. The step before them does: record_table encodes
a page's html to one binary, digests it at once and takes it through the join with the repeated digests (and its shuffle, once these are
too many to broadcast), so a large record needs several times its size in memory there.

Records of equal payloads (of at least LEAST bytes) are written once, as the response of the largest id; the others are
revisit records that refer to it. Which record that is comes from one map-side combined aggregate over digests.

Each record is a gzip member of its own (.warc.gz), packed and unpacked as a stream.

A chunk of hot content costs its own rows only. An archive is written under a name of the task's own attempt
and moved into place when it is whole, so a lost executor costs just its own archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import Stage, map_frames, new_folder
from sparkloom.llm.bitplanes import open_store

LEAST = 1000
CHUNK = 1 << 20
LEVEL = 1
EOL = b"\r\n"
#: The profile and date of the records written.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_table(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Per page: page_id, url, payload binary (null html: empty), size, digest, refers_to (null: a response).

    Equal pages with an equal id are records of their own; of those with the largest id the writer makes one the response and
    the others revisits of it. A null id is no target of a revisit unless all of a payload's ids are null, and then each is a response.
    """
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    first = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "first")
    # written, so that its size is known: the payloads stay where they are if it is small enough for Spark to broadcast
    first = Stage(pages.sparkSession, "warc-first").keep(first)
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("d", "s", "first")


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows (page_id, url, size, digest, refers_to, chunk_no, bytes); a revisit has one empty chunk."""
    last = F.when(F.col("refers_to").isNotNull() | (F.col("size") == 0), 0).otherwise(F.floor((F.col("size") - 1) / chunk)).cast("int")
    cut = F.when(F.col("refers_to").isNotNull(), F.lit(b"")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"))
    return records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select(*[c for c in ("record", "page_id", "url", "size", "digest", "refers_to", "chunk_no") if c in [*records.columns, "chunk_no"]], cut.alias("bytes"))


def uri_of(page_id: int | None, digest: str, repeat: int = 0) -> str:
    """A record's own id: of several equal rows, each but the first is numbered."""
    return f"<urn:sparkloom:page:{'null' if page_id is None else page_id}:{digest}{f':{repeat}' if repeat else ''}>"


def header(page_id: int | None, url: str, size: int, digest: str, refers_to: int | None, repeat: int = 0) -> bytes:
    """A record's header lines; the block of a response is the payload, that of a revisit is empty."""
    url = "".join(c for c in url if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {uri_of(page_id, digest, repeat)}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {b32(digest)}", "Content-Type: text/html;charset=utf-8", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {uri_of(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {size if refers_to is None else 0}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + EOL + EOL


def write_archives(pages: DataFrame, folder: str, parts: int | None = None, chunk: int = CHUNK, least: int = LEAST) -> list[str]:
    """Writes a record for every page and returns the archives' paths, in order of the page ids (nulls first).

    Tasks take ranges of ids; only the list of archives reaches the driver. An empty table writes none.
    """
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, part, path, left, digest, pack, last, repeat, empty = None, "", "", 0, None, None, None, 0, False
        for batch in batches:
            for r in batch.astype({"page_id": object, "refers_to": object}).itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                if out is None:
                    store, root = open_store(folder)
                    store.create_dir(root, recursive=True)
                    name = f"pages-{TaskContext.get().partitionId():07d}.warc.gz"
                    part, path = f"{root}/{name}.{uuid.uuid4().hex}.part", f"{root}/{name}"
                    out = store.open_output_stream(part, compression=None)
                if r.chunk_no == 0:
                    # equal rows follow each other: the first of the response's id is the response, the others revisit it
                    repeat = repeat + 1 if last == (page_id, r.digest) else 0
                    last = (page_id, r.digest)
                    empty = refers_to is not None or repeat > 0 and page_id is not None and r.size >= least
                    refers_to = page_id if empty and refers_to is None else refers_to
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(pack.compress(header(page_id, r.url, r.size, r.digest, refers_to, repeat)))
                    left, digest = 0 if refers_to is not None else r.size, hashlib.sha1()
                elif empty:
                    continue
                if not empty:
                    out.write(pack.compress(r.bytes))
                    digest.update(r.bytes)
                    left -= len(r.bytes)
                if left == 0:
                    if not empty and digest.hexdigest() != r.digest:
                        raise ValueError(f"the chunks of page {page_id} don't make up its payload")
                    out.write(pack.compress(EOL + EOL) + pack.flush())
        if out is not None:
            out.close()
            store.move(part, path)
            yield pd.DataFrame({"file": [f"{folder}/{path.rpartition('/')[2]}"], "number": [TaskContext.get().partitionId()]})

    # the record number keeps the chunks of rows that share an id apart
    rows = chunk_rows(record_table(pages, least).withColumn("record", F.monotonically_increasing_id()), chunk)
    # rows of one id are dealt by their digests too; equal rows stay together
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63)))).repartitionByRange(parts, "key", "digest").sortWithinPartitions("key", "digest", "record", "chunk_no").drop("key", "record")
    files = map_frames(rows, write, "file string, number int").collect()
    return [f["file"] for f in sorted(files, key=lambda f: f["number"])]


class Unpacked:
    """Reads a stream of gzip members as one."""

    def __init__(self, raw):
        self.raw, self.tail, self.unpack = raw, b"", zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the stream has ended."""
        while True:
            data = self.tail or self.raw.read(1 << 16)
            if not data:
                return b""
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            out = self.unpack.decompress(data, n)
            self.tail = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                return out


def records_in(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Streams an archive: (head lines as a dict, chunk number, bytes, digest so far, bytes so far, last)."""
    store, at = open_store(path)
    with store.open_input_stream(at, compression=None) as packed:
        raw = Unpacked(packed)
        held = b""

        def line() -> bytes:
            nonlocal held
            while EOL not in held:
                more = raw.read(1 << 16)
                if not more:
                    got, held = held, b""
                    return got
                held += more
            got, _, held = held.partition(EOL)
            return got

        while True:
            first = line()
            if not first:
                if not held and not (held := raw.read(1 << 16)):
                    return
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"{path}: {first[:40]!r} where a record should begin")
            head = {}
            while got := line():
                name, _, value = got.decode("utf-8", "surrogatepass").partition(":")
                head[name.lower()] = value.strip()
            left, number, digest, so_far = int(head["content-length"]), 0, hashlib.sha1(), 0
            while True:
                want = min(chunk, left)
                while len(held) < want and (more := raw.read(max(1 << 16, want - len(held)))):
                    held += more
                if len(held) < want:
                    raise ValueError(f"{path} ends within a record")
                piece, held = held[:want], held[want:]
                digest.update(piece)
                left -= want
                so_far += want
                yield head, number, piece, digest.hexdigest(), so_far, left == 0
                number += 1
                if not left:
                    break


CHUNK_SCHEMA = "page_id long, chunk_no int, bytes binary, digest_so_far string, bytes_so_far long, is_last boolean, record_type string, refers_to long, payload_digest string, payload_length long"


def read_chunks(spark: SparkSession, files: list[str], chunk: int = CHUNK, with_bytes: bool = True) -> DataFrame:
    """The chunked record table of the archives: a row a chunk, with the digest and the bytes so far."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file"]:
                rows, size = [], 0
                for head, number, piece, so_far, length, last in records_in(path, chunk):
                    if with_bytes or last:
                        full = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((_id(head["warc-record-id"]), number, piece if with_bytes else b"", so_far, length, last, head["warc-type"], _id(head.get("warc-refers-to")), full, int(head["x-payload-length"])))
                        size += len(rows[-1][2])
                    if len(rows) >= 4096 or size >= 8 * chunk:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    if not files:
        return spark.createDataFrame([], CHUNK_SCHEMA)
    names = spark.createDataFrame(list(enumerate(files)), "n int, file string")
    return names.repartitionByRange(len(files), "n").mapInPandas(read, CHUNK_SCHEMA)


def _id(uri: str | None) -> int | None:
    tail = uri.split(":")[3] if uri else "null"
    return None if tail == "null" else int(tail)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "chunk_no", "bytes", "digest_so_far", "bytes_so_far", "is_last", "record_type", "refers_to", "payload_digest", "payload_length"])
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[0 if c == "page_id" else 7] for r in rows], "Int64")
    return out


def read_records(spark: SparkSession, files: list[str], chunk: int = CHUNK) -> DataFrame:
    """Per record, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are those of the bytes read (a difference from its head is an error); those of a revisit, which
    has no bytes, are those that its head states of the payload it refers to.
    """
    rows = read_chunks(spark, files, chunk, with_bytes=False).filter("is_last")
    wrong = (F.col("record_type") == "response") & ((F.col("digest_so_far") != F.col("payload_digest")) | (F.col("bytes_so_far") != F.col("payload_length")))
    size = F.when(wrong, F.raise_error(F.concat(F.lit("damaged payload of page "), F.col("page_id").cast("string"))).cast("long")).when(F.col("record_type") == "response", F.col("bytes_so_far")).otherwise(F.col("payload_length"))
    return rows.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole page to archives in the shared folder and back."""
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return read_records(spark, files)
