"""WARC archives of any payload size, as a chunked record table.

A record is rows (record, chunk, data): payloads are cut into chunks of CHUNK bytes, and from there on
nothing holds a record whole.  Chunks carry running digests of all bytes up to their end, so the last
one has the payload's.  Which records repeat an earlier payload is decided from the last chunks alone,
by digests.  Then a record's decision and its chunks are sorted to one task, which streams them into
an archive, one gzip member for each record; a decision stands before the chunks, as a header does.
Archives are read back the same way: a member is inflated piece by piece into chunk rows whose running
digest starts anew and is held against the header's at the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import shared_dir, stored, table, tidy

#: Bytes of a chunk, of rows handed to Spark at a time, and of an archive, about.
CHUNK, BLOCK, ARCHIVE = 1 << 16, 1 << 22, 1 << 28
#: Parts of a group of equal payloads.
SALTS = 256
DIGESTS = "size bigint, sha1 binary, check binary"


class Digest:
    """SHA-1 of what was seen so far, with its size and a second hash that tells forged SHA-1 twins apart."""

    def __init__(self) -> None:
        import xxhash

        self.size, self.sha1, self.other = 0, hashlib.sha1(usedforsecurity=False), xxhash.xxh3_128()

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.sha1.update(data)
        self.other.update(data)

    def state(self) -> tuple[int, bytes, bytes]:
        return self.size, self.sha1.digest(), self.other.digest()


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_table(frame: DataFrame, payload: Column, columns: dict[str, Column], size: int = CHUNK) -> DataFrame:
    """record, chunk, last, data, the named columns, and the running size, sha1 and check of each record's bytes so far.

    ``payload`` is text or binary; null counts as empty, and an empty payload has one empty chunk.  Records
    are numbered by their place in the table, so the result has to be written down before it is used twice.
    """
    rows = frame.select(F.monotonically_increasing_id().alias("record"), *[c.alias(name) for name, c in columns.items()], F.coalesce(payload.cast("binary"), F.lit(b"")).alias("data"))
    chunks = F.ceil(F.greatest(F.octet_length("data"), F.lit(1)) / size).cast("int")
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        "record", *columns, "chunk", (F.col("chunk") == chunks - 1).alias("last"), F.substring("data", F.col("chunk") * size + 1, F.lit(size)).alias("data")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Digest()
        for batch in batches:
            if not batch.num_rows:
                continue
            states = []
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                if chunk == 0:
                    digest = Digest()
                digest.add(data.as_buffer())
                states.append(digest.state())
            more = [pa.array(list(x), kind) for x, kind in zip(zip(*states, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "size", "sha1", "check"])

    # an exploded row's chunks stay together and in order
    return cut.mapInArrow(tidy(run), f"{cut._jdf.schema().toDDL()}, {DIGESTS}")


def revisits(ends: DataFrame, order: str, least: int = 0) -> DataFrame:
    """``ends`` (record, ``order``, size, sha1, check) with the record and the ``order`` of the response that a record revisits, null for responses.

    Of equal payloads of at least ``least`` bytes the one of the largest ``order`` is the response (null is the smallest,
    ties go to the larger record).  A group of any size is cut into SALTS parts, each of which knows
    the group's response, so no task reads a whole group.
    """
    same = ["size", "sha1", "check"]
    rows = ends.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int"))
    top = F.max(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), "record")).alias("top")
    parts = rows.where(F.col("size") >= least).groupBy(*same, "salt").agg(top, F.count(F.lit(1)).alias("n"))
    best = parts.groupBy(*same).agg(F.max("top").alias("top"), F.collect_list("salt").alias("salts"), F.sum("n").alias("n")).where("n > 1")
    known = best.select(*same, F.explode("salts").alias("salt"), F.col("top.record").alias("of"), F.col("top.order").alias("of_order"))
    joined = rows.join(known, [*same, "salt"], "left")
    revisit = F.col("of") != F.col("record")
    return joined.select(*ends.columns, F.when(revisit, F.col("of")).alias("of"), F.when(revisit, F.col("of_order")).alias("of_order"))


def _folder(path: str) -> tuple[object, str]:
    """A file system and a path in it; works for any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _name(record: int, page: int | None) -> str:
    return f"urn:x-page:{'' if page is None else page}:{record}"


def _page(name: str | None) -> int | None:
    page = name.split(":")[-2] if name else ""
    return int(page) if page else None


def _header(row: dict, date: str) -> bytes:
    """The WARC header and the HTTP header of a record; a revisit's block ends with the latter, which names the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["of"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(row['record'], row['page_id'])}>", f"WARC-Date: {date}"]
    if row["url"]:
        # a URI has no blanks or controls
        lines.append("WARC-Target-URI: " + "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"]))
    lines.append(f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(row['of'], row['of_order'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['size'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class _Archives:
    """Archives of a task, one open at a time; each attempt has names of its own, and only what a finished task lists counts."""

    def __init__(self, folder: str, most: int) -> None:
        self.store, self.folder = _folder(folder)
        self.most, self.file, self.made = most, None, []

    def begin(self, header: bytes) -> None:
        if self.file is not None and self.written >= self.most:
            self.close()
        if self.file is None:
            self.path, self.written, self.records = f"{self.folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
            self.file = self.store.open_output_stream(self.path, compression=None)
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.records += 1
        self.add(header)

    def add(self, data: bytes) -> None:
        self._write(self.member.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._write(self.member.flush())

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.written += len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.made.append((self.path.rsplit("/", 1)[1], self.written, self.records))
            self.file = None


def write_archives(frame: DataFrame, folder: str, record: str = "page_id", payload: str = "html", url: str | None = "url", least: int = 0, date: str = "1970-01-01T00:00:00Z", most: int = ARCHIVE) -> DataFrame:
    """file, bytes, records: the archives written into ``folder``, an existing folder that all executors share.

    Every row becomes a record: of equal payloads of ``least`` bytes or more one is a response and the others
    revisit it.  Null payloads are empty; null and repeated ids are records of their own; other columns play no
    part; an empty table writes nothing.  A task that is run again writes files of other names, and the
    list has those of the finished run alone.
    """
    columns = {"page_id": F.col(record).cast("bigint"), "url": F.col(url).cast("string") if url else F.lit(None).cast("string")}
    chunks = stored(chunk_table(frame, F.col(payload), columns), compression="zstd")
    ends = chunks.where("last").select("record", "page_id", "url", "size", "sha1", "check")
    heads = stored(revisits(ends, "page_id", least))
    # a record's decision comes before its chunks; revisits have none to write
    data = chunks.join(heads.where("of IS NOT NULL").select("record"), "record", "left_anti") if not heads.where("of IS NOT NULL").isEmpty() else chunks
    rows = heads.select("record", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("data"), "page_id", "url", "size", "sha1", "of", "of_order").unionByName(
        data.select("record", "chunk", "data"), allowMissingColumns=True
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, begun = _Archives(folder, most), False
        for batch in batches:
            data = batch.column("data")
            for at, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk == -1:
                    if begun:
                        out.end()
                    out.begin(_header({c: batch.column(c)[at].as_py() for c in ("record", "page_id", "url", "size", "sha1", "of", "of_order")}, date))
                    begun = True
                else:
                    out.add(data[at].as_buffer())
        if begun:
            out.end()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in out.made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    dealt = rows.repartition("record").sortWithinPartitions("record", "chunk")
    return stored(dealt.mapInArrow(tidy(run), "file string, bytes bigint, records bigint"))


class _Members:
    """The inflated bytes of a file of gzip members, read piece by piece."""

    def __init__(self, stream: object, piece: int = 1 << 16) -> None:
        self.stream, self.piece, self.rest, self.held = stream, piece, b"", b""
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        """Inflate one more piece, at most ``piece`` bytes of it; whether there was one."""
        while True:
            if self.member.eof:
                self.rest, self.member = self.member.unused_data or self.rest, zlib.decompressobj(31)
            packed = self.member.unconsumed_tail or self.rest or self.stream.read(self.piece)
            self.rest = b""
            if not packed:
                return False
            out = self.member.decompress(packed, self.piece)
            if out:
                self.held += out
                return True

    def upto(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        """1 to ``most`` bytes."""
        if not self.held and not self._more():
            raise ValueError("the archive ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


#: Columns of the chunked record table of archives.
CHUNK_SCHEMA = f"file string, record string, record_type string, refers_to string, url string, http_size bigint, digest string, chunk int, last boolean, data binary, {DIGESTS}"


def _chunks(file: str, stream: object, size: int, keep: bool) -> Iterator[tuple]:
    """Chunk rows of one archive; without ``keep`` only each record's last one, without its bytes."""
    source = _Members(stream)
    while (head := source.upto(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        left = int(fields["content-length"])
        http = source.upto(b"\r\n\r\n") or b""
        left -= len(http)
        shape = file, fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-refers-to", "").strip("<>") or None, fields.get("warc-target-uri"), int(_fields(http)["content-length"])
        wanted = fields["warc-payload-digest"].removeprefix("sha1:")
        digest, chunk = Digest(), 0
        while True:
            parts, room = [], min(left, size)
            while room:
                part = source.take(room)
                digest.add(part)
                room -= len(part)
                left -= len(part)
                parts.append(part)
            if left == 0 and fields["warc-type"] == "response" and base32(digest.sha1.digest()) != wanted:
                raise ValueError(f"{file}: {shape[1]} has other bytes than its digest says")
            if keep or left == 0:
                yield (*shape, wanted, chunk, left == 0, b"".join(parts) if keep else None, *digest.state())
            chunk += 1
            if left == 0:
                break
        if source.upto(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError(f"{file}: {shape[1]} is longer than its header says")


def read_archives(archives: DataFrame, folder: str, data: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunked record table of the files that ``archives`` lists: CHUNK_SCHEMA.

    An archive is one task's, streamed; ``data=False`` gives each record's last chunk without bytes.  A response
    whose bytes differ from its digest is an error.
    """
    kinds = pa.schema([("file", pa.string()), ("record", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("http_size", pa.int64()), ("digest", pa.string()),
                       ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("size", pa.int64()), ("sha1", pa.binary()), ("check", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _folder(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    held, bytes_ = [], 0
                    for row in _chunks(file, stream, size, data):
                        held.append(row)
                        bytes_ += 200 + len(row[9] or b"")
                        if bytes_ >= BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                            held, bytes_ = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    files = archives.select("file")
    return files.repartition(max(1, min(archives.count(), 100_000)), "file").mapInArrow(tidy(run), CHUNK_SCHEMA)


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives inside the shared one."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, name = _folder(path)
    store.create_dir(name, recursive=True)
    return path


def op13_chunked_warc(spark, sf_dir: str) -> DataFrame:
    """A record for each page, written and read back; cases as in :func:`write_archives`."""
    folder = new_folder(spark)
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    rows = read_archives(archives, folder, data=False)
    page = lambda c: F.nullif(F.element_at(F.split(c, ":"), -2), F.lit("")).cast("bigint")
    size = F.when(F.col("record_type") == "response", F.col("size")).otherwise(F.col("http_size"))
    return rows.where("last").select(page("record").alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
