"""Web archives (.warc.zst) with a dictionary: written by Spark's own committer, read back record by record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary, trained on records of that archive; then each record is a frame of its own,
compressed with it: first a warcinfo record, then the pages'. Records whose payload was
archived before are `revisit` records that name the response they repeat. Files are written
with Spark's text writer under the suffix .warc.zst: a row is one frame, and the row separator
is an empty skippable frame, which every reader of the format passes over. So archives reach
any store that Spark can write to, and a task that is lost and runs again leaves no half file
behind.

The dictionary is trained on SAMPLES pieces of SAMPLE_BYTES / SAMPLES bytes, taken at even steps
over the whole archive; an archive is what one partition holds, ARCHIVE_BYTES on average.
Record ids are UUIDs made of the page's id, its payload and its number among equal rows of the
archive, so that a run gives the same and no two are alike; warcinfo is named by the archive.

Defined results: null payloads are empty; line breaks in URLs are escaped; a null id counts as
the last, and so a payload that only null ids have is all responses; rows of one id and payload
are all responses if the first is; a very long payload is one record, which a task holds; an
empty table gives archives without records; columns besides page_id, url and html play no part.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LAST, parts, scratch

DICT_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of no bytes
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
SAMPLES = 512
ARCHIVE_BYTES = 32 << 20
MIN_REVISIT = 100
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
NULL_SALTS = 64
FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]


SPACE = uuid.UUID("6f1c0f3e-5b0a-4f5e-9d55-4b1f3f1a7c10")  # of the record ids' names
SOFTWARE = "software: estatelens\r\nformat: WARC File Format 1.1\r\n"


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """The id of a page's record: the same for the same page and payload; copy tells equal rows apart."""
    return f"urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{copy}')}"


def _written(head: list[str], kind: str, block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Type: {kind}", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(archive: str, date: str) -> bytes:
    """The record that begins an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, archive)}>", f"WARC-Date: {date}", f"WARC-Filename: {archive}"]
    return _written(head, "application/warc-fields", SOFTWARE.encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """One WARC record; a revisit holds the response's header, whose length is that of the payload it repeats."""
    uri = quote(url or f"{ID_PREFIX}{page_id}", safe="".join(map(chr, range(0x21, 0x7F))))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest, copy)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    return _written(head, "application/http; msgtype=response", http if refers_to is not None else http + payload)


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple | None:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of a page's record, None of others; the digest of a response is computed from what was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    field = fields(head)
    if field["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    held = fields(http)
    page_id, length, url = int(held["X-Page"]) if held["X-Page"] else None, int(held["Content-Length"]), field["WARC-Target-URI"]
    if field["WARC-Type"] == "revisit":
        return page_id, url, "revisit", int(field["X-Refers-To-Page"]), None, length, field["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = hashlib.sha256(payload).hexdigest()
    if len(payload) != length or f"sha256:{digest}" != field["WARC-Payload-Digest"]:
        raise ValueError(f"record {field['WARC-Record-ID']} doesn't match its digest")
    return page_id, url, "response", None, payload, length, digest


def dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from records; plain content of theirs where there are too few to train on."""
    import zstandard

    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(DICT_BYTES, records, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too alike or too short to train on
    return b"".join(records)[:DICT_BYTES] or b"\x00" * 8


def samples(sizes: list[int], n: int = SAMPLES) -> list[int]:
    """Which records the dictionary is trained on: n of them at even steps over the archive, all if there are fewer."""
    return sorted({round(i * (len(sizes) - 1) / max(1, n - 1)) for i in range(n)}) if sizes else []


def frames(records: list[bytes]):
    """The frames of an archive: first that of the dictionary, then one for each record."""
    import zstandard

    each = SAMPLE_BYTES // SAMPLES
    middle = lambda r: r[max(0, len(r) - each) // 2 :][:each] if len(r) > 2 * each else r[: 2 * each]
    content = dictionary([middle(records[i]) for i in samples([len(r) for r in records])])
    yield struct.pack("<II", DICT_MAGIC, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True, write_checksum=True)
    for r in records:
        yield compressor.compress(r)


def records_of(archive: bytes):
    """The records of an archive; skippable frames are passed over, the leading one gives the dictionary."""
    import zstandard

    at, content, view = 0, None, memoryview(archive)
    decompressor = zstandard.ZstdDecompressor()
    while at < len(archive):
        magic = struct.unpack_from("<I", archive, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = struct.unpack_from("<I", archive, at + 4)[0]
            if magic == DICT_MAGIC and content is None:
                content = archive[at + 8 : at + 8 + size]
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        one, out = decompressor.decompressobj(), []
        while not one.eof:
            piece = view[at : at + 16384]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: dt.datetime | None = None) -> None:
    """pages: page_id, url, html. Writes archives below path; of equal payloads of MIN_REVISIT bytes and more, all but the first are revisits. date: WARC-Date of all records, now if not given."""
    stamp = (date or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    keyed = pages.withColumn("digest", F.sha2("html", 256))
    small = keyed.select("page_id", "digest", F.octet_length("html").alias("n"))
    n_bytes = int(small.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0)
    # only payloads that occur again travel: ids and digests, no text
    first = small.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = small.select("page_id", "digest").join(first.select("digest", "refers_to"), "digest").filter("page_id is null or page_id > refers_to").distinct()
    key = F.coalesce("page_id", F.lit(LAST)).alias("__key")
    # null ids are dealt by their URLs, so that no archive takes them all
    salt = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(NULL_SALTS))).otherwise(0).cast("int").alias("__salt")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("page_id").isNull(), F.lit(NULL_SALTS - 1)).otherwise(0))).alias("__salt")
    archives = parts(n_bytes, archive_bytes, 1)
    # pages travel once, straight to their archives
    out = keyed.select("*", key, salt).repartition(archives, "__key", "digest", "__salt").join(again.select(key, "digest", "refers_to", salts), ["__key", "digest", "__salt"], "left")
    out = out.select("page_id", "url", "html", "digest", "refers_to", "__salt").sortWithinPartitions("page_id", "digest", "url")

    def compress(batches):
        held, before, copy = [], None, 0
        for batch in batches:
            for one in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                columns = [one.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "refers_to", "__salt")]
                for page_id, url, text, digest, refers, own in zip(*columns, strict=True):
                    copy = copy + 1 if (page_id, digest) == before else 0
                    before = page_id, digest
                    held.append(record(page_id, url, text.encode(), digest, refers, stamp, own << 40 | copy))
        if not held:
            return
        size, packed = 0, []
        for frame in frames([info(archive_name(TaskContext.get().partitionId()), stamp), *held]):
            packed.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["frame"])
                packed, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["frame"])

    out.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)
    _name_archives(pages.sparkSession, path)


def archive_name(number: int) -> str:
    return f"pages-{number:05d}.warc.zst"


def _name_archives(spark, path: str) -> None:
    """Gives the files that Spark has committed the names of archives; empty ones go. A rename for each archive, no data."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith("part-"):
            continue
        if status.getLen():
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, archive_name(int(name.split("-")[1]))))
        else:
            fs.delete(status.getPath(), False)


def read_archives(spark, path: str) -> DataFrame:
    """The pages' records of all archives below path."""

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for raw in records_of(batch.column("content")[i].as_py()):
                    found = parse(raw)
                    if found is None:
                        continue
                    held.append(found)
                    size += len(raw)
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(read, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes every page into archives in the shared folder and reads them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    out = read_archives(pages.sparkSession, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from p left join f using (d)
"""
